"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .chat import END
from .warc import REVISIT_BYTES

_CHAT = f"""
WITH t AS (
  SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
answers AS (SELECT pair_id, max(n) AS last, max_by(text, n) AS answer FROM t WHERE role = 'assistant' GROUP BY pair_id),
both_sides AS (
  SELECT t.pair_id, t.n, t.role, t.text AS c, CASE WHEN t.n = a.last THEN coalesce(o.answer, '') ELSE t.text END AS r
  FROM t LEFT JOIN answers a ON a.pair_id = t.pair_id LEFT JOIN answers o ON o.pair_id = xor(t.pair_id, 1)),
shared AS (SELECT pair_id, coalesce(min(n) FILTER (c <> r), count(*) + 1) - 1 AS shared FROM both_sides GROUP BY pair_id),
m AS (
  SELECT b.*, s.shared, '<|' || role || '|>' || chr(10) AS head,
         '<|' || role || '|>' || chr(10) || c || '{END.strip()}' || chr(10) AS whole_c, '<|' || role || '|>' || chr(10) || r || '{END.strip()}' || chr(10) AS whole_r
  FROM both_sides b JOIN shared s USING (pair_id)),
p AS (
  SELECT *, coalesce(sum(CASE WHEN n > shared THEN length(whole_c) END) OVER w, 0) AS end_c, coalesce(sum(CASE WHEN n > shared THEN length(whole_r) END) OVER w, 0) AS end_r
  FROM m WINDOW w AS (PARTITION BY pair_id ORDER BY n))
SELECT pair_id, CAST(any_value(shared) AS BIGINT) AS prompt_turns,
       coalesce(string_agg(whole_c, '' ORDER BY n) FILTER (n <= shared), '') AS prompt,
       coalesce(string_agg(whole_c, '' ORDER BY n) FILTER (n > shared), '') AS chosen,
       coalesce(string_agg((end_c - length(whole_c) + length(head))::BIGINT || ':' || end_c::BIGINT, ',' ORDER BY n) FILTER (n > shared AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(whole_r, '' ORDER BY n) FILTER (n > shared), '') AS rejected,
       coalesce(string_agg((end_r - length(whole_r) + length(head))::BIGINT || ':' || end_r::BIGINT, ',' ORDER BY n) FILTER (n > shared AND role = 'assistant'), '') AS rejected_spans
FROM p GROUP BY pair_id
"""

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN NULL ELSE first END AS refers_to
FROM f
"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
r AS (SELECT row_number() OVER () AS n, * FROM v),
s AS (
  SELECT a.n AS anchor, a.vec_id AS anchor_id, b.vec_id, b.label = a.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.n <> b.n AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
f AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM f WHERE rank <= 5
"""

_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL = {"op1_preference_formatting": _CHAT, "op9_warc": _WARC, "op11_hard_negatives": _NEGATIVES, "op13_fill_in_middle": _MIDDLE}
