"""DuckDB SQL for the queries. ``CTES`` are the derived inputs; a query's text gets those it names, in order."""

from __future__ import annotations

import re

from ..functions.redaction import EMAIL
from ..operators.assemble import CATALOGUE
from ..operators.replies import ENVELOPE, FAILED_AS, ONLY_JSON, REPLY_IS, SCHEMA_IS, pretty
from ..sources.derived import NESTED_EXAMPLES, SCHEMA_DOC, SCHEMA_FAULTS, SCHEMA_INVOICE, SCHEMA_NESTED
from .queries import MAX_BYTES, MAX_PAGES, SAMPLE_PAGE

_PAIR = "CAST(doc_id + seq AS BIGINT)"
_EMAIL = EMAIL



def _numbers(text: str) -> str:
    """Long numbers redacted in texts without request ids. There is no look-behind: a letter after "line " makes its number a part of a word."""
    held = f"regexp_replace({text}, 'line ([0-9])', 'line Q_\\1', 'g')"
    return f"replace(regexp_replace({held}, '\\b([0-9]{{1,3}}([,\\s][0-9]{{3}})+(\\.[0-9]+)?|[0-9]{{4,}}(\\.[0-9]+)?)\\b', '[REDACTED_NUMBER]', 'g'), 'line Q_', 'line ')"


CTES = {
    "lines": "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS seq, unnest(string_split(text, chr(10))) AS line FROM documents",
    "items": f"""SELECT doc_id, seq, CASE WHEN {_PAIR} % 7 = 0 THEN '' ELSE line END AS text,
        CASE WHEN (doc_id * 3 + seq) % 13 = 0 THEN 0 WHEN {_PAIR} % 5 = 0 THEN 2 ELSE 1 END AS n_provs,
        CAST(seq // 10 + 1 AS INTEGER) AS page, 72.0::DOUBLE AS l, 540.0::DOUBLE AS r,
        (CASE WHEN doc_id % 2 = 0 THEN 72 + 12 * (seq % 10) ELSE 720 - 12 * (seq % 10) END)::DOUBLE AS t,
        (CASE WHEN doc_id % 2 = 0 THEN 82 + 12 * (seq % 10) ELSE 710 - 12 * (seq % 10) END)::DOUBLE AS b,
        CASE WHEN doc_id % 2 = 0 THEN 'CoordOrigin.TOPLEFT' WHEN doc_id % 10 <> 1 THEN 'CoordOrigin.BOTTOMLEFT' END AS coord_origin FROM lines""",
    "kept_items": "SELECT * FROM items WHERE text <> '' AND n_provs > 0",
    "heights": "SELECT DISTINCT doc_id, CAST(seq // 10 + 1 AS INTEGER) AS page, 792.0::DOUBLE AS height FROM lines WHERE NOT (doc_id % 17 = 0 AND seq // 10 = 1)",
    "located": """SELECT i.doc_id, i.seq, i.page, l AS x0, r AS x1, CASE WHEN doc_id % 2 = 0 THEN height - b ELSE b END AS y0,
        CASE WHEN doc_id % 2 = 0 THEN height - t ELSE t END AS y1, (doc_id % 2 <> 0 OR height IS NOT NULL) AS known FROM kept_items i LEFT JOIN heights USING (doc_id, page)""",
    "blocks": f"""SELECT doc_id, seq, 'p' || (seq // 10 + 1) || '_b' || (seq % 10) AS block_id, CAST(seq // 10 + 1 AS INTEGER) AS page,
        CASE WHEN {_PAIR} % 7 = 0 THEN '' ELSE line END AS text, 72.0::DOUBLE AS x0, (710 - 12 * (seq % 10))::DOUBLE AS y0, 540.0::DOUBLE AS x1, (720 - 12 * (seq % 10))::DOUBLE AS y1 FROM lines""",
    "docs": """SELECT doc_id, text, strlen(text) AS n_bytes, page_count, doc_id % 41 <> 0 AS is_valid, doc_id % 43 = 0 AS is_encrypted
        FROM documents JOIN (SELECT doc_id, CAST(max(seq) // 10 + 1 AS INTEGER) AS page_count FROM lines GROUP BY doc_id) USING (doc_id)""",
    "offsets": """SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS idx, CAST(sum(length(text) + 2) OVER w - 2 - length(text) AS BIGINT) AS start,
        CAST(sum(length(text) + 2) OVER w - 2 AS BIGINT) AS "end", block_id FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""",
    "line_offsets": """SELECT doc_id, seq AS idx, CAST(sum(length(line) + 1) OVER w - 1 - length(line) AS BIGINT) AS start,
        CAST(sum(length(line) + 1) OVER w - 1 AS BIGINT) AS "end", 'p' || (seq // 10 + 1) || '_b' || (seq % 10) AS block_id, line FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY seq)""",
    "shifted": """SELECT doc_id, k AS ord, CASE WHEN (doc_id + k) % 11 <> 0 THEN 'v' || (doc_id + k) END AS value,
        CASE WHEN (doc_id + k) % 13 <> 0 THEN (doc_id * 7919 + k * 101) % (len + 50) END AS start,
        CASE WHEN (doc_id + k) % 13 <> 0 THEN (doc_id * 7919 + k * 101) % (len + 50) + 1 + (doc_id * 31 + k) % 40 END AS "end"
        FROM (SELECT doc_id, CAST(sum(length(text) + 2) - 2 AS BIGINT) AS len FROM blocks GROUP BY doc_id), (SELECT CAST(unnest(range(10)) AS INTEGER) AS k)""",
    "raw": """SELECT doc_id, ord, field_name, value, CAST(CASE WHEN (doc_id + ord) % 9 = 1 THEN -4 ELSE s END AS INTEGER) AS start,
        CAST(CASE WHEN (doc_id + ord) % 9 = 2 THEN s ELSE e END AS INTEGER) AS "end", CAST(doc_id % 4 + 1 AS INTEGER) AS attempts FROM (
        SELECT doc_id, 0 AS ord, 'first_line' AS field_name, string_split(text, chr(10))[1] AS value, 0 AS s, length(string_split(text, chr(10))[1]) AS e FROM documents
        UNION ALL SELECT doc_id, 1, 'junk', 'x', 0, 1 FROM documents
        UNION ALL SELECT doc_id, 2, 'first_line', 'again', 3, 8 FROM documents
        UNION ALL SELECT doc_id, 3, 'number', n, CASE WHEN n IS NOT NULL THEN strpos(text, n) - 1 END, CASE WHEN n IS NOT NULL THEN strpos(text, n) - 1 + length(n) END
          FROM (SELECT doc_id, text, nullif(regexp_extract(text, '[0-9]{4,}'), '') AS n FROM documents) WHERE n IS NOT NULL OR doc_id % 2 <> 0)""",
    "first_raw": "SELECT * FROM raw WHERE field_name <> 'junk' QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY ord) = 1",
    "sane": """SELECT doc_id, ord, field_name, value, CASE WHEN ok THEN start END AS start, CASE WHEN ok THEN "end" END AS "end", ok AS grounded, attempts
        FROM (SELECT *, coalesce(start >= 0 AND start < "end", false) AS ok FROM first_raw)""",
    "wanted": "SELECT doc_id, field_name, field_pos FROM documents, (VALUES ('number', 0), ('first_line', 1), ('email', 2)) v(field_name, field_pos)",
    "tries": "SELECT d.doc_id, CAST(greatest(coalesce(max(r.attempts), 1), 1) AS INTEGER) AS attempts FROM documents d LEFT JOIN raw r ON r.doc_id = d.doc_id AND r.doc_id % 6 <> 0 GROUP BY d.doc_id",
    "ground": """SELECT s.doc_id, s.ord, s.field_name, s.value, a.block_id AS start_block, b.block_id AS end_block, s.start - a.start AS local_start, s."end" - b.start AS local_end,
        a.idx AS ai, b.idx AS bi, (s.value IS NOT NULL AND s.grounded AND a.idx IS NOT NULL AND b.idx IS NOT NULL) AS hit, b.line FROM sane s
        LEFT JOIN line_offsets a ON a.doc_id = s.doc_id AND s.start >= a.start AND s.start < a."end"
        LEFT JOIN line_offsets b ON b.doc_id = s.doc_id AND s."end" - 1 >= b.start AND s."end" - 1 < b."end" """,
    "fields": """SELECT w.doc_id, w.field_pos, w.field_name, g.ord, g.value, CASE WHEN g.value IS NULL THEN 'failed' ELSE 'extracted' END AS status,
        CASE WHEN g.value IS NULL OR g.hit THEN 'document' ELSE 'inferred' END AS source, coalesce(g.hit, false) AS grounded, t.attempts, ai, bi
        FROM wanted w LEFT JOIN ground g USING (doc_id, field_name) JOIN tries t ON t.doc_id = w.doc_id""",
    "wide": 'SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY idx) AS next_start FROM offsets WHERE start < "end"',
    "spans": """SELECT s.doc_id, s.ord, s.value, s.start, s."end", a.idx AS ai, a.block_id AS start_block, s.start - a.start AS local_start,
        (b.idx IS NULL AND a.idx IS NOT NULL AND s."end" - 1 >= a."end" AND s."end" - 1 < a.next_start) IS TRUE AS clamped, a."end" - a.start AS width,
        b.idx AS bi, b.block_id AS end_hit, s."end" - b.start AS end_local FROM shifted s
        LEFT JOIN wide a ON a.doc_id = s.doc_id AND s.start >= a.start AND s.start < a."end"
        LEFT JOIN wide b ON b.doc_id = s.doc_id AND s."end" - 1 >= b.start AND s."end" - 1 < b."end" """,
    "resolved": """SELECT doc_id, ord, value, ai, CASE WHEN clamped THEN ai ELSE bi END AS bi, start_block, CASE WHEN clamped THEN start_block ELSE end_hit END AS end_block, local_start,
        CASE WHEN clamped THEN width ELSE end_local END AS local_end, clamped, start IS NOT NULL AS claimed,
        (value IS NOT NULL AND start IS NOT NULL AND ai IS NOT NULL AND (clamped OR bi IS NOT NULL)) AS hit FROM spans""",
    "boxes": """SELECT r.doc_id, r.ord, CAST(row_number() OVER (PARTITION BY r.doc_id, r.ord ORDER BY w.idx) - 1 AS INTEGER) AS box_no, w.block_id, b.page, b.seq, b.x0, b.y0, b.x1, b.y1
        FROM resolved r JOIN wide w ON w.doc_id = r.doc_id AND w.idx BETWEEN r.ai AND r.bi JOIN blocks b ON b.doc_id = w.doc_id AND b.seq = w.idx WHERE r.hit""",
    "repeated": "SELECT doc_id, seq, 'r' || (seq % 3) AS block_id, text, page, x0, y0, x1, y1 FROM blocks",
    "repeated_index": 'SELECT o.doc_id, o.idx, o.start, o."end", r.block_id FROM offsets o JOIN repeated r ON r.doc_id = o.doc_id AND r.seq = o.idx',
    "late": "SELECT * FROM repeated_index WHERE idx > 0 OR doc_id % 2 = 0",
    "repeated_spans": """SELECT v.doc_id, v.ord, 'r' || (v.ai % 3) AS start_block, 'r' || (v.bi % 3) AS end_block FROM resolved v WHERE v.hit""",
    "repeated_ranges": """SELECT s.*, (SELECT min(idx) FROM late l WHERE l.doc_id = s.doc_id AND l.block_id = s.start_block) AS from_idx,
        (SELECT max(idx) FROM late l WHERE l.doc_id = s.doc_id AND l.block_id = s.end_block) AS end_last FROM repeated_spans s""",
    "repeated_broken": """SELECT *, CASE WHEN start_block = end_block THEN NULL WHEN from_idx IS NULL THEN 'start_block_not_seen' WHEN end_last IS NULL THEN 'end_block_not_seen_after_start'
        WHEN end_last < from_idx THEN 'end_block_seen_before_start_block' END AS broken FROM repeated_ranges""",
    "repeated_chosen": """SELECT doc_id, ord, start_block AS block_id, 0 AS idx, broken FROM repeated_broken WHERE start_block = end_block OR broken IS NOT NULL
        UNION ALL SELECT b.doc_id, b.ord, l.block_id, min(l.idx), NULL FROM repeated_broken b
        JOIN late l ON l.doc_id = b.doc_id AND l.start < l."end" AND l.idx >= b.from_idx
          AND l.idx <= (SELECT min(e.idx) FROM late e WHERE e.doc_id = b.doc_id AND e.block_id = b.end_block AND e.idx >= b.from_idx)
        WHERE b.start_block <> b.end_block AND b.broken IS NULL GROUP BY b.doc_id, b.ord, l.block_id""",
    "last_block": "SELECT doc_id, block_id, max_by(page, seq) AS page, max_by(x0, seq) AS x0, max_by(y0, seq) AS y0, max_by(x1, seq) AS x1, max_by(y1, seq) AS y1 FROM repeated GROUP BY doc_id, block_id",
    "vals": """SELECT doc_id, seq, line AS text, CASE CAST((doc_id + seq) % 4 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN 'no such value' ELSE substring(line, 4, 12) END AS value FROM lines""",
    "good": "SELECT doc_id, CAST(unnest(range(1, 6)) AS INTEGER) AS attempt, '{\"extractions\":[{\"id\":\"' || doc_id || '\",\"id_attributes\":{}},{\"n\":' || doc_id || ',\"n_attributes\":{\"a\":1}},{\"id\":\"again\"}]}' AS good FROM documents",
    "replies": """SELECT doc_id, attempt, CAST((doc_id + attempt) % 8 AS INTEGER) AS m, good, CASE CAST((doc_id + attempt) % 8 AS INTEGER) WHEN 0 THEN good WHEN 1 THEN '  ```json' || chr(10) || good || chr(10) || '```' || chr(10)
        WHEN 2 THEN 'Here it is: ' || good WHEN 3 THEN '{"extractions":[{"id":' WHEN 4 THEN '{"results":[]}' WHEN 5 THEN 'I cannot say.' WHEN 6 THEN '{"extractions":{"id":"x"}}'
        ELSE '```JSON' || chr(10) || '{"extractions":"none"}```' END AS raw_text FROM good""",
    "cleaned": r"""SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_text, '^\s+', ''), '\s+$', ''), '^(```json|```JSON|```)\s*', ''), '\s*```\s*$', '') AS cleaned FROM replies""",
    "judged": """SELECT *, CASE WHEN strpos(cleaned, '{') = 0 THEN 'no_json_object' WHEN NOT json_valid(substring(cleaned, strpos(cleaned, '{'))) THEN 'json_parse_error'
        WHEN NOT json_exists(substring(cleaned, strpos(cleaned, '{')), '$.extractions') THEN 'schema_violation:$'
        WHEN json_type(substring(cleaned, strpos(cleaned, '{')), '$.extractions') <> 'ARRAY' THEN 'schema_violation:$.extractions' END AS cause FROM cleaned""",
    "base_skills": f"""SELECT CAST(s_suppkey AS BIGINT) AS k, 'skill' || s_nationkey AS n FROM supplier""",
    "skill_parts": """SELECT k, n, CASE WHEN k % 23 = 0 THEN '0' || k WHEN k % 29 = 0 THEN 'one' ELSE CAST(k AS VARCHAR) END AS stem, CASE WHEN k % 31 = 0 THEN '.yml' ELSE '.yaml' END AS ext,
        CASE WHEN k % 37 = 0 THEN 'Other' ELSE n END AS folder FROM base_skills""",
    "single_skills": f"""SELECT CASE WHEN k % 41 = 0 THEN stem || ext WHEN k % 47 = 0 THEN folder || '/deep/' || stem || ext ELSE folder || '/' || stem || ext END AS path,
        CASE WHEN k % 53 = 0 THEN upper(n) ELSE n END AS name, CAST(CASE WHEN k % 59 = 0 THEN 0 ELSE k END AS INTEGER) AS version, CASE WHEN k % 61 = 0 THEN '' ELSE 'Read ' || k END AS prompt,
        k, CASE WHEN k % 5 = 0 THEN '{SCHEMA_INVOICE}' WHEN k % 5 = 2 THEN '{SCHEMA_NESTED}' {" ".join(f"WHEN k % 20 = {2 * i + 1} THEN '{f}'" for i, f in enumerate(SCHEMA_FAULTS))} ELSE '{SCHEMA_DOC}' END AS output_schema,
        CASE WHEN k % 71 = 0 THEN [] ELSE [CASE WHEN k % 10 = 0 THEN '{{"kind":"c"}}' WHEN k % 5 = 0 THEN '{{"total":"12","kind":"a"}}' WHEN k % 10 = 2 THEN '{NESTED_EXAMPLES[0]}' WHEN k % 10 = 7 THEN '{NESTED_EXAMPLES[1]}' ELSE '{{"number":"12"}}' END,
          CASE WHEN k % 15 = 0 THEN '{{"total":12}}' WHEN k % 10 = 2 THEN '{NESTED_EXAMPLES[2]}' WHEN k % 10 = 7 THEN '{NESTED_EXAMPLES[3]}' ELSE '{{}}' END]::VARCHAR[] END AS examples,
        CASE WHEN k % 3 = 0 THEN 'force' WHEN k % 73 = 0 THEN 'maybe' END AS ocr, CASE WHEN k % 4 = 0 THEN 'fast' END AS table_mode FROM skill_parts""",
    "skills": "SELECT * FROM single_skills UNION ALL SELECT replace(path, '/', '/00'), * EXCLUDE (path) FROM single_skills WHERE version % 12 = 0",
    "files": """SELECT path, k, CAST(k % 11 AS INTEGER) AS c, CASE WHEN k % 11 NOT IN (1, 2, 3) THEN name END AS name, CASE WHEN k % 11 NOT IN (1, 2, 3, 4) THEN version END AS version, CASE WHEN k % 11 NOT IN (1, 2, 3, 5) THEN prompt END AS prompt,
        CASE WHEN k % 11 NOT IN (1, 2, 3) THEN output_schema END AS output_schema, CASE WHEN k % 11 NOT IN (1, 2, 3, 5) THEN examples END AS examples, CASE WHEN k % 11 NOT IN (1, 2, 3) THEN ocr END AS ocr, CASE WHEN k % 11 NOT IN (1, 2, 3) THEN table_mode END AS table_mode,
        list_filter(CASE CAST(k % 11 AS INTEGER) WHEN 1 THEN ['$: json'] WHEN 2 THEN ['$: type'] WHEN 3 THEN ['$: json'] WHEN 4 THEN ['$.version: type'] WHEN 5 THEN ['$: required:examples', '$: required:prompt']
          WHEN 6 THEN ['$: unknown:extra', '$.docling: unknown:speed', CASE WHEN len(examples) > 0 THEN '$.examples[0]: unknown:note' END] ELSE [] END, lambda x: x IS NOT NULL) AS shape FROM (SELECT DISTINCT ON (path) * FROM skills)""",
    "placed": r"SELECT * FROM files WHERE regexp_full_match(path, '[^/]+/[^/]+\.yaml')",
    "placed_parts": r"SELECT *, regexp_extract(path, '([^/]+)\.yaml$', 1) AS stem, regexp_extract(path, '^([^/]+)/', 1) AS folder FROM placed",
    "row_problems": """SELECT path, unnest(list_concat(shape, list_filter([CASE WHEN NOT regexp_full_match(name, '[a-z0-9][a-z0-9_\\-]*') THEN 'name_not_a_slug' END, CASE WHEN version <= 0 THEN 'version_not_positive' END,
        CASE WHEN prompt = '' THEN 'prompt_empty' END, CASE WHEN len(examples) = 0 THEN 'no_examples' END, CASE WHEN NOT regexp_full_match(stem, '[+-]?[0-9]+') THEN 'stem_not_an_integer' END,
        CASE WHEN regexp_full_match(stem, '[+-]?[0-9]+') AND TRY_CAST(stem AS INTEGER) <> version THEN 'stem_is_not_version' END, CASE WHEN folder <> name THEN 'folder_is_not_name' END,
        NULL], lambda p: p IS NOT NULL))) AS problem FROM placed_parts""",
    "schema_problems": f"""SELECT path, CASE WHEN output_schema = '{SCHEMA_FAULTS[0]}' THEN 'composition:anyOf,$ref' ELSE 'no_properties' END AS problem FROM placed
        WHERE output_schema IS NOT NULL AND (coalesce(len(json_keys(output_schema, '$.properties')), 0) = 0 OR json_exists(output_schema, '$."$ref"'))""",
    "example_rows": "SELECT path, output_schema, CAST(generate_subscripts(examples, 1) - 1 AS INTEGER) AS example_no, unnest(examples) AS ex FROM placed",
    "nested_items": f"SELECT e.path, e.example_no, CAST(i.key AS INTEGER) AS n, i.value AS v FROM (SELECT * FROM example_rows WHERE output_schema = '{SCHEMA_NESTED}' AND json_type(ex, '$.items') = 'ARRAY') e, json_each(e.ex, '$.items') i",
    "item_problems": """SELECT path, example_no, '$.items[' || n || ']' AS base, v FROM nested_items""",
    "example_problems": f"""SELECT path, example_no, v.place, v.rule FROM (SELECT path, example_no, unnest(
        CASE WHEN output_schema = '{SCHEMA_INVOICE}' THEN [CASE WHEN NOT json_exists(ex, '$.total') THEN {{'place': '$', 'rule': 'required:total'}} END, CASE WHEN json_extract_string(ex, '$.kind') NOT IN ('a', 'b') THEN {{'place': '$.kind', 'rule': 'enum'}} END, CASE WHEN json_exists(ex, '$.total') AND json_type(ex, '$.total') <> 'VARCHAR' THEN {{'place': '$.total', 'rule': 'type'}} END]
        WHEN output_schema = '{SCHEMA_DOC}' THEN [CASE WHEN json_exists(ex, '$.number') AND json_type(ex, '$.number') <> 'VARCHAR' THEN {{'place': '$.number', 'rule': 'type'}} END]
        WHEN output_schema = '{SCHEMA_NESTED}' THEN [CASE WHEN NOT json_exists(ex, '$.items') THEN {{'place': '$', 'rule': 'required:items'}} END, CASE WHEN json_array_length(ex, '$.items') = 0 THEN {{'place': '$.items', 'rule': 'minItems'}} END,
          CASE WHEN json_type(ex, '$.total') NOT IN ('NULL', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN {{'place': '$.total', 'rule': 'type'}} END] END) AS v FROM example_rows
        UNION ALL SELECT path, example_no, unnest([CASE WHEN NOT json_exists(v, '$.sku') THEN {{'place': base, 'rule': 'required:sku'}} END, CASE WHEN json_type(v, '$.sku') <> 'VARCHAR' THEN {{'place': base || '.sku', 'rule': 'type'}} END,
          CASE WHEN json_type(v, '$.sku') = 'VARCHAR' AND length(json_extract_string(v, '$.sku')) > 4 THEN {{'place': base || '.sku', 'rule': 'maxLength'}} END,
          CASE WHEN json_type(v, '$.count') = 'VARCHAR' OR CAST(json_extract(v, '$.count') AS DOUBLE) % 1 <> 0 THEN {{'place': base || '.count', 'rule': 'type'}} END, CASE WHEN json_type(v, '$.count') <> 'VARCHAR' AND CAST(json_extract(v, '$.count') AS DOUBLE) < 1 THEN {{'place': base || '.count', 'rule': 'minimum'}} END,
          CASE WHEN CAST(json_extract(v, '$.flag') AS VARCHAR) NOT IN ('1', '1.0', '"yes"') THEN {{'place': base || '.flag', 'rule': 'enum'}} END]) FROM item_problems) WHERE v IS NOT NULL""",
    "duplicates": """SELECT path, kept_path FROM (SELECT path, first_value(path) OVER w AS kept_path, row_number() OVER w AS n FROM placed WHERE name IS NOT NULL AND version IS NOT NULL WINDOW w AS (PARTITION BY name, version ORDER BY path)) WHERE n > 1""",
    "problems": r"""SELECT path, CASE WHEN path LIKE '%.yml' THEN 'bad_extension' ELSE 'stray' END AS problem FROM files WHERE path LIKE '%.yml' OR NOT regexp_full_match(path, '[^/]+/[^/]+\.yaml')
        UNION ALL SELECT * FROM row_problems UNION ALL SELECT * FROM schema_problems UNION ALL SELECT path, 'example ' || example_no || ': ' || place || ': ' || rule FROM example_problems UNION ALL SELECT path, 'duplicate of ' || kept_path FROM duplicates""",
    "newest": "SELECT name, max(version) AS version FROM skills GROUP BY name",
    "requests": """SELECT doc_id, CASE WHEN doc_id % 8 = 4 THEN 'nothing' ELSE 'skill' || (doc_id % 25) END AS skill_name, CASE CAST(doc_id % 8 AS INTEGER) WHEN 0 THEN 'latest' WHEN 1 THEN '999999' WHEN 2 THEN 'abc' WHEN 3 THEN '0' WHEN 4 THEN 'latest' ELSE CAST(doc_id % 10 + 1 AS VARCHAR) END AS skill_version,
        CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN 'JSON_ONLY' WHEN 1 THEN 'PDF_ONLY' ELSE 'BOTH' END AS output_mode FROM documents""",
    "asked": """SELECT doc_id, skill_name, skill_version, output_mode, CASE WHEN code IS NULL THEN w END AS version, code FROM (
        SELECT r.*, w, CASE WHEN NOT regexp_full_match(skill_version, 'latest|[1-9][0-9]*') THEN 'VALIDATION_FAILED' WHEN NOT EXISTS (SELECT 1 FROM skills s WHERE s.name = r.skill_name AND s.version = w) THEN 'SKILL_NOT_FOUND' END AS code
        FROM (SELECT q.*, CASE WHEN skill_version = 'latest' THEN n.version ELSE TRY_CAST(skill_version AS INTEGER) END AS w FROM requests q LEFT JOIN newest n ON n.name = q.skill_name) r)""",
    "no_blocks": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept_items WHERE doc_id % 19 <> 0)",
    "failed": "SELECT doc_id FROM requests WHERE doc_id NOT IN (SELECT doc_id FROM first_raw WHERE doc_id % 7 <> 0 AND doc_id % 16 <> 0 AND value IS NOT NULL)",
    "gates": f"""SELECT doc_id, code, CASE WHEN code = 'VALIDATION_FAILED' THEN 1 ELSE 3 END AS stage, CASE WHEN code = 'SKILL_NOT_FOUND' THEN 'name=' || skill_name || ';version=' || skill_version ELSE '' END AS params FROM asked WHERE code IS NOT NULL
        UNION ALL SELECT doc_id, 'PDF_TOO_LARGE', 2, 'actual_bytes=' || n_bytes || ';max_bytes={MAX_BYTES}' FROM docs WHERE n_bytes > {MAX_BYTES}
        UNION ALL SELECT doc_id, 'PDF_INVALID', 4, '' FROM docs WHERE NOT is_valid UNION ALL SELECT doc_id, 'PDF_PASSWORD_PROTECTED', 5, '' FROM docs WHERE is_encrypted
        UNION ALL SELECT doc_id, 'PDF_TOO_MANY_PAGES', 6, 'actual=' || page_count || ';limit={MAX_PAGES}' FROM docs WHERE page_count > {MAX_PAGES}
        UNION ALL SELECT doc_id, 'PDF_NO_TEXT_EXTRACTABLE', 7, '' FROM no_blocks UNION ALL SELECT doc_id, 'STRUCTURED_OUTPUT_FAILED', 8, '' FROM failed""",
    "errs": "SELECT doc_id, min_by(code, stage) AS code, min_by(params, stage) AS params FROM gates GROUP BY doc_id",
    "codes": "SELECT * FROM (VALUES " + ", ".join(f"('{code}', {status}, '{','.join(sorted(params))}')" for code, status, params in CATALOGUE) + ") v(code, http_status, params)",
    "lat": "SELECT 'fixture' || (user_id % 3) AS fixture, CASE event_type WHEN 'view' THEN 'JSON_ONLY' WHEN 'click' THEN 'PDF_ONLY' ELSE 'BOTH' END AS mode, event_id AS iter, value AS seconds FROM events WHERE event_type IN ('view', 'click', 'purchase')",
    "warm": "SELECT * FROM lat QUALIFY row_number() OVER (PARTITION BY fixture, mode ORDER BY iter) > 1",
    "part_params": """SELECT CAST(p_partkey AS BIGINT) AS k, CASE WHEN p_partkey % 19 = 0 THEN 'part_' ELSE 'PART_' END || p_partkey AS code, CAST(390 + p_partkey % 220 AS INTEGER) AS http_status,
        list_filter([CASE WHEN p_partkey % 2 = 0 THEN {'name': 'size', 'type': CASE WHEN p_partkey % 22 = 0 THEN 'text' ELSE 'integer' END} END, CASE WHEN p_partkey % 3 = 0 THEN {'name': CASE WHEN p_partkey % 33 = 0 THEN 'bad-name' ELSE 'label' END, 'type': 'string'} END], lambda x: x IS NOT NULL) AS params FROM part""",
    "required": "SELECT code, list_sort(list_transform(params, lambda x: x.name)) AS params FROM part_params",
    "langs": "SELECT CAST(p_partkey AS BIGINT) AS own, unnest(['en', 'de']) AS lang FROM part",
    "lang_keys": "SELECT own, lang, own + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS k FROM langs",
    "translations": """SELECT lang, CASE WHEN own % 19 = 0 THEN 'part_' WHEN k % 23 = 0 THEN 'EXTRA_' ELSE 'PART_' END || own AS key, CASE WHEN k % 34 = 0 THEN chr(9) || chr(10) || chr(8195) WHEN k % 17 = 0 THEN ' ' WHEN k % 31 = 0 THEN 'Text {{größe}}' ELSE 'Text' || CASE WHEN own % 2 = 0 AND k % 13 <> 0 THEN ' {{size}}' ELSE '' END ||
        CASE WHEN own % 3 = 0 OR k % 11 = 0 THEN ' {{label}} {{label}}' ELSE '' END END AS text FROM lang_keys WHERE k % 29 <> 0""",
    "compared": r"""SELECT coalesce(w.lang, t.lang) AS lang, coalesce(w.code, t.key) AS key, w.code, w.params, t.text, list_distinct(regexp_extract_all(t.text, '\{\{([\pL\pN_]+)\}\}', 1)) AS used
        FROM (SELECT r.*, l.lang FROM required r, (SELECT DISTINCT lang FROM translations) l) w FULL JOIN translations t ON t.lang = w.lang AND t.key = w.code""",
    "was": "SELECT 'doc/' || doc_id AS path, text FROM documents",
    "now": "SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'new/doc/' || doc_id, text FROM documents WHERE doc_id % 13 = 0",
    "checks": "SELECT user_id AS key, ts, event_id AS seq, event_type <> 'error' AS ok, lag(event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events",
}

_PROMPT = " || ".join(f"'{part}'" if i % 2 else part for i, part in enumerate(("'Prompt ' || doc_id", REPLY_IS, "raw_text", FAILED_AS, "cause", SCHEMA_IS, f"'{pretty(ENVELOPE)}'", ONLY_JSON)))

_SELECTS = {
    "src_1": f"SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN n_bytes <= {MAX_BYTES} THEN md5(text) END AS digest, CAST(CASE WHEN n_bytes > {MAX_BYTES} THEN {MAX_BYTES} END AS BIGINT) AS max_bytes, CAST(CASE WHEN n_bytes > {MAX_BYTES} THEN n_bytes END AS BIGINT) AS actual_bytes FROM docs",
    "src_2": "SELECT path, name, version, prompt, CAST(len(examples) AS INTEGER) AS n_examples, output_schema, ocr, table_mode, array_to_string(shape, ';') AS shape FROM files",
    "src_3": "SELECT c.code, c.http_status, c.params, count(e.doc_id) AS n FROM codes c LEFT JOIN errs e ON e.code = c.code GROUP BY ALL",
    "snk_1": """SELECT * FROM (WITH alive AS (SELECT * FROM asked WHERE code IS NULL AND doc_id NOT IN (SELECT doc_id FROM errs)),
        marks AS (SELECT g.doc_id, g.ord || ':' || (row_number() OVER (PARTITION BY g.doc_id, g.ord ORDER BY o.idx) - 1) AS name, b.page || ':' || CAST(b.x0 AS INTEGER) || ':' || CAST(792 - b.y1 AS INTEGER) || ':' || CAST(b.x1 AS INTEGER) || ':' || CAST(792 - b.y0 AS INTEGER) AS value, h.height
          FROM ground g JOIN line_offsets o ON o.doc_id = g.doc_id AND o.idx BETWEEN g.ai AND g.bi AND o.start < o."end" JOIN blocks b ON b.doc_id = o.doc_id AND b.seq = o.idx LEFT JOIN heights h ON h.doc_id = b.doc_id AND h.page = b.page WHERE g.hit),
        f AS (SELECT f.*, a.output_mode FROM fields f JOIN alive a ON a.doc_id = f.doc_id)
        SELECT CAST(doc_id % 2 AS INTEGER) AS batch, * FROM (SELECT 'responses' AS sink, doc_id, field_name AS name, value FROM f WHERE output_mode <> 'PDF_ONLY'
          UNION ALL SELECT 'fields', doc_id, field_name, status FROM f
          UNION ALL SELECT 'highlights', m.doc_id, m.name, m.value FROM marks m JOIN alive a ON a.doc_id = m.doc_id WHERE a.output_mode <> 'JSON_ONLY' AND m.height IS NOT NULL
          UNION ALL SELECT 'errors', e.doc_id, e.code, CAST(c.http_status AS VARCHAR) FROM errs e JOIN codes c ON c.code = e.code))""",
    "snk_2": "SELECT e.doc_id, e.code, c.http_status, e.params, md5('request:' || e.doc_id) AS request_id FROM errs e JOIN codes c ON c.code = e.code",
    "blk_1": "SELECT doc_id, seq, text, page, l, t, r, b, coord_origin FROM kept_items",
    "blk_2": """SELECT * FROM (WITH RECURSIVE rows_ AS (SELECT doc_id, seq, seq // 10 AS page, seq % 10 // 3 AS part FROM lines WHERE doc_id % 3 <> 0),
        n AS (SELECT DISTINCT doc_id, 'd' AS node, NULL AS parent, 0 AS ordinal FROM rows_
          UNION ALL SELECT DISTINCT doc_id, 'p' || page, 'd', CASE WHEN doc_id % 3 = 2 THEN 1000000 - page ELSE page END FROM rows_
          UNION ALL SELECT DISTINCT doc_id, 'p' || page || 'g' || part, 'p' || page, CASE WHEN page % 2 = 1 THEN 1000000 - part ELSE part END FROM rows_
          UNION ALL SELECT doc_id, 'l' || seq, 'p' || page || 'g' || part, CASE WHEN doc_id % 2 = 1 THEN 1000000 - seq ELSE seq END FROM rows_),
        t AS (SELECT doc_id, node, [0] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.doc_id, n.node, list_append(t.path, n.ordinal) FROM n JOIN t ON t.doc_id = n.doc_id AND t.node = n.parent),
        o AS (SELECT l.doc_id, l.seq, l.line, t.path FROM lines l LEFT JOIN t ON t.doc_id = l.doc_id AND t.node = 'l' || l.seq)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, seq) - 1 AS INTEGER) AS seq, seq AS storage_seq, line AS text, CAST(len(path) - 1 AS INTEGER) AS level FROM o)""",
    "blk_3": "SELECT doc_id, seq, page, x0, y0, x1, y1, known FROM located",
    "blk_4": "SELECT doc_id, seq, page, 'p' || page || '_b' || (row_number() OVER (PARTITION BY doc_id, page ORDER BY seq) - 1) AS block_id FROM located",
    "blk_5": f"SELECT doc_id, block_id, 'x_inverted' AS reason FROM blocks WHERE {_PAIR} % 9 = 0 UNION ALL SELECT doc_id, block_id, 'y_inverted' FROM blocks WHERE {_PAIR} % 10 = 0 UNION ALL SELECT doc_id, block_id, 'page_below_1' FROM blocks WHERE {_PAIR} % 14 = 0",
    "blk_6": f"SELECT doc_id, seq, block_id, text FROM blocks WHERE page = {SAMPLE_PAGE}",
    "blk_7": f'SELECT doc_id, {MAX_PAGES} AS "limit", page_count AS actual FROM docs WHERE page_count > {MAX_PAGES}',
    "blk_8": "SELECT doc_id, 'PDF_NO_TEXT_EXTRACTABLE' AS code FROM no_blocks",
    "off_1": "SELECT doc_id, length(t) AS n, md5(t) AS digest FROM (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS t FROM blocks GROUP BY doc_id)",
    "off_2": 'SELECT doc_id, idx, start, "end", block_id FROM offsets',
    "off_3": """SELECT doc_id, idx, reason FROM (SELECT doc_id, idx, unnest([CASE WHEN s < 0 OR e < 0 THEN 'negative' END, CASE WHEN s > e THEN 'inverted' END, CASE WHEN s < lag(e) OVER (PARTITION BY doc_id ORDER BY idx) THEN 'overlap' END]) AS reason FROM (
        SELECT doc_id, idx, CASE doc_id % 5 WHEN 1 THEN "end" WHEN 2 THEN start - 3 WHEN 3 THEN start - 10000 ELSE start END AS s, CASE WHEN doc_id % 5 = 1 THEN start ELSE "end" END AS e FROM offsets)) WHERE reason IS NOT NULL""",
    "off_4": 'SELECT s.doc_id, s.ord, s.start AS "offset", w.block_id, s.start - w.start AS local FROM shifted s LEFT JOIN wide w ON w.doc_id = s.doc_id AND s.start >= w.start AND s.start < w."end" WHERE s.start IS NOT NULL',
    "off_5": "SELECT doc_id, count(*) AS n_blocks FROM offsets GROUP BY doc_id",
    "mat_1": "SELECT doc_id, seq, CASE WHEN value = '' THEN 0 WHEN strpos(text, value) > 0 THEN strpos(text, value) - 1 END AS start, CASE WHEN value = '' THEN 0 WHEN strpos(text, value) > 0 THEN strpos(text, value) - 1 + length(value) END AS \"end\" FROM vals",
    "mat_2": r"""SELECT * FROM (WITH v AS (SELECT doc_id, seq, replace(text, ' ', ' ' || chr(9) || ' ') AS t, regexp_replace(replace(text, ' ', ' ' || chr(9) || ' '), '\s+', ' ', 'g') AS c, regexp_replace(value, '\s+', ' ', 'g') AS w FROM vals WHERE value <> ''),
        h AS (SELECT *, instr(c, w) - 1 AS a, instr(c, w) - 1 + length(w) AS b FROM v WHERE t <> '' AND contains(c, w)),
        p AS (SELECT doc_id, seq, unnest(regexp_extract_all(t, '\s+|\S+')) AS tok, generate_subscripts(regexp_extract_all(t, '\s+|\S+'), 1) AS k FROM h),
        q AS (SELECT *, length(tok) AS n, regexp_matches(tok, '^\s') AS gap, CASE WHEN regexp_matches(tok, '^\s') THEN 1 ELSE length(tok) END AS m FROM p),
        o AS (SELECT *, sum(n) OVER x - n AS t0, sum(m) OVER x - m AS c0 FROM q WINDOW x AS (PARTITION BY doc_id, seq ORDER BY k)),
        f AS (SELECT h.doc_id, h.seq, max(CASE WHEN a >= c0 AND a < c0 + m THEN t0 + CASE WHEN gap THEN 0 ELSE a - c0 END END) AS s,
            coalesce(max(CASE WHEN b >= c0 AND b < c0 + m THEN t0 + CASE WHEN gap THEN 0 ELSE b - c0 END END), any_value(length(t))) AS e FROM h JOIN o ON o.doc_id = h.doc_id AND o.seq = h.seq GROUP BY ALL)
        SELECT v.doc_id, v.seq, CAST(f.s AS BIGINT) AS start, CAST(f.e AS BIGINT) AS "end" FROM v LEFT JOIN f ON f.doc_id = v.doc_id AND f.seq = v.seq)""",
    "out_1": "SELECT doc_id, attempt, cleaned FROM cleaned",
    "out_2": "SELECT doc_id, attempt, CASE WHEN strpos(cleaned, '{') > 0 AND json_valid(substring(cleaned, strpos(cleaned, '{'))) THEN substring(cleaned, strpos(cleaned, '{')) END AS json FROM judged",
    "out_3": "SELECT doc_id, attempt, cause FROM judged",
    "out_4": "SELECT doc_id, attempt, coalesce(replace(cause, 'schema_violation:', ''), '') AS paths FROM judged WHERE cause IS NULL OR cause LIKE 'schema%'",
    "out_5": """SELECT j.doc_id, CAST(any_value(w.a) AS INTEGER) AS attempt, coalesce(string_agg(cause, ';' ORDER BY attempt) FILTER (cause IS NOT NULL AND (w.a IS NULL OR attempt < w.a)), '') AS causes, CASE WHEN any_value(w.a) IS NULL THEN 'STRUCTURED_OUTPUT_FAILED' END AS code
        FROM judged j LEFT JOIN (SELECT doc_id, min(attempt) AS a FROM judged WHERE cause IS NULL AND attempt <= 4 GROUP BY doc_id) w ON w.doc_id = j.doc_id WHERE attempt <= 4 GROUP BY j.doc_id""",
    "out_6": f"SELECT doc_id, attempt, md5({_PROMPT}) AS digest, CAST(length({_PROMPT}) AS INTEGER) AS n FROM judged WHERE cause IS NOT NULL",
    "out_7": f"SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS attempt, field_name, value FROM (SELECT doc_id, 'number' AS field_name, nullif(regexp_extract(text, '[0-9]{{4,}}'), '') AS value FROM documents UNION ALL SELECT doc_id, 'email', nullif(regexp_extract(text, '{_EMAIL}'), '') FROM documents) WHERE value IS NOT NULL",
    "out_8": "SELECT doc_id, attempt, CAST(unnest([0, 1, 2]) AS INTEGER) AS ord, unnest(['id', 'n', 'id']) AS field_name, unnest([CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), 'again']) AS value FROM judged WHERE cause IS NULL",
    "out_9": "SELECT path, CAST(example_no AS INTEGER) AS example_no, 'input ' || k AS input, field_name, json_extract_string(ex, '$.' || field_name) AS value FROM (SELECT path, k, generate_subscripts(examples, 1) - 1 AS example_no, unnest(examples) AS ex FROM skills), unnest(json_keys(ex)) AS u(field_name)",
    "fld_1": "SELECT path, CAST(generate_subscripts(json_keys(output_schema, '$.properties'), 1) - 1 AS INTEGER) AS field_pos, unnest(json_keys(output_schema, '$.properties')) AS field_name FROM files",
    "fld_2": "SELECT doc_id, ord, field_name FROM raw WHERE field_name <> 'junk'",
    "fld_3": "SELECT doc_id, ord, field_name, value FROM raw WHERE ord <> 2",
    "fld_4": "SELECT doc_id, field_pos, field_name, value, status, source, grounded, attempts FROM fields",
    "fld_5": 'SELECT doc_id, ord, CASE WHEN ok THEN start END AS start, CASE WHEN ok THEN "end" END AS "end", ok AS grounded FROM (SELECT *, coalesce(start >= 0 AND start < "end", false) AS ok FROM raw)',
    "fld_6": """SELECT doc_id, ord, reason FROM (SELECT doc_id, ord, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN start IS NULL OR "end" IS NULL THEN 'grounded_without_offsets' WHEN start < 0 OR start >= "end" THEN 'bad_interval' END
        WHEN start IS NOT NULL OR "end" IS NOT NULL THEN 'ungrounded_with_offsets' END AS reason FROM raw) WHERE reason IS NOT NULL""",
    "fld_7": "SELECT doc_id, attempts FROM tries",
    "fld_8": "SELECT doc_id FROM documents WHERE doc_id % 12 <> 0 AND doc_id % 10 <> 0 AND text <> ''",
    "spn_1": """SELECT doc_id, ord, value, CASE WHEN value IS NULL THEN 'failed' ELSE 'extracted' END AS status, CASE WHEN value IS NULL OR hit THEN 'document' ELSE 'inferred' END AS source, hit AS grounded,
        CASE WHEN value IS NULL THEN 'no_value' WHEN NOT claimed THEN 'ungrounded' WHEN NOT hit THEN 'hallucinated_offsets' WHEN clamped THEN 'clamped' END AS reason FROM resolved""",
    "spn_2": "SELECT doc_id, ord, start_block, end_block, local_start, local_end FROM resolved WHERE hit AND clamped",
    "spn_3": "SELECT doc_id, ord, CASE WHEN substring(line, local_start + 1, local_end - local_start) = value THEN 'offset' WHEN strpos(line, value) > 0 THEN 'direct' ELSE 'matcher_failed' END AS match_method FROM ground WHERE hit AND ai = bi",
    "spn_4": "SELECT doc_id, ord, box_no, block_id, page, x0, y0, x1, y1 FROM boxes",
    "spn_5": "SELECT c.doc_id, c.ord, CAST(row_number() OVER (PARTITION BY c.doc_id, c.ord ORDER BY c.idx) - 1 AS INTEGER) AS box_no, c.block_id, b.page, b.x0, b.y0, b.x1, b.y1, c.broken FROM repeated_chosen c JOIN last_block b ON b.doc_id = c.doc_id AND b.block_id = c.block_id",
    "spn_6": "SELECT b.doc_id, b.ord, b.box_no, b.page, b.x0, h.height - b.y1 AS y0, b.x1, h.height - b.y0 AS y1 FROM boxes b JOIN heights h ON h.doc_id = b.doc_id AND h.page = b.page WHERE b.seq % 5 <> 0",
    "reg_1": r"SELECT path, CASE WHEN path LIKE '%.yml' THEN 'bad_extension' WHEN NOT regexp_full_match(path, '[^/]+/[^/]+\.yaml') THEN 'stray' END AS problem FROM files",
    "reg_2": "SELECT path, problem FROM row_problems",
    "reg_3": "SELECT path, problem FROM schema_problems",
    "reg_4": "SELECT path, example_no, place, rule FROM example_problems",
    "reg_5": "SELECT path, kept_path FROM duplicates",
    "reg_6": "SELECT count(*) AS n_problems, count(DISTINCT path) AS n_files, count(*) > 0 AS refused, (SELECT count(*) = 0 FROM files) AS empty FROM problems",
    "reg_6_problems": "SELECT path, problem FROM problems",
    "reg_7": "SELECT name, version FROM newest",
    "reg_8": "SELECT doc_id, skill_name, skill_version, version, code FROM asked",
    "reg_9": "SELECT path, coalesce(ocr, 'auto') AS ocr, coalesce(table_mode, 'accurate') AS table_mode, coalesce(ocr, 'auto') NOT IN ('auto', 'force', 'off') AS bad FROM skills",
    "asm_1": "SELECT doc_id, 'STRUCTURED_OUTPUT_FAILED' AS code FROM failed",
    "asm_2": "SELECT f.doc_id, a.skill_name, a.version AS skill_version, f.field_name, f.value, f.status, f.source, f.grounded, CAST(CASE WHEN f.grounded THEN 1 ELSE 0 END AS BIGINT) AS n_boxes FROM fields f JOIN asked a ON a.doc_id = f.doc_id WHERE a.code IS NULL",
    "asm_3": "SELECT f.doc_id, d.page_count, f.field_name, f.attempts FROM fields f JOIN docs d ON d.doc_id = f.doc_id",
    "asm_4": "SELECT r.skill_name, r.skill_version, count(*) FILTER (status = 'extracted') AS n_extracted, count(*) FILTER (status = 'failed') AS n_failed FROM fields f JOIN requests r ON r.doc_id = f.doc_id GROUP BY ALL",
    "asm_5": "SELECT doc_id, code FROM errs",
    "asm_6": """SELECT doc_id, array_to_string(list_filter([CASE WHEN length(skill_name) > 6 THEN 'body -> skill_name=too_long' END, CASE WHEN skill_version IN ('abc', '0') THEN 'body -> skill_version=string_pattern_mismatch' END], lambda x: x IS NOT NULL), ';') AS details
        FROM requests WHERE length(skill_name) > 6 OR skill_version IN ('abc', '0')""",
    "log_1": "SELECT event_id, event_type AS event, '[REDACTED_EMAIL] failed on line 1234 with [REDACTED_NUMBER]' || repeat('!', 941) || '... [truncated]' AS exception, unnest(['user', 'note', 'event']) AS key, unnest([CAST(user_id AS VARCHAR), repeat('x', CAST(event_id % 700 AS INTEGER)), 'inner']) AS value FROM events",
    "log_2": "SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '... [truncated]' ELSE text END) AS text_digest, '<bytes len=' || strlen(text) || ' truncated>' AS bytes FROM documents",
    "log_4": f"SELECT doc_id, md5('line 1234: ' || {_numbers('text')}) AS digest FROM documents",
    "log_5": f"""SELECT doc_id, md5(t) AS digest, length(t) AS n, CAST(len(regexp_extract_all(t, '\\[REDACTED_EMAIL\\]')) AS BIGINT) AS n_emails, CAST(len(regexp_extract_all(t, '\\[REDACTED_NUMBER\\]')) AS BIGINT) AS n_numbers
        FROM (SELECT doc_id, 'X-Request-Id: ' || lpad(CAST(doc_id AS VARCHAR), 32, '1') || ' account [REDACTED_NUMBER] ' || {_numbers(f"regexp_replace(text, '{_EMAIL}', '[REDACTED_EMAIL]', 'g')")} AS t FROM documents)""",
    "log_3": f"SELECT doc_id, md5(regexp_replace(text, '{_EMAIL}', '[REDACTED_EMAIL]', 'g')) AS digest FROM documents",
    "log_6": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN md5(CAST(event_id AS VARCHAR)) ELSE CASE WHEN event_id % 3 = 1 AND regexp_full_match(upper(md5(CAST(event_id AS VARCHAR))), '[a-f0-9]{32}') THEN upper(md5(CAST(event_id AS VARCHAR))) ELSE md5(event_id || ':' || event_type) END END AS request_id FROM events",
    "log_7": """SELECT status, CASE WHEN status >= 500 THEN 'warning' ELSE 'info' END AS level, count(*) AS n, CAST(sum(CAST(round_even(value, 2) AS DECIMAL(18, 2))) AS DOUBLE) AS total_ms FROM (
        SELECT value, CAST(CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 2 = 0 THEN 503 ELSE 500 END WHEN event_type = 'view' THEN 200 ELSE 400 + user_id % 150 END AS INTEGER) AS status FROM events) GROUP BY ALL""",
    "ben_1": "SELECT fixture, mode, quantile_cont(seconds, 0.5) AS p50, quantile_cont(seconds, 0.95) AS p95 FROM lat GROUP BY ALL",
    "ben_2": "SELECT fixture, mode, iter, seconds FROM lat QUALIFY row_number() OVER (PARTITION BY fixture, mode ORDER BY iter) > 2",
    "ben_3": "SELECT g.fixture, g.mode, round(avg(w.seconds), 6) AS mean, quantile_cont(w.seconds, 0.5) AS p50, quantile_cont(w.seconds, 0.95) AS p95, count(w.seconds) AS n FROM (SELECT DISTINCT fixture, m.mode FROM warm, (SELECT unnest(['JSON_ONLY', 'PDF_ONLY', 'BOTH', 'NONE']) AS mode) m) g LEFT JOIN warm w ON w.fixture = g.fixture AND w.mode = g.mode GROUP BY ALL",
    "ben_4": "SELECT fixture, metric, value, target, value <= target AS passes FROM (SELECT fixture, unnest(['p50', 'p95']) AS metric, unnest([quantile_cont(seconds, 0.5), quantile_cont(seconds, 0.95)]) AS value FROM warm WHERE mode = 'JSON_ONLY' GROUP BY fixture) JOIN (VALUES ('fixture0', 'p50', 7.0::DOUBLE), ('fixture0', 'p95', 30.0::DOUBLE), ('fixture1', 'p50', 8.0::DOUBLE), ('fixture1', 'p95', 31.0::DOUBLE)) t(fixture, metric, target) USING (fixture, metric)",
    "ben_5": "SELECT fixture, round(o, 6) AS overhead, o <= 2 AS passes FROM (SELECT fixture, quantile_cont(seconds, 0.5) FILTER (mode = 'PDF_ONLY') - quantile_cont(seconds, 0.5) FILTER (mode = 'JSON_ONLY') AS o FROM lat GROUP BY fixture) WHERE o IS NOT NULL",
    "ben_6": "SELECT DISTINCT user_id AS fixture FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 40 AND user_id % 3 <> 0)",
    "ben_7": "SELECT field_name, round(e, 6) AS extracted_rate, round(g, 6) AS grounded_rate, e >= 0.9 AS extracted_ok, g >= 0.95 AS grounded_ok FROM (SELECT field_name, avg(CASE WHEN status = 'extracted' THEN 1.0 ELSE 0 END)::DOUBLE AS e, avg(CASE WHEN grounded THEN 1.0 ELSE 0 END) FILTER (status = 'extracted')::DOUBLE AS g FROM fields GROUP BY field_name)",
    "con_1": """SELECT code, problem FROM (SELECT code, unnest(list_concat(list_concat([CASE WHEN NOT regexp_full_match(code, '[A-Z][A-Z0-9_]*') THEN 'bad_code' END, CASE WHEN http_status NOT BETWEEN 400 AND 599 THEN 'bad_status' END],
        list_transform(params, lambda x: CASE WHEN NOT regexp_full_match(x.name, '[a-zA-Z_][a-zA-Z0-9_]*') THEN 'bad_param:' || x.name END)), list_transform(params, lambda x: CASE WHEN x.type NOT IN ('string', 'integer', 'number', 'boolean') THEN 'bad_type:' || x.name END))) AS problem FROM part_params) WHERE problem IS NOT NULL""",
    "con_2": "SELECT code, array_to_string(params, ',') AS params FROM required",
    "con_3": """SELECT lang, key, unnest(CASE WHEN text IS NULL THEN ['missing_key'] WHEN code IS NULL THEN ['extra_key'] WHEN trim(text, ' ' || chr(9) || chr(10) || chr(8195)) = '' THEN ['empty'] ELSE list_concat(list_transform(list_filter(params, lambda x: NOT list_contains(used, x)), lambda x: 'missing_param:' || x),
        list_transform(list_filter(used, lambda x: NOT list_contains(params, x)), lambda x: 'undefined_param:' || x)) END) AS problem FROM compared UNION ALL SELECT 'fr', NULL, 'missing_language'""",
    "con_4": "SELECT * FROM (SELECT coalesce(was.path, now.path) AS path, CASE WHEN now.path IS NULL THEN 'missing' WHEN was.path IS NULL THEN 'extra' WHEN was.text <> now.text THEN 'differs' END AS drift FROM was FULL JOIN now ON now.path = was.path) WHERE drift IS NOT NULL",
    "str_1": "SELECT doc_id, field_pos, field_name, value, status, source, grounded, attempts FROM fields",
    "str_2_ttl": """SELECT * FROM (WITH RECURSIVE o AS (SELECT user_id AS key, ts, event_id AS seq, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
        n AS (SELECT a.key, a.rn, min(b.rn) AS nx FROM o a JOIN o b ON b.key = a.key AND b.rn > a.rn AND b.ts >= a.ts + INTERVAL 3600 SECOND GROUP BY ALL),
        w AS (SELECT key, rn FROM o WHERE rn = 1 UNION ALL SELECT n.key, n.nx FROM w JOIN n ON n.key = w.key AND n.rn = w.rn),
        c AS (SELECT o.key, o.seq, o.ok, lag(o.ok) OVER (PARTITION BY o.key ORDER BY o.rn) AS prev FROM o JOIN w ON w.key = o.key AND w.rn = o.rn)
        SELECT key, seq, CASE WHEN ok THEN 'recovered' ELSE 'became_unreachable' END AS event FROM c WHERE ok <> prev)""",
    "str_2": "SELECT key, seq, CASE WHEN ok THEN 'recovered' ELSE 'became_unreachable' END AS event FROM checks WHERE ok <> prev",
    "run": """SELECT f.doc_id, f.field_pos, f.field_name, f.status, f.source, f.grounded, b.page, b.x0, b.y0, b.x1, b.y1 FROM fields f
        LEFT JOIN (SELECT o.doc_id, o.idx, k.page, k.x0, k.y0, k.x1, k.y1 FROM line_offsets o JOIN blocks k ON k.doc_id = o.doc_id AND k.seq = o.idx WHERE o.start < o."end") b ON f.grounded AND b.doc_id = f.doc_id AND b.idx BETWEEN f.ai AND f.bi
        WHERE f.doc_id NOT IN (SELECT doc_id FROM errs)""",
}

_SELECTS["str_2_stream"] = _SELECTS["str_2_ttl"]


def _with(select: str) -> str:
    names: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in names and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(CTES[name])
                names.append(name)

    need(select)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in names)} {select}" if names else select


ORACLE_SQL = {name: _with(select) for name, select in _SELECTS.items()}
