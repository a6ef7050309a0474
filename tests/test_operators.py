"""Literal cases of the operators."""

import collections
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions import redaction, text
from paperloom.operators import assemble, blocks, contracts, fields, grounding, latency, offsets, registry, replies
from paperloom.streaming import arrival, probes

BLOCKS = "doc_id long, seq int, block_id string, page int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
RAW = "doc_id long, ord int, field_name string, value string, start int, end int, grounded boolean, attempts int"
BOX = (0.0, 0.0, 100.0, 20.0)


def _blocks(spark, *rows):
    return spark.createDataFrame([(1, i, b, p, t, BOX) for i, (b, p, t) in enumerate(rows)], BLOCKS)


def _index(spark, *rows):
    return spark.createDataFrame([(1, i, a, b, k) for i, (a, b, k) in enumerate(rows)], "doc_id long, idx int, start long, end long, block_id string")


def _resolve(spark, blks, index, start, end, value="v", grounded=True):
    raw = spark.createDataFrame([(1, 0, "f", value, start, end, grounded, 1)], RAW)
    found = grounding.spans(raw, index)
    row = found.first()
    boxed = grounding.boxes(found, index, blks).orderBy("box_no").collect()
    return row, [(b["block_id"], b["page"]) for b in boxed], [b["broken"] for b in boxed]


THREE = (("b0", 1, "hello"), ("b1", 1, "worl"), ("b2", 1, "three"))
INDEX = ((0, 5, "b0"), (7, 11, "b1"), (13, 18, "b2"))


@pytest.mark.parametrize(
    ("start", "end", "source", "reason", "boxes"),
    [
        (0, 5, "document", None, ["b0"]),
        (2, 15, "document", None, ["b0", "b1", "b2"]),
        (6, 10, "inferred", "hallucinated_offsets", []),
        (3, 99_999, "inferred", "hallucinated_offsets", []),
        (4, 7, "document", "clamped", ["b0"]),
        (14, 20, "inferred", "hallucinated_offsets", []),
    ],
)
def test_spans(spark, start, end, source, reason, boxes):
    row, found, _ = _resolve(spark, _blocks(spark, *THREE), _index(spark, *INDEX), start, end)
    assert (row["source"], row["reason"], [b for b, _ in found]) == (source, reason, boxes)


def test_null_and_empty_values(spark):
    blks, index = _blocks(spark, *THREE), _index(spark, *INDEX)
    row, found, _ = _resolve(spark, blks, index, 0, 5, value=None)
    assert (row["status"], row["source"], row["grounded"], found) == ("failed", "document", False, [])
    row, found, _ = _resolve(spark, blks, index, 0, 5, value="")
    assert (row["status"], row["grounded"], len(found)) == ("extracted", True, 1)


def test_span_over_pages_and_empty_blocks(spark):
    blks = _blocks(spark, ("a", 2, "x" * 15), ("e", 2, ""), ("b", 3, "y" * 16))
    _, found, _ = _resolve(spark, blks, offsets.offset_index(blks), 5, 25)
    assert found == [("a", 2), ("b", 3)]


def test_repeated_ids_and_broken_index(spark):
    blks = _blocks(spark, ("a", 1, "aaaaa"), ("b", 1, "bbbbb"), ("a", 2, "ccccc"))
    index = offsets.offset_index(blks)
    _, found, _ = _resolve(spark, blks, index, 0, 10)
    assert found == [("a", 2), ("b", 1)]
    _, found, _ = _resolve(spark, blks, index, 8, 17)
    assert found == [("b", 1), ("a", 2)]
    late = index.where("idx > 0")
    found = grounding.spans(spark.createDataFrame([(1, 0, "f", "v", 8, 17, True, 1)], RAW), index)
    moved = late.withColumn("idx", F.when(F.col("block_id") == "a", 0).otherwise(F.col("idx")))
    assert [(b["block_id"], b["broken"]) for b in grounding.boxes(found, moved, blks).collect()] == [("b", "end_block_seen_before_start_block")]


def test_long_documents_cross_stretches(spark):
    blks = _blocks(spark, ("a", 1, "x" * 10_000), ("b", 1, "y" * 5_000))
    index = offsets.offset_index(blks)
    points = spark.createDataFrame([(1, k, o) for k, o in enumerate((0, 9_999, 10_000, 10_002, 15_001, 15_002, -1))], "doc_id long, ord int, offset long")
    found = {r["ord"]: (r["block_id"], r["local"]) for r in offsets.lookup(points, index).collect()}
    assert found == {0: ("a", 0), 1: ("a", 9_999), 2: (None, None), 3: ("b", 0), 4: ("b", 4_999), 5: (None, None), 6: (None, None)}


def test_slices_of_text(spark):
    blks = _blocks(spark, ("a", 1, "a😀é"), ("b", 1, ""), ("c", 1, "end"))
    whole = offsets.concatenated(blks).first()["full_text"]
    assert whole == "a😀é\n\n\n\nend"
    for r in offsets.offset_index(blks).join(blks, "block_id").collect():
        assert whole[r["start"] : r["end"]] == r["text"]
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert {r["doc_id"]: r["full_text"] for r in offsets.concatenated(blks, docs).collect()}[2] == ""


@pytest.mark.parametrize(
    ("block", "value", "method", "start", "end"),
    [
        ("Total: $1,847.50 due", "$1,847.50", "direct", 7, 16),
        ("a    b", "a b", "whitespace", 0, 6),
        ("x a  b", "a b", "whitespace", 2, 6),
        ("ﬁnal score", "final score", "nfkc", 0, 10),
        ("n ＡＢ z", "AB", "nfkc", 2, 4),
        ("été", "ét", "nfkc", 0, 3),
        ("abc", "", "direct", 0, 0),
        ("", "abc", None, None, None),
        ("abc", "zzz", None, None, None),
        ("abc", " ", None, None, None),
    ],
)
def test_matcher(spark, block, value, method, start, end):
    row = text.match(spark.createDataFrame([(block, value)], "text string, value string")).first()
    assert (row["match_method"], row["match_start"], row["match_end"]) == (method, start, end)


def test_composition_maps_every_character():
    for s in ("é̂x", "ﬃ", "한", "ạ̇"):
        out, origins = text._compose(s)
        assert len(out) == len(origins)
        assert all(0 <= o < len(s) for o in origins)
        assert unicodedata.normalize("NFKC", out) == unicodedata.normalize("NFKC", s)


def test_origin_is_flipped(spark):
    prov = "page int, l double, t double, r double, b double, coord_origin string"
    items = spark.createDataFrame([(1, 0, "x", (1, 10.0, 100.0, 80.0, 300.0, "CoordOrigin.TOPLEFT")), (1, 1, "y", (1, 10.0, 900.0, 80.0, 700.0, None)), (1, 2, "z", (9, 0.0, 1.0, 2.0, 3.0, "TOPLEFT"))], f"doc_id long, seq int, text string, prov struct<{prov}>")
    rows = blocks.bottom_left(items, spark.createDataFrame([(1, 1, 1000.0)], "doc_id long, page int, height double")).orderBy("seq").collect()
    assert [(r["bbox"]["y0"], r["bbox"]["y1"], r["known"]) for r in rows] == [(700.0, 900.0, True), (700.0, 900.0, True), (None, None, False)]


REPLIES = [
    ('{"extractions":[]}', None),
    ('```json\n{"extractions":[]}\n```', None),
    ('```{"extractions":[]}', None),
    ('Sure: {"extractions":[]} as asked', None),
    ("no braces", "no_json_object"),
    ('{"extractions":', "json_parse_error"),
    ('{"other":1}', "schema_violation:$"),
    ('{"extractions":{}}', "schema_violation:$.extractions"),
    ("", "no_json_object"),
]


def test_replies(spark):
    rows = replies.judged(spark.createDataFrame([(i, 1, t) for i, (t, _) in enumerate(REPLIES)], "doc_id long, attempt int, raw_text string")).orderBy("doc_id").collect()
    assert [r["cause"] for r in rows] == [c for _, c in REPLIES]


def test_first_valid_attempt(spark):
    texts = ["x", '{"a":1}', '{"extractions":[1]}', '{"extractions":[]}']
    rows = [(1, k + 1, t) for k, t in enumerate(texts)] + [(2, k + 1, "x") for k in range(4)] + [(2, 5, texts[-1])]
    got = {r["doc_id"]: r for r in replies.first_valid(replies.judged(spark.createDataFrame(rows, "doc_id long, attempt int, raw_text string"))).collect()}
    assert (got[1]["attempt"], got[1]["causes"], got[1]["code"]) == (3, "no_json_object;schema_violation:$", None)
    assert (got[2]["attempt"], got[2]["code"]) == (None, "STRUCTURED_OUTPUT_FAILED")


def test_envelope_is_flattened(spark):
    text_ = '{"extractions":[{"name":"Alice","name_attributes":{}},{"age":30,"age_attributes":{}},{"x":null}]}'
    rows = replies.flattened(replies.judged(spark.createDataFrame([(1, 1, text_)], "doc_id long, attempt int, raw_text string")))
    assert [(r["ord"], r["field_name"], r["value"]) for r in rows.orderBy("ord").collect()] == [(0, "name", "Alice"), (1, "age", "30"), (2, "x", None)]


def test_retries_ask_again_only_for_invalid(spark, tmp_path):
    def predict(frames):
        for f in frames:
            f["raw_text"] = ['{"extractions":[]}' if a > d else "no" for d, a in zip(f["doc_id"], f["attempt"], strict=True)]
            yield f[["doc_id", "attempt", "raw_text"]]

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    prompts = spark.createDataFrame([(d, "ask", "t") for d in (0, 1, 2, 9)], "doc_id long, prompt string, text string")
    rows = replies.infer_with_retries(prompts, predict, write)
    assert {(r["doc_id"], r["attempt"]) for r in rows.where("cause is null").collect()} == {(0, 1), (1, 2), (2, 3)}
    assert rows.count() == 1 + 2 + 3 + 4


def test_rounds_go_on_where_they_stopped(spark, tmp_path):
    """A run that fails in its second round asks no question of the first again."""
    from paperloom.sources import files

    (tmp_path / "asked").mkdir()

    def predict(frames, folder=str(tmp_path)):
        import os
        import uuid

        for f in frames:
            for d, a in zip(f["doc_id"], f["attempt"], strict=True):
                open(f"{folder}/asked/{a}-{d}-{uuid.uuid4().hex}", "w").close()
                if a == 2 and not os.path.exists(f"{folder}/up"):
                    raise ConnectionError("the model is down")
            f["raw_text"] = ['{"extractions":[]}' if a > d else "no" for d, a in zip(f["doc_id"], f["attempt"], strict=True)]
            yield f[["doc_id", "attempt", "raw_text"]]

    prompts = spark.createDataFrame([(d, "ask", "t") for d in (0, 1, 2)], "doc_id long, prompt string, text string")
    with pytest.raises(Exception, match="the model is down"):
        replies.infer_with_retries(prompts, predict, files.keeper(spark, f"file://{tmp_path}/rounds"))
    (tmp_path / "up").touch()
    rows = replies.infer_with_retries(prompts, predict, files.keeper(spark, f"file://{tmp_path}/rounds"))
    assert {(r["doc_id"], r["attempt"]) for r in rows.where("cause is null").collect()} == {(0, 1), (1, 2), (2, 3)}
    asked = collections.Counter(f.name[:3] for f in (tmp_path / "asked").iterdir())
    assert {k: n for k, n in asked.items() if k[0] != "2"} == {"1-0": 1, "1-1": 1, "1-2": 1, "3-2": 1}
    assert rows.count() == 6


def test_fields(spark):
    raw = spark.createDataFrame([(1, 0, "a", "x", None, 3, True, 1), (1, 1, "a", "y", 0, 3, True, 1), (1, 2, "b", "z", 5, 5, True, 1), (1, 3, "c", "w", 1, 4, True, 1)], RAW)
    firsts = fields.first_arrival(raw)
    assert sorted(r["value"] for r in firsts.collect()) == ["w", "x", "z"]
    sane = {r["ord"]: (r["start"], r["end"], r["grounded"]) for r in fields.sane_intervals(raw).collect()}
    assert sane == {0: (None, None, False), 1: (0, 3, True), 2: (None, None, False), 3: (1, 4, True)}
    assert fields.violations(fields.sane_intervals(raw)).isEmpty()
    skills = spark.createDataFrame([("s", 1, '{"properties":{"z":{},"a":{}}}'), ("t", 1, "{}")], "name string, version int, output_schema string")
    assert [(r["field_pos"], r["field_name"]) for r in fields.declared(skills).orderBy("field_pos").collect()] == [(0, "z"), (1, "a")]


def test_columns_are_kept_whatever_their_names(spark):
    raw = spark.createDataFrame([(1, 0, "f", "b", 1, 2, "a", "b", 3, "r")], "doc_id long, ord int, field_name string, value string, start int, end int, _n string, n string, at int, row string")
    assert tuple(fields.first_arrival(raw).first()) == (1, 0, "f", "b", 1, 2, "a", "b", 3, "r")
    index = spark.createDataFrame([(1, 0, 0, 9, "b")], "doc_id long, idx int, start long, end long, block_id string")
    points = spark.createDataFrame([(1, 4, "x", "y", "z", "s", "o")], "doc_id long, offset long, _at string, own string, of string, stretch string, row string")
    assert tuple(offsets.lookup(points, index).first()) == (1, 4, "x", "y", "z", "s", "o", "b", 4)


def test_lookup_of_skills(spark):
    skills = spark.createDataFrame([("a", 1), ("a", 3)], "name string, version int")
    asked = spark.createDataFrame([(i, n, v) for i, (n, v) in enumerate([("a", "latest"), ("a", "1"), ("a", "2"), ("b", "latest"), ("a", "0"), ("a", "01"), ("a", "99999999999")])], "doc_id long, skill_name string, skill_version string")
    rows = registry.lookup(asked, skills).orderBy("doc_id").collect()
    assert [(r["version"], r["code"]) for r in rows] == [(3, None), (1, None), (None, "SKILL_NOT_FOUND"), (None, "SKILL_NOT_FOUND"), (None, "VALIDATION_FAILED"), (None, "VALIDATION_FAILED"), (None, "SKILL_NOT_FOUND")]


def test_earliest_gate_wins(spark):
    a = spark.createDataFrame([(1, "PDF_TOO_MANY_PAGES"), (2, "PDF_INVALID")], "doc_id long, code string")
    b = spark.createDataFrame([(1, "SKILL_NOT_FOUND")], "doc_id long, code string")
    rows = assemble.error_rows(assemble.first_errors(a, b), assemble.catalogue(spark)).orderBy("doc_id").collect()
    assert [(r["code"], r["http_status"]) for r in rows] == [("SKILL_NOT_FOUND", 404), ("PDF_INVALID", 400)]


REDACTED = [
    ("mail a.b@c.org now", "mail [REDACTED_EMAIL] now"),
    ("paid $1,847.50 at line 1234", "paid $[REDACTED_NUMBER] at line 1234"),
    ("v3.13 took 0.5 of 999", "v3.13 took 0.5 of 999"),
    ("request_id=" + "1" * 32 + " n " + "2" * 32, "request_id=" + "1" * 32 + " n [REDACTED_NUMBER]"),
    ("X-REQUEST-ID: " + "12345678" * 4, "X-REQUEST-ID: " + "12345678" * 4),
    ("١٢٣٤", "[REDACTED_NUMBER]"),
]


def test_redaction(spark):
    rows = spark.createDataFrame(list(REDACTED), "given string, want string").select(redaction.exception_text(F.col("given")).alias("got"), "want").collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_nested_keys_are_removed(spark):
    df = spark.sql("select 'x' as event, named_struct('Prompt', 'p', 'keep', array(map('RAW_OUTPUT', 'a', 'b', repeat('c', 501)))) as data, unhex(repeat('00', 501)) as blob")
    row = redaction.scrubbed_table(df).first()
    assert row["data"].asDict(True) == {"keep": [{"b": "c" * 500 + "... [truncated]"}]}
    assert row["blob"] == "<bytes len=501 truncated>"


def test_percentiles(spark):
    rng = random.Random(5)
    cells = {("a", "m"): [float(i) for i in range(1, 11)], ("b", "m"): [3.0], ("b", None): [rng.choice([1.5, 2.5, rng.random() * 1e6]) for _ in range(2_000)], ("c", "n"): [None], ("d", "n"): [7.0] * 500 + [8.0]}
    df = spark.createDataFrame([(f, m, v, "x") for (f, m), vs in cells.items() for v in vs], "fixture string, mode string, seconds double, v string").repartition(5)
    got = {(r["fixture"], r["mode"]): (r["p50"], r["p95"], r["low"]) for r in latency.percentiles(df, {"p50": 50, "p95": 95, "low": 0}).collect()}
    assert set(got) == set(cells) - {("c", "n")}
    for cell, values in got.items():
        assert values == pytest.approx(np.percentile(cells[cell], [50, 95, 0]).tolist(), rel=1e-12)
    assert latency.percentiles(df.limit(0), {"p50": 50}).isEmpty()


def test_warmup_goes_by_iteration(spark):
    df = spark.createDataFrame([("a", "m", i, float(i)) for i in (5, 3, 3, 9, 7)] + [("b", "m", 1, 1.0)], "fixture string, mode string, iter long, seconds double")
    assert sorted(r["iter"] for r in latency.without_warmup(df, 2).collect()) == [7, 9]
    assert latency.without_warmup(df, 0).count() == 6 and latency.without_warmup(df.limit(0)).isEmpty()


def test_latency_has_no_task_for_a_group(spark):
    df = spark.range(1_000).selectExpr("'a' fixture", "'m' mode", "id iter", "rand(1) seconds")
    for plan in (latency.percentiles(df, {"p50": 50}), latency.without_warmup(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "percentile(" not in text
    assert "WindowGroupLimit" in latency.without_warmup(df)._jdf.queryExecution().executedPlan().toString()


def test_exceptions_are_redacted_before_they_are_cut(spark):
    df = spark.createDataFrame([("e", "a@b.org saw 12345 " + "x" * 600, "a@b.org 12345")], "event string, exception string, other string")
    row = redaction.scrubbed_table(df).first()
    whole = "[REDACTED_EMAIL] saw [REDACTED_NUMBER] " + "x" * 600
    assert row["exception"] == whole[:500] + redaction.CUT and row["other"] == "a@b.org 12345"


def test_translations_and_drift(spark):
    required = spark.createDataFrame([("A", ["x"]), ("B", []), ("C", [])], "code string, params array<string>")
    given = spark.createDataFrame([("en", "A", "{{y}}"), ("en", "B", "  "), ("en", "D", "d")], "lang string, key string, text string")
    rows = {(r["key"], r["problem"]) for r in contracts.translation_problems(required, given).collect()}
    assert rows == {("A", "missing_param:x"), ("A", "undefined_param:y"), ("B", "empty"), ("C", "missing_key"), ("D", "extra_key")}
    required = spark.createDataFrame([("A", ["größe", "x_1"]), ("B", []), ("C", []), ("D", [])], "code string, params array<string>")
    given = spark.createDataFrame([("de", "A", "{{größe}} {{x_1}} {{ y }} {z}"), ("de", "B", "\t\n\u2003\x1c"), ("de", "C", None), ("en", "D", "{{数}}")], "lang string, key string, text string")
    rows = {(r["lang"], r["key"], r["problem"]) for r in contracts.translation_problems(required, given, ("de", "en", "fr", "it")).collect()}
    assert rows == {("de", "B", "empty"), ("de", "C", "empty"), ("de", "D", "missing_key"), *(("en", k, "missing_key") for k in "ABC"), ("en", "D", "undefined_param:数"), ("fr", None, "missing_language"), ("it", None, "missing_language")}
    assert {r["problem"] for r in contracts.translation_problems(required, given.limit(0), ("de",)).collect()} == {"missing_language"}
    one = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    two = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string")
    assert {(r["path"], r["drift"]) for r in contracts.drift(one, two).collect()} == {("b", "differs"), ("c", "missing"), ("d", "extra")}


def _walk(checks, ttl):
    out, last, state = [], None, False
    for t, ok in checks:
        if last is not None and t - last < ttl:
            continue
        if last is not None and ok != state:
            out.append((t, "recovered" if ok else "became_unreachable"))
        last, state = t, ok
    return out


def plain_range(text, value, normal):
    """Where ``value`` is in ``text`` in a normal form, by way of a list of (character, where it comes from)."""

    def mapped(t):
        out = []
        i = 0
        while i < len(t):
            j = i + 1
            while normal == "nfkc" and j < len(t) and unicodedata.category(t[j]).startswith("M"):
                j += 1
            part = unicodedata.normalize("NFKC", t[i:j]) if normal == "nfkc" else t[i:j]
            out += [(c, min(i + k, j - 1)) for k, c in enumerate(part)]
            i = j
        return [(" ", at) if c.isspace() else (c, at) for k, (c, at) in enumerate(out) if not (c.isspace() and k and out[k - 1][0].isspace())]

    one, other = mapped(text), "".join(c for c, _ in mapped(value))
    at = "".join(c for c, _ in one).find(other) if other else -1
    if at < 0:
        return None
    past = at + len(other)
    return one[at][1], one[past][1] if past < len(one) else len(text)


def plain_match(text, value):
    if value is not None and text is not None and (at := text.find(value)) >= 0:
        return "direct", at, at + len(value)
    for normal in ("whitespace", "nfkc"):
        if text and value is not None and (found := plain_range(text, value, normal)):
            return normal, *found
    return None, None, None


def test_matches_of_a_whole_table(spark):
    """Each line of all documents, in the forms that the queries give them and in odd ones, as a plain version has it."""
    from paperloom.plans.queries import _spaced, _values

    d = "/root/testdata/sf0.001"
    seq = F.col("seq")
    odd = F.when(seq % 4 == 1, F.regexp_replace("text", " ", "  ")).when(seq % 4 == 2, F.regexp_replace("text", "a", "ａ")).when(seq % 4 == 3, F.regexp_replace(F.regexp_replace("text", "e", "e\u0301"), " ", "\u2003\n")).otherwise(F.regexp_replace("text", "fi", "ﬁ"))
    rows = _values(spark, d).withColumn("text", odd).unionByName(_spaced(spark, d)).withColumn("match_end", F.lit(0)).drop("match_end")
    more = [("a \t b", "a b"), ("a\x1cb", "a b"), ("  a", " a"), ("a  ", "a "), ("a  b  c", "b c"), ("½ x", "1⁄2 x"), ("x\u0301", "x"), ("  ", " "), ("", "a"), ("a", ""), (None, "a"), ("a", None), ("😀  y", "😀 y"), ("x\xa0y", "x y"), ("ab\u2003\u2003cd", "b c"), ("fi", "ﬁ"), ("Ａ", "A")]
    rows = rows.select("text", "value").unionByName(spark.createDataFrame(more, "text string, value string"))
    got = text.match(rows).collect()
    assert len({r["match_method"] for r in got}) == 4
    for r in got:
        assert (r["match_method"], r["match_start"], r["match_end"]) == plain_match(r["text"], r["value"]), (r["text"], r["value"])


def saved(tmp_path):
    """Writes tables to places of their own and reads them back."""
    import uuid

    def write(df, name):
        path = f"{tmp_path}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    return write


def test_probes(spark, tmp_path):
    random.seed(5)
    checks = {k: sorted((random.randrange(10_000), random.random() < 0.6) for _ in range(60)) for k in (*range(7), None)}
    checks[8] = [(t, t % 3 > 0) for t in range(0, 20_000, 7)]  # a key with most of the rows
    checks[9] = [(5, True), (50_000, False), (50_001, True), (50_499, True), (50_500, True), (200_000, True), (200_500, False)]
    rows = [(k, t, i, ok) for k, of in checks.items() for i, (t, ok) in enumerate(of)]
    df = spark.createDataFrame(rows, "key long, t long, seq long, ok boolean").select("key", F.timestamp_seconds("t").alias("ts"), "seq", "ok")
    for ttl in (0, 500, 3):
        want = {(k, t, e) for k, of in checks.items() for t, e in _walk(of, ttl)}
        got = probes.transitions_with_ttl(df, ttl, saved(tmp_path)).select("key", F.unix_timestamp("ts"), "event").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    zero = {(k, t, e) for k, of in checks.items() for t, e in _walk(of, 0)}
    assert {tuple(r) for r in probes.transitions(df).select("key", F.unix_timestamp("ts"), "event").collect()} == zero
    odd = spark.createDataFrame([(1, 0, 0, True), (1, 10, 1, None), (1, 10, 1, True), (1, None, 2, True), (1, 20, None, True)], "key long, t long, seq long, ok boolean").select("key", F.timestamp_seconds("t").alias("ts"), "seq", "ok")
    assert [(r["seq"], r["event"]) for r in probes.transitions_with_ttl(odd, 5.0, saved(tmp_path)).orderBy("ts").collect()] == [(1, "became_unreachable"), (None, "recovered")]
    assert probes.transitions_with_ttl(odd.limit(0), 5.0, saved(tmp_path)).isEmpty()
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    df.where("seq < 30").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = session.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*")
    for part in ("a", "b"):
        if part == "b":
            df.where("seq >= 30").coalesce(1).write.parquet(f"{tmp_path}/in/b")
        probes.stream_transitions(stream, 500).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select("key", F.unix_timestamp("ts"), "event").collect()
    assert {tuple(r) for r in got} == {(k, t, e) for k, of in checks.items() for t, e in _walk(of, 500)}


def plain_preorder(nodes):
    """Numbers and levels by a walk."""
    import sys

    sys.setrecursionlimit(20_000)
    out = {}
    for doc in {n[0] for n in nodes}:
        own = {n[1] for n in nodes if n[0] == doc}
        kids = collections.defaultdict(list)
        for d, node, parent, ordinal in nodes:
            if d == doc:
                kids[parent if parent in own else None].append((ordinal is not None, ordinal or 0, node))
        seq = 0
        stack = [(n, 0) for *_, n in sorted(kids[None], reverse=True)]
        while stack:
            node, level = stack.pop()
            out[doc, node] = (seq, level)
            seq += 1
            stack += [(n, level + 1) for *_, n in sorted(kids[node], reverse=True)]
        out |= {(doc, n): (None, None) for n in own if (doc, n) not in out}
    return out


def test_reading_order_of_trees(spark, tmp_path):
    from paperloom.operators import trees

    rng = random.Random(7)
    nodes = [(1, i, i - 1 if i else None, 0) for i in range(700)]  # a path
    nodes += [(2, i, 0 if i else None, rng.randrange(50)) for i in range(300)]  # a root with many children, ties among them
    nodes += [(3, i, rng.randrange(i) if i else None, rng.choice((None, 1, 2, 3))) for i in range(200)]
    nodes += [(4, 0, None, 1), (4, 1, None, 0), (4, 2, 99, 2), (4, 3, 2, 0), (4, 4, 5, 0), (4, 5, 4, 0), (4, 6, 5, 0), (4, 7, 7, 0)]  # roots, an orphan, circles
    nodes += [(5, 0, 3, 0), (5, 3, 0, 0), (None, 0, None, 0), (None, 1, 0, 0)]
    rng.shuffle(nodes)
    table = spark.createDataFrame([(*n, 1, 2) for n in nodes], "doc_id long, node long, parent long, ordinal int, seq int, level int")
    got = {(r["doc_id"], r["node"]): (r["seq"], r["level"]) for r in trees.preorder(table, saved(tmp_path)).collect()}
    assert got == plain_preorder([n for n in nodes if n[0] is not None])
    assert trees.preorder(table.limit(0), saved(tmp_path)).isEmpty()
    twice = spark.createDataFrame([(1, 0, None, 0), (1, 1, 0, 5), (1, 1, 0, 3), (1, 2, 0, 4), (1, None, 0, 1)], "doc_id long, node long, parent long, ordinal int")
    assert sorted(map(tuple, trees.preorder(twice, saved(tmp_path)).collect())) == [(1, 0, 0, 0), (1, 1, 1, 1), (1, 2, 2, 1)]


def test_arrivals_are_processed_once(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    run = lambda batch: batch.selectExpr("doc_id", "doc_id * 2 as twice")
    for part in ("doc_id < 5", "doc_id >= 5"):
        df.where(part).write.mode("append").parquet(src)
        arrival.process(spark, src, df.schema, run, out, check)
    rows = spark.read.parquet(f"{out}/batch=*").collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(10))


def test_pipeline_partitions_documents(spark, tmp_path):
    from paperloom.plans import queries

    data = "/root/testdata/sf0.001"
    t = queries.tables(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
    alive, dead = t["fields"].select("doc_id").distinct(), t["errors"].select("doc_id")
    assert alive.intersect(dead).isEmpty()
    assert alive.union(dead).distinct().count() == docs.count() == alive.count() + dead.count()
    assert t["fields"].count() == alive.count() * len(queries.DECLARED)
    out = f"{tmp_path}/out"
    for batch in (1, 2, 1):
        assemble.write(out, batch, t["responses"], t["fields"], t["highlights"], t["errors"])
    got = {name: assemble.read(spark, out, name, t[name].schema) for name in assemble.SINKS}
    assert got["errors"].groupBy("batch").count().orderBy("batch").collect() == [(1, dead.count()), (2, dead.count())]
    assert got["fields"].where("batch = 1").drop("batch").exceptAll(t["fields"].select(got["fields"].drop("batch").columns)).isEmpty()
    assert got["fields"].count() == 2 * t["fields"].count()
    assert got["responses"].where("output_mode = 'PDF_ONLY'").isEmpty() and not got["responses"].isEmpty()
    assert got["responses"].where("batch = 2").select(F.explode("fields").alias("name", "f")).select("name", "f.*").schema.names == ["name", "value", "status", "source", "grounded", "bbox_refs"]
    asked = got["fields"].where("batch = 1 and status = 'failed'")._jdf.queryExecution()
    asked.toRdd().count()
    plan = asked.executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "status" in plan.split("PartitionFilters")[1].split("]")[0] and "PushedFilters: []" in plan
    none = {name: t[name].limit(0) for name in t}
    assemble.write(out, 1, none["responses"], none["fields"], none["highlights"], none["errors"])
    assert [(r["batch"], r["count"]) for r in assemble.read(spark, out, "errors", t["errors"].schema).groupBy("batch").count().collect()] == [(2, dead.count())]


def test_refused_files_are_not_read(spark, tmp_path):
    from paperloom.sources import files

    files.write_files(spark.range(5).selectExpr("concat('in/', id) as path", "repeat('x', cast(10 * id + 1 as int)) as content"), str(tmp_path))
    kept, refused = files.read_documents(spark, f"{tmp_path}/in", 21)
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,21)]" in kept._jdf.queryExecution().executedPlan().toString()
    schema = refused._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1]
    assert "content" not in schema
    assert (kept.count(), refused.count()) == (3, 2)
    (tmp_path / "in" / "4").chmod(0)  # what is refused is listed, never opened
    assert sorted(r["n_bytes"] for r in kept.collect()) == [1, 11, 21] and sorted(r["actual_bytes"] for r in refused.collect()) == [31, 41]


def test_null_texts_reach_the_gates(spark, tmp_path):
    import os

    from paperloom.plans.queries import QUERIES

    data = "/root/testdata/sf0.001"
    os.symlink(f"{data}/supplier.parquet", f"{tmp_path}/supplier.parquet")
    docs = spark.createDataFrame([(8, "some words"), (5, None), (6, None), (41, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    get = lambda name: {r["doc_id"]: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert {i for i, r in get("blk_8").items() if r["code"] == "PDF_NO_TEXT_EXTRACTABLE"} == {5, 6, 41}
    assert {i: r["n_bytes"] for i, r in get("src_1").items()} == {5: 0, 6: 0, 8: 10, 41: 0}
    errors = get("asm_5")
    assert {5, 6, 41} <= set(errors) and set(errors) == set(get("snk_2"))
    assert sum(r["n"] for r in QUERIES["src_3"](spark, str(tmp_path)).collect()) == len(errors)


def test_empty_tables(spark):
    blks = spark.createDataFrame([], BLOCKS)
    index = offsets.offset_index(blks)
    raw = spark.createDataFrame([], RAW)
    found = grounding.spans(raw, index)
    assert found.isEmpty() and grounding.boxes(found, index, blks).isEmpty() and offsets.concatenated(blks).isEmpty()


def test_files(spark, tmp_path):
    from paperloom.sources import files

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a").write_bytes(b"x" * 10)
    (tmp_path / "docs" / "b").write_bytes(b"x" * 11)
    kept, refused = files.read_documents(spark, str(tmp_path / "docs"), 10)
    assert [(r["n_bytes"], bytes(r["content"])) for r in kept.collect()] == [(10, b"x" * 10)]
    assert [(r["max_bytes"], r["actual_bytes"]) for r in refused.collect()] == [(10, 11)]


def written_skill(folder, path, text=None, **changes):
    """A sound skill but for ``changes``; a change to None takes the key out."""
    import json

    body = {"name": "inv", "version": 1, "prompt": "p", "examples": [{"input": "i", "output": {"a": "x"}}], "output_schema": {"type": "object", "properties": {"b": {}, "a": {"type": "string"}}}} | changes
    file = folder / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps({k: v for k, v in body.items() if v is not None}, indent=1) if text is None else text)


def test_registry_is_read_as_it_is(spark, tmp_path):
    """Every fault of a file is a row of problems, and sound files have none."""
    from paperloom.sources import files

    root = tmp_path / "skills"
    written_skill(root, "inv/1.yaml", description="d", docling={"ocr": "off"})
    written_skill(root, "inv/02.yaml", version=2.0, docling=None)
    written_skill(root, "a b+c/1.yaml", name="a b+c")
    written_skill(root, "stray.yaml")
    written_skill(root, "inv/deep/1.yaml")
    written_skill(root, "inv/3.yml")
    written_skill(root, "inv/README.md", "not a skill")
    written_skill(root, "broken/1.yaml", ": : {not yaml :")
    written_skill(root, "broken/2.yaml", "[1]")
    written_skill(root, "broken/3.yaml", '{"name":"broken","name":"broken"}')
    written_skill(root, "broken/4.yaml", "\n")
    written_skill(root, "inv/5.yaml", version=4)
    written_skill(root, "inv/001.yaml")
    written_skill(root, "other/1.yaml", examples=[], prompt="")
    written_skill(root, "kinds/1.yaml", name=7, version="1", prompt=None, examples=[{"input": 1, "output": [], "note": 0}], output_schema="{}", docling={"ocr": 1, "speed": 2}, extra=None, more=True)
    written_skill(root, "inv/6.yaml", version=6, examples=[{"input": "i", "output": {"a": 1}}, {"input": "i", "output": {"a": "x", "c": [1]}}])
    skills = files.read_registry(spark, str(root)).cache()
    got = collections.defaultdict(set)
    for r in registry.problems(skills).collect():
        assert r["problem"] not in got[r["path"]]
        got[r["path"]].add(r["problem"])
    assert got == {
        "a b+c/1.yaml": {"name_not_a_slug"},
        "stray.yaml": {"stray"},
        "inv/deep/1.yaml": {"stray"},
        "inv/3.yml": {"bad_extension"},
        "broken/1.yaml": {"$: json"},
        "broken/2.yaml": {"$: type"},
        "broken/3.yaml": {"$: json"},
        "broken/4.yaml": {"$: json"},
        "inv/5.yaml": {"stem_is_not_version"},
        "inv/1.yaml": {"duplicate of inv/001.yaml"},
        "other/1.yaml": {"folder_is_not_name", "no_examples", "prompt_empty", "duplicate of inv/001.yaml"},
        "kinds/1.yaml": {"$: required:prompt", "$: unknown:more", "$.name: type", "$.version: type", "$.examples[0]: unknown:note", "$.examples[0].input: type", "$.examples[0].output: type", "$.output_schema: type", "$.docling: unknown:speed", "$.docling.ocr: type"},
        "inv/6.yaml": {"example 0: $.a: type"},
    }
    rows = {r["path"]: r for r in skills.collect()}
    one, two = rows["inv/1.yaml"], rows["inv/02.yaml"]
    assert (one["name"], one["version"], one["description"], one["prompt"], one["ocr"], one["table_mode"], one["output_schema"]) == ("inv", 1, "d", "p", "off", None, '{"type":"object","properties":{"b":{},"a":{"type":"string"}}}')
    assert [tuple(e) for e in one["examples"]] == [("i", '{"a":"x"}')] and two["version"] == 2
    assert len(rows) == 15


def test_registry_folders(spark, tmp_path):
    from paperloom.sources import files

    (tmp_path / "none").mkdir()
    none = files.read_registry(spark, str(tmp_path / "none"))
    assert registry.report(registry.problems(none), none).first()["empty"]
    with pytest.raises(Exception, match="gone"):
        files.read_registry(spark, str(tmp_path / "gone")).count()
    rows = spark.createDataFrame([("a b/1.yaml", "x", 1), ("c/d/e", None, 2)], "path string, content string, n int")
    files.write_files(rows, f"file://{tmp_path}/out")
    files.write_files(rows, f"{tmp_path}/out")
    assert (tmp_path / "out/a b/1.yaml").read_text() == "x" and (tmp_path / "out/c/d/e").read_text() == ""


SCHEMAS = [
    ({"type": "object", "required": ["a"]}, [({"a": None}, []), ({}, [("$", "required:a")]), ([], [("$", "type")]), (None, [("$", "type")])]),
    ({"required": ["a"], "minItems": 2, "minLength": 2, "minimum": 2}, [([1], [("$", "minItems")]), ("x", [("$", "minLength")]), (1, [("$", "minimum")]), (True, []), (None, []), ({"a": 1}, [])]),
    ({"type": "integer"}, [(1, []), (1.0, []), (1e3, []), (1.5, [("$", "type")]), (True, [("$", "type")]), ("1", [("$", "type")]), (12345678901234567890123, [])]),
    ({"type": ["number", "null"], "maximum": 3}, [(1, []), (2.5, []), (None, []), (False, [("$", "type")]), (4, [("$", "maximum")])]),
    ({"enum": [1, "x", None, [1], {"a": 1}]}, [(1, []), (1.0, []), (True, [("$", "enum")]), ("x", []), (None, []), ([1], []), ({"a": 1}, []), ("1", [("$", "enum")]), (0, [("$", "enum")])]),
    ({"const": False}, [(False, []), (0, [("$", "const")])]),
    ({"const": None}, [(None, []), (0, [("$", "const")])]),
    ({"properties": {"a": False, "b": True}, "additionalProperties": {"type": "string"}}, [({"a": 1, "b": 1, "c": 1, "d": "x"}, [("$.a", "false"), ("$.c", "type")])]),
    ({"properties": {"a": {"items": {"items": {"type": "string", "maxLength": 1}}, "maxItems": 1}}, "additionalProperties": False}, [({"a": [["x", "yy", 1]]}, [("$.a[0][1]", "maxLength"), ("$.a[0][2]", "type")]), ({"a": [[], []], "b": 1}, [("$", "unknown:b"), ("$.a", "maxItems")]), (["x"], [])]),
    ({"type": "object", "properties": {"a.b": {"type": "string"}, "é ": {"type": "null"}}}, [({"a.b": 1, "é ": 1}, [("$.a.b", "type"), ("$.é ", "type")])]),
    ({}, [(1, []), ({"a": [1]}, [])]),
    ("no schema", [(1, [])]),
    (True, [(1, [])]),
    (False, [(1, [("$", "false")])]),
]


def test_values_are_held_against_schemas(spark):
    import json

    from paperloom.operators import json_schema

    cases = [(i, k, json.dumps(schema), json.dumps(value)) for i, (schema, values) in enumerate(SCHEMAS) for k, (value, _) in enumerate(values)]
    rows = spark.createDataFrame([(*c, 1, 2, 3) for c in cases], "i int, k int, schema string, value string, row int, pairs int, found int")
    levels = json_schema.most_levels(rows, "schema")
    assert levels == max(json_schema.levels_of(c[2]) for c in cases) == 5
    got = json_schema.with_violations(rows, F.parse_json("value"), F.parse_json("schema"), levels)
    assert got.columns == [*rows.columns, "violations"]
    assert {(r["i"], r["k"]): [tuple(v) for v in r["violations"]] for r in got.collect()} == {(i, k): sorted(want) for i, (_, values) in enumerate(SCHEMAS) for k, (_, want) in enumerate(values)}
    nothing = rows.limit(0)
    assert json_schema.with_violations(nothing, F.parse_json("value"), F.parse_json("schema"), json_schema.most_levels(nothing, "schema")).isEmpty()


def test_json_is_decoded_like_python(spark):
    import json

    texts = ['{"a":1} tail', "x {\"a\":[1,{\"b\":null}]} }", '{"a":1', "{'a':1}", '{"a":"\\u00e9 \\n"}', '{"a":\n 1.50}', "{}", '{"a":"\t"}', "{a:1}", '[1] {"b":2}']
    rows = replies.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string").withColumn("attempt", F.lit(1))).select("doc_id", F.to_json("parsed").alias("j")).collect()
    for r in rows:
        try:
            want = json.JSONDecoder().raw_decode(texts[r["doc_id"]][texts[r["doc_id"]].find("{") :])[0]
        except ValueError:
            want = None
        assert (json.loads(r["j"]) if r["j"] else None) == want, texts[r["doc_id"]]


def test_examples_are_held_against_any_schema(spark):
    nested = '{"type":"object","required":["a"],"properties":{"a":{"type":"array","items":{"type":["integer","null"]}},"b":{"enum":[1,"x",null]},"c":{"type":"boolean"},"n":{"type":"number"}}}'
    cases = [
        (nested, '{"a":[1,null,"x",true],"b":"x","c":true,"n":1.0}', ["$.a[2]", "$.a[3]"]),
        (nested, '{"a":[1.0,1e2],"b":true}', ["$.b"]),
        (nested, '{"b":2,"c":0,"n":false}', ["$", "$.b", "$.c", "$.n"]),
        (nested, "[]", ["$"]),
        (nested, "{", ["$"]),
        (nested, None, ["$"]),
        ('{"type":"string"}', '"x"', []),
        ('{"properties":{"a":{"type":"integer"}}}', '{"a":1.5}', ["$.a"]),
        ("not json", "{}", []),
        (None, "{}", []),
    ]
    rows = spark.createDataFrame([(f"s/{i + 1}.yaml", schema, [("i", example)]) for i, (schema, example, _) in enumerate(cases)], "path string, output_schema string, examples array<struct<input:string,output:string>>")
    got = sorted((r["path"], r["example_no"], r["place"]) for r in registry.example_problems(rows).collect())
    assert got == sorted((f"s/{i + 1}.yaml", 0, place) for i, (_, _, places) in enumerate(cases) for place in places)


def test_an_empty_registry_is_a_warning(spark):
    from paperloom.sources import derived

    skills = derived.skills(spark, "/root/testdata/sf0.001")
    row = registry.report(registry.problems(skills.limit(0)), skills.limit(0)).first()
    assert (row["n_problems"], row["refused"], row["empty"]) == (0, False, True)
    assert not registry.report(registry.problems(skills), skills).first()["empty"]


def test_ties_and_nulls(spark):
    rows = [(1, 0, "b", 1, "yy", BOX), (1, 0, "a", 1, "x", BOX), (1, 1, "c", 1, None, BOX), (1, 2, "d", 1, "z", BOX), (1, 2, "d", 1, "z", BOX)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, BLOCKS).repartition(parts)
        assert offsets.concatenated(df, separator="|").first()["full_text"] == "x|yy||z|z"
        index = [(r["start"], r["end"], r["block_id"]) for r in offsets.offset_index(df, "|").orderBy("idx").collect()]
        assert index == [(0, 1, "a"), (2, 4, "b"), (5, 5, "c"), (6, 7, "d"), (8, 9, "d")]
        raw = spark.createDataFrame([(1, 0, "f", "b", 1, 2, True, 1), (1, 0, "f", "a", 3, 4, True, 1), (None, 0, "f", None, None, None, True, 1)], RAW).repartition(parts)
        assert {(r["doc_id"], r["value"]) for r in fields.first_arrival(raw).collect()} == {(1, "a"), (None, None)}


def test_of_suppliers_with_one_path_the_first_has_the_file(spark, tmp_path):
    from paperloom.plans.queries import QUERIES

    spark.createDataFrame([(29, 7), (58, 7), (116, 7), (30, 7)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    rows = QUERIES["src_2"](spark, str(tmp_path)).select("path", "version", "prompt").collect()
    assert sorted(map(tuple, rows)) == [("skill7/30.yaml", 30, "Read 30"), ("skill7/one.yaml", 29, "Read 29")]


def test_composed_ranges_follow_the_definition_and_copy_what_does_not_change(monkeypatch):
    def plain(value):
        """Each character of the shortened NFKC form with its place in ``value``."""
        starts = [i for i, c in enumerate(value) if i == 0 or unicodedata.category(c)[0] != "M"]
        pairs = []
        for begin, end in zip(starts, [*starts[1:], len(value)], strict=True):
            pairs += [(c, min(begin + j, end - 1)) for j, c in enumerate(unicodedata.normalize("NFKC", value[begin:end]))]
        return [(" " if c.isspace() else c, i) for k, (c, i) in enumerate(pairs) if not c.isspace() or k == 0 or not pairs[k - 1][0].isspace()]

    pick, letters = random.Random(7), "ab ﬁé  \t\n\u0327\u0301é가\u1100\u1161ａ½\x1cか\u3099"
    for _ in range(3_000):
        whole, value = ("".join(pick.choice(letters) for _ in range(pick.randint(1, n))) for n in (14, 3))
        held, wanted = plain(whole), "".join(c for c, _ in plain(value))
        at = "".join(c for c, _ in held).find(wanted)
        places = [i for _, i in held] + [len(whole)]
        assert text._find(whole, value, text._compose) == ((places[at], places[at + len(wanted)]) if at >= 0 else None)
    calls = []
    monkeypatch.setattr(text, "unicodedata", type("Counted", (), {"category": unicodedata.category, "normalize": lambda form, part: calls.append(part) or unicodedata.normalize(form, part)}))
    assert text._find("plain \t words " * 50 + "ﬁne", "fine", text._compose) == (700, 703)
    assert calls == ["ﬁ"]


def test_small_trees_do_not_go_along_with_the_largest(spark, tmp_path):
    from paperloom.operators import trees

    nodes = [(d, f"n{i}", f"n{i - 1}" if i else None, 0) for d, n in [(0, 200), *((d, 2) for d in range(1, 51))] for i in range(n)]
    sizes = {}

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        sizes[name] = out.count()
        return out

    got = trees.preorder(spark.createDataFrame(nodes, "doc_id long, node string, parent string, ordinal long"), write).collect()
    assert sorted(map(tuple, got)) == sorted((d, f"n{i}", i, i) for d, n in [(0, 200), *((d, 2) for d in range(1, 51))] for i in range(n))
    assert sizes["tour4"] <= 400 < sizes["tour1"]


def test_tables_made_from_others_are_made_from_what_was_kept(spark):
    from paperloom.plans import queries

    names = []
    queries.tables(spark, "/root/testdata/sf0.001", lambda df, name: names.append(name) or df)
    assert names == ["errors", "spans", "boxes", "fields", "highlights", "responses"]


def test_arriving_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    from paperloom.plans import queries

    spark.range(64).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []

    def process(s, source, schema, run, sink, checkpoint, files_per_batch):
        seen.append((len(s.read.parquet(source).inputFiles()), files_per_batch))
        raise InterruptedError

    monkeypatch.setattr(arrival, "process", process)
    parts = spark.read.parquet(f"{tmp_path}/documents.parquet").rdd.getNumPartitions()
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        with pytest.raises(InterruptedError):
            queries.str_1(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts < 16 and seen == [(16, 8)]


def test_small_files_are_read_many_to_a_task(spark, tmp_path):
    from paperloom.sources import files

    rows = spark.range(600).selectExpr("concat(id div 100, '/', id, '.txt') as path", "cast(id as string) as content")
    files.write_files(rows, str(tmp_path))
    kept, refused = files.read_documents(spark, str(tmp_path), 2)
    assert kept.rdd.getNumPartitions() <= 6 and refused.rdd.getNumPartitions() <= 6
    assert sorted(bytes(r["content"]).decode() for r in kept.collect()) == sorted(str(i) for i in range(100))
    assert refused.count() == 500
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(64 << 10)


def test_the_driver_has_no_list_of_documents(spark, tmp_path):
    from paperloom.sources import files

    files.write_files(spark.range(600).selectExpr("concat(id div 100, '/', id, '.txt') as path", "cast(id as string) as content"), str(tmp_path))
    for found, n in zip(files.read_documents(spark, str(tmp_path), 2), (100, 500), strict=True):
        assert found.count() == n and len(found.inputFiles()) < 20


def test_documents_are_listed_as_by_spark(spark, tmp_path):
    from paperloom.sources import files

    root = tmp_path / "docs"
    for path in ("a.txt", "b/c/d/e", "b/_hidden", "b/.hidden", "b/_metadata", "b/x._COPYING_", "_none/f", "_k=v/f", "_metadata.d/f", ".git/f", "a b/100%25 #1+é.txt", "b/empty"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("" if path.endswith("empty") else path)
    (root / "nothing").mkdir()
    (root / "link").symlink_to(root / "b")
    rows = lambda df: sorted((r["path"], r["n_bytes"], bytes(r["content"])) for r in df.collect())
    seen = []
    for path in (root, f"file://{root}/", root / "*", root / "{a b,b}/*", root / "a.txt", root / "nothing", tmp_path / "{docs,docs/b,docs/_none}"):
        kept, refused = files.read_documents(spark, str(path))
        want = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(path))
        seen.append(rows(kept))
        assert seen[-1] == rows(want.withColumnRenamed("length", "n_bytes")) and refused.isEmpty()
    assert len(seen[0]) == 6 and len(seen[4]) == 1 and not seen[5] and len(seen[6]) == 7
    for path in (tmp_path / "gone", tmp_path / "gone*"):
        with pytest.raises(Exception, match="gone"):
            files.read_documents(spark, str(path))


def test_names_in_stores(monkeypatch):
    from paperloom.sources import files

    monkeypatch.setattr(files, "_opened", lambda store: (store, {"s3": "bucket", "hd": "/", "fi": "/"}[store[:2]]))
    assert files._stored("s3a://bucket/a b/c%20") == ("s3://bucket/", "bucket/a b/c%20")
    assert files._stored("hdfs://node:8020/a:b/c") == ("hdfs://node:8020/", "/a:b/c")
    assert files._stored("file:/a/b") == ("file:///", "/a/b")


def test_documents_in_a_store_that_only_spark_reads(spark, tmp_path):
    from paperloom.sources import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"abc")
    (tmp_path / "in" / "b").write_bytes(b"abcd")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tmp_path}/in")
    kept, refused = files.read_documents(spark, "viewfs://docs/in", 3)
    assert [bytes(r["content"]) for r in kept.collect()] == [b"abc"] and [r["actual_bytes"] for r in refused.collect()] == [4]


def test_documents_changed_since_they_were_listed(spark, tmp_path):
    from paperloom.sources import files

    (tmp_path / "a").write_bytes(b"abc")
    kept, _ = files.read_documents(spark, str(tmp_path), 3)
    (tmp_path / "a").write_bytes(b"abcd")
    with pytest.raises(Exception, match="changed since"):
        kept.collect()


def test_files_are_read_in_batches_of_some_bytes(spark, tmp_path):
    from paperloom.sources import files

    files.write_files(spark.range(5).selectExpr("cast(id as string) as path", "repeat('x', 5000000) as content"), str(tmp_path))
    files.write_files(spark.range(5, 8).selectExpr("cast(id as string) as path", "'x' as content"), str(tmp_path))
    paths = [(f"file:{tmp_path}/{i}", 5_000_000 if i < 5 else 1) for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*paths, strict=True)], ["path", "length"])
    assert [len(b) for b in files._contents(iter([batch, batch.slice(5)]))] == [2, 2, 7]


def test_health_asks_its_state_once():
    from paperloom.streaming import probes

    class State:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.value = value

    health = probes.Health(10.0)
    health.state = State()
    row = lambda at, ok: {"at": at * 1_000_000, "seq": at, "ok": ok, "ts": at}
    assert list(health.handleInputRows((1,), iter([row(5, False), row(0, True)]), None)) == []
    assert [(r["seq"], r["event"]) for r in health.handleInputRows((1,), iter([row(9, False), row(12, False), row(25, True)]), None)] == [(12, "became_unreachable"), (25, "recovered")]
    assert health.state.calls == 2
