"""Inputs of the pipeline derived from the driver's tables: each rule is the same in Spark here and in SQL in ``plans/oracle.py``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT = 792.0


class Prepared(str):
    """A folder of tables; ``frames`` has some of them, or of the inputs derived from them (by their functions' names), in their place."""

    frames: dict[str, DataFrame] = {}


def prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``f``, or what ``Prepared`` has in its place."""

    @functools.wraps(f)
    def got(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = sf_dir.frames if isinstance(sf_dir, Prepared) else {}
        return frames[f.__name__] if f.__name__ in frames else f(spark, sf_dir)

    return got


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frames = sf_dir.frames if isinstance(sf_dir, Prepared) else {}
    return frames[name] if name in frames else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(c: Column | str, n: int) -> Column:
    return F.pmod(F.col(c) if isinstance(c, str) else c, F.lit(n))


@prepared
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line of a document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("seq", "line"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text items: every seventh is empty, some have no provenance, some two; origins differ by document."""
    slot = _mod("seq", 10)
    top = F.col("doc_id") % 2 == 0
    t = F.when(top, 72.0 + 12.0 * slot).otherwise(HEIGHT - 72.0 - 12.0 * slot)
    b = F.when(top, t + 10.0).otherwise(t - 10.0)
    origin = F.when(top, F.lit("CoordOrigin.TOPLEFT")).when(F.col("doc_id") % 10 != 1, F.lit("CoordOrigin.BOTTOMLEFT"))
    prov = lambda shift: F.struct((F.floor(F.col("seq") / 10) + 1 + shift).cast("int").alias("page"), F.lit(72.0).alias("l"), t.alias("t"), F.lit(540.0).alias("r"), b.alias("b"), origin.alias("coord_origin"))
    both = F.col("doc_id") + F.col("seq")
    provs = F.when(_mod(F.col("doc_id") * 3 + F.col("seq"), 13) == 0, F.slice(F.array(prov(0)), 1, 0)).when(_mod(both, 5) == 0, F.array(prov(0), prov(1))).otherwise(F.array(prov(0)))
    return lines(spark, sf_dir).select("doc_id", "seq", F.when(_mod(both, 7) == 0, F.lit("")).otherwise(F.col("line")).alias("text"), provs.alias("provs"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height of each page; the second page of some documents is unknown."""
    pages = lines(spark, sf_dir).select("doc_id", (F.floor(F.col("seq") / 10) + 1).cast("int").alias("page")).distinct()
    return pages.where(~((F.col("doc_id") % 17 == 0) & (F.col("page") == 2))).withColumn("height", F.lit(HEIGHT))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with empty ones kept, so that some have no width."""
    return blocks_and_lines(spark, sf_dir).drop("line")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose texts, joined by line breaks, are the document."""
    return blocks_and_lines(spark, sf_dir).drop("text").withColumnRenamed("line", "text")


@prepared
def blocks_and_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with both: ``text``, which is empty here and there, and the whole ``line``."""
    slot = _mod("seq", 10)
    page = (F.floor(F.col("seq") / 10) + 1).cast("int")
    y1 = HEIGHT - 72.0 - 12.0 * slot
    return lines(spark, sf_dir).select(
        "doc_id",
        "seq",
        F.concat(F.lit("p"), page.cast("string"), F.lit("_b"), slot.cast("string")).alias("block_id"),
        page.alias("page"),
        F.when(_mod(F.col("doc_id") + F.col("seq"), 7) == 0, F.lit("")).otherwise(F.col("line")).alias("text"),
        "line",
        F.struct(F.lit(72.0).alias("x0"), (y1 - 10.0).alias("y0"), F.lit(540.0).alias("x1"), y1.alias("y1")).alias("bbox"),
    )


@prepared
def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with sizes and page counts; a few are flagged as what a preflight would refuse. A null text has no bytes and no pages."""
    pages = lines(spark, sf_dir).groupBy("doc_id").agg((F.floor(F.max("seq") / 10) + 1).cast("int").alias("page_count"))
    zero = F.lit(0)
    return table(spark, sf_dir, "documents").join(pages, "doc_id", "left").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), zero).alias("n_bytes"), F.coalesce("page_count", zero).alias("page_count"), (F.col("doc_id") % 41 != 0).alias("is_valid"), (F.col("doc_id") % 43 == 0).alias("is_encrypted")
    )


def raw_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten spans a document, placed by arithmetic; some values are null, some are not grounded."""
    text_length = blocks(spark, sf_dir).groupBy("doc_id").agg((F.sum(F.length("text") + 2) - 2).alias("len"))
    k = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ord")
    spans = text_length.select("doc_id", "len", k).withColumn("start", F.pmod(F.col("doc_id") * 7919 + F.col("ord") * 101, F.col("len") + 50))
    spans = spans.withColumn("end", F.col("start") + 1 + _mod(F.col("doc_id") * 31 + F.col("ord"), 40))
    which = F.col("doc_id") + F.col("ord")
    off = _mod(which, 13) == 0
    return spans.select(
        "doc_id",
        "ord",
        F.concat(F.lit("f"), F.col("ord").cast("string")).alias("field_name"),
        F.when(_mod(which, 11) != 0, F.concat(F.lit("v"), which.cast("string"))).alias("value"),
        F.when(~off, F.col("start")).alias("start"),
        F.when(~off, F.col("end")).alias("end"),
        (~off).alias("grounded"),
        F.lit(1).alias("attempts"),
    )


@prepared
def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extractor says of each document: its first line twice, the first long number, an undeclared field, a null value,
    with broken intervals here and there."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = F.element_at(F.split("text", "\n", -1), 1)
    number = F.regexp_extract("text", "[0-9]{4,}", 0)
    rows = d.select("doc_id", F.inline(F.array(
        _raw(0, "first_line", first, F.lit(0), F.length(first)),
        _raw(1, "junk", F.lit("x"), F.lit(0), F.lit(1)),
        _raw(2, "first_line", F.lit("again"), F.lit(3), F.lit(8)),
        _raw(3, "number", F.when(number != "", number), F.when(number != "", F.call_function("locate", number, F.col("text")) - 1), F.when(number != "", F.call_function("locate", number, F.col("text")) - 1 + F.length(number))),
    )))
    broken = _mod(F.col("doc_id") + F.col("ord"), 9)
    start = F.when(broken == 1, F.lit(-4)).otherwise(F.col("start"))
    end = F.when(broken == 2, F.col("start")).otherwise(F.col("end"))
    return rows.where(~((F.col("field_name") == "number") & F.col("value").isNull() & (F.col("doc_id") % 2 == 0))).select(
        "doc_id", "ord", "field_name", "value", start.alias("start"), end.alias("end"), (_mod("doc_id", 4) + 1).cast("int").alias("attempts")
    )


def _raw(order: int, name: str, value: Column, start: Column, end: Column) -> Column:
    return F.struct(F.lit(order).alias("ord"), F.lit(name).alias("field_name"), value.alias("value"), start.cast("int").alias("start"), end.cast("int").alias("end"))


#: Output schemas of the registry, as skills give them.
SCHEMA_DOC = '{"type":"object","properties":{"number":{"type":"string"},"first_line":{"type":"string"},"email":{"type":"string"}}}'
SCHEMA_INVOICE = '{"type":"object","required":["total"],"properties":{"total":{"type":"string"},"kind":{"enum":["a","b"]}}}'
#: Faulty ones: composition at the root, no property, additionalProperties only, a type that permits an object.
SCHEMA_FAULTS = ('{"$ref":"#/x","anyOf":[],"properties":{"a":{}}}', '{"type":"object","properties":{}}', '{"type":"object","additionalProperties":true}', '{"type":["object","null"]}')
#: One with lists of objects, and examples that keep to it or break it in many places.
SCHEMA_NESTED = '{"type":"object","required":["items"],"properties":{"items":{"type":"array","minItems":1,"items":{"type":"object","required":["sku"],"properties":{"sku":{"type":"string","maxLength":4},"count":{"type":"integer","minimum":1},"flag":{"enum":[1,"yes"]}}}},"total":{"type":["number","null"]}}}'
NESTED_EXAMPLES = (
    '{"items":[{"sku":"A1","count":2.0,"flag":1},{"sku":"B2","flag":"yes"}],"total":12.5}',
    '{"items":[{"sku":"A12345","count":0,"flag":true},{"count":"2","flag":"no"},{"sku":7,"count":1.5,"flag":1.0}],"total":"12"}',
    '{"items":[]}',
    '{"total":true}',
)


@prepared
def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry with a file for each supplier: name by nation, version by key, and faults here and there."""
    k = F.col("s_suppkey").cast("long")
    name = F.concat(F.lit("skill"), F.col("s_nationkey").cast("string"))
    stem = F.when(k % 23 == 0, F.concat(F.lit("0"), k.cast("string"))).when(k % 29 == 0, F.lit("one")).otherwise(k.cast("string"))
    ext = F.when(k % 31 == 0, F.lit(".yml")).otherwise(F.lit(".yaml"))
    folder = F.when(k % 37 == 0, F.lit("Other")).otherwise(name)
    path = F.when(k % 41 == 0, F.concat(stem, ext)).when(k % 47 == 0, F.concat(folder, F.lit("/deep/"), stem, ext)).otherwise(F.concat(folder, F.lit("/"), stem, ext))
    schema = F.when(k % 5 == 0, F.lit(SCHEMA_INVOICE)).when(k % 5 == 2, F.lit(SCHEMA_NESTED))
    for i, fault in enumerate(SCHEMA_FAULTS):
        schema = schema.when(k % 20 == 2 * i + 1, F.lit(fault))
    example = F.when(k % 10 == 0, F.lit('{"kind":"c"}')).when(k % 5 == 0, F.lit('{"total":"12","kind":"a"}')).when(k % 5 == 2, F.element_at(F.array(*map(F.lit, NESTED_EXAMPLES[:2])), (k % 2 + 1).cast("int"))).otherwise(F.lit('{"number":"12"}'))
    second = F.when(k % 15 == 0, F.lit('{"total":12}')).when(k % 5 == 2, F.element_at(F.array(*map(F.lit, NESTED_EXAMPLES[2:])), (k % 2 + 1).cast("int"))).otherwise(F.lit("{}"))
    shown = lambda output: F.struct(F.concat(F.lit("input "), k.cast("string")).alias("input"), output.alias("output"))
    rows = table(spark, sf_dir, "supplier").select(
        path.alias("path"),
        F.when(k % 53 == 0, F.upper(name)).otherwise(name).alias("name"),
        F.when(k % 59 == 0, F.lit(0)).otherwise(k).cast("int").alias("version"),
        F.when(k % 61 == 0, F.lit("")).otherwise(F.concat(F.lit("Read "), k.cast("string"))).alias("prompt"),
        k.alias("k"),
        schema.otherwise(F.lit(SCHEMA_DOC)).alias("output_schema"),
        F.when(k % 71 == 0, F.slice(F.array(shown(example)), 1, 0)).otherwise(F.array(shown(example), shown(second))).alias("examples"),
        F.when(k % 3 == 0, F.lit("force")).when(k % 73 == 0, F.lit("maybe")).alias("ocr"),
        F.when(k % 4 == 0, F.lit("fast")).alias("table_mode"),
        F.array().cast("array<struct<place:string,rule:string>>").alias("shape"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("stored"),
    )
    again = rows.where(_mod("version", 12) == 0).withColumn("path", F.concat(F.lit(""), F.regexp_replace("path", "/", "/00")))
    return rows.unionByName(again)


def skill_files(spark: SparkSession, sf_dir: str, first: Column | None = None) -> DataFrame:
    """The registry as files (path, content): six of eleven are broken, no mapping, have a key twice, a version that is a text, no
    prompt and examples, or keys that nobody knows. Of suppliers that come to one path the first as they are stored has the
    file, as in SQL's choice without an order; where ``first``, a condition on ``skills``, holds for some of them, the first of those."""
    c = F.col("k") % 11
    text = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    example = lambda e, i: F.concat(F.lit('{"input":"'), e["input"], F.lit('","output":'), e["output"], F.when((c == 6) & (i == 0), F.lit(',"note":1')).otherwise(F.lit("")), F.lit("}"))
    settings = F.concat_ws(",", text("ocr", F.col("ocr")), text("table_mode", F.col("table_mode")), F.when(c == 6, F.lit('"speed":1')))
    parts = F.concat_ws(
        ",",
        text("name", F.col("name")),
        F.concat(F.lit('"version":'), F.when(c == 4, F.concat(F.lit('"v'), F.col("k").cast("string"), F.lit('"'))).otherwise(F.col("version").cast("string"))),
        F.when(c != 5, text("prompt", F.col("prompt"))),
        F.when(c == 3, text("prompt", F.lit("again"))),
        F.when(c != 5, F.concat(F.lit('"examples":['), F.array_join(F.transform("examples", example), ","), F.lit("]"))),
        F.concat(F.lit('"output_schema":'), F.col("output_schema")),
        F.when(settings != "", F.concat(F.lit('"docling":{'), settings, F.lit("}"))),
        F.when(c == 6, F.lit('"extra":true')),
    )
    content = F.when(c == 2, F.lit("[1]")).otherwise(F.concat(F.lit("{"), parts, F.when(c == 1, F.lit("")).otherwise(F.lit("}\n"))))
    return skills(spark, sf_dir).groupBy("path").agg(F.min_by(content, F.struct((F.lit(False) if first is None else ~first).alias("last"), "stored")).alias("content"))


@prepared
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a document."""
    m = F.col("doc_id") % 8
    version = F.when(m == 0, F.lit("latest")).when(m == 1, F.lit("999999")).when(m == 2, F.lit("abc")).when(m == 3, F.lit("0")).when(m == 4, F.lit("latest")).otherwise((F.col("doc_id") % 10 + 1).cast("string"))
    mode = F.element_at(F.array(F.lit("JSON_ONLY"), F.lit("PDF_ONLY"), F.lit("BOTH")), (F.col("doc_id") % 3 + 1).cast("int"))
    name = F.when(m == 4, F.lit("nothing")).otherwise(F.concat(F.lit("skill"), (F.col("doc_id") % 25).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("skill_name"), version.alias("skill_version"), mode.alias("output_mode"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five replies of a model for each document."""
    k = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("attempt")
    rows = table(spark, sf_dir, "documents").select("doc_id", k)
    m = _mod(F.col("doc_id") + F.col("attempt"), 8)
    d = F.col("doc_id").cast("string")
    good = F.concat(F.lit('{"extractions":[{"id":"'), d, F.lit('","id_attributes":{}},{"n":'), d, F.lit(',"n_attributes":{"a":1}},{"id":"again"}]}'))
    text = (
        F.when(m == 0, good)
        .when(m == 1, F.concat(F.lit("  ```json\n"), good, F.lit("\n```\n")))
        .when(m == 2, F.concat(F.lit("Here it is: "), good))
        .when(m == 3, F.lit('{"extractions":[{"id":'))
        .when(m == 4, F.lit('{"results":[]}'))
        .when(m == 5, F.lit("I cannot say."))
        .when(m == 6, F.lit('{"extractions":{"id":"x"}}'))
        .otherwise(F.concat(F.lit("```JSON\n"), F.lit('{"extractions":"none"}'), F.lit("```")))
    )
    return rows.select("doc_id", "attempt", text.alias("raw_text"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("event_type") == "view", "JSON_ONLY").when(F.col("event_type") == "click", "PDF_ONLY").when(F.col("event_type") == "purchase", "BOTH")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("fixture"), (F.col("user_id") % 3).cast("string")).alias("fixture"), mode.alias("mode"), F.col("event_id").alias("iter"), F.col("value").alias("seconds"))
    return rows.where("mode is not null")


def log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log events with attributes, some of them to be removed or cut."""
    attrs = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("Prompt"), F.lit("secret"), F.lit("RAW_output"), F.col("props"), F.lit("note"), F.repeat(F.lit("x"), (F.col("event_id") % 700).cast("int")), F.lit("event"), F.lit("inner"))
    status = F.when(F.col("event_type") == "error", F.lit(None).cast("int")).when(F.col("event_type") == "view", F.lit(200)).otherwise((F.lit(400) + F.col("user_id") % 150).cast("int"))
    error = F.when((F.col("event_type") == "error") & (F.col("user_id") % 2 == 0), F.lit(503))
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("event_type").alias("event"), attrs.alias("attrs"), status.alias("response_status"), error.alias("error_status"), F.col("value").alias("duration_ms"),
        F.when(F.col("event_id") % 3 == 0, F.md5(F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.upper(F.md5(F.col("event_id").cast("string")))).alias("request_id"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))


def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message contract with a key for each part, a few of them faulty."""
    k = F.col("p_partkey").cast("long")
    params = F.array_compact(F.array(F.when(k % 2 == 0, F.struct(F.lit("size").alias("name"), F.when(k % 22 == 0, F.lit("text")).otherwise(F.lit("integer")).alias("type"))), F.when(k % 3 == 0, F.struct(F.when(k % 33 == 0, F.lit("bad-name")).otherwise(F.lit("label")).alias("name"), F.lit("string").alias("type")))))
    code = F.when(k % 19 == 0, F.concat(F.lit("part_"), k.cast("string"))).otherwise(F.concat(F.lit("PART_"), k.cast("string")))
    return table(spark, sf_dir, "part").select(code.alias("code"), (F.lit(390) + k % 220).cast("int").alias("http_status"), params.alias("params"))


def locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations of the contract's keys in two languages, with faults."""
    k = F.col("p_partkey").cast("long")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.explode(F.array(F.lit("en"), F.lit("de"))).alias("lang"))
    k = F.col("k") + F.when(F.col("lang") == "de", F.lit(1)).otherwise(F.lit(0))
    own = F.col("k")
    text = F.when(k % 34 == 0, F.lit("\t\n\u2003")).when(k % 17 == 0, F.lit(" ")).when(k % 31 == 0, F.lit("Text {{größe}}")).otherwise(F.concat(F.lit("Text"), F.when((own % 2 == 0) & (k % 13 != 0), F.lit(" {{size}}")).otherwise(F.lit("")), F.when((own % 3 == 0) | (k % 11 == 0), F.lit(" {{label}} {{label}}")).otherwise(F.lit(""))))
    key = F.when(own % 19 == 0, F.concat(F.lit("part_"), own.cast("string"))).when(k % 23 == 0, F.concat(F.lit("EXTRA_"), own.cast("string"))).otherwise(F.concat(F.lit("PART_"), own.cast("string")))
    return rows.where(k % 29 != 0).select("lang", key.alias("key"), text.alias("text"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of documents' pages, paragraphs and lines (doc_id, node, parent, ordinal), for two of three documents; children are
    numbered backwards here and there, and stored in no order."""
    rows = lines(spark, sf_dir).where("doc_id % 3 <> 0").select("doc_id", "seq", F.floor(F.col("seq") / 10).alias("page"), F.floor(F.col("seq") % 10 / 3).alias("part"))
    page, part = F.concat(F.lit("p"), F.col("page").cast("string")), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("g"), F.col("part").cast("string"))
    back = lambda some, number: F.when(some, 1_000_000 - F.col(number)).otherwise(F.col(number))
    node = lambda node, parent, ordinal: F.struct(node.alias("node"), parent.alias("parent"), ordinal.cast("long").alias("ordinal"))
    root = node(F.lit("d"), F.lit(None).cast("string"), F.lit(0))
    pages, parts = node(page, F.lit("d"), back(F.col("doc_id") % 3 == 2, "page")), node(part, page, back(F.col("page") % 2 == 1, "part"))
    leaves = node(F.concat(F.lit("l"), F.col("seq").cast("string")), part, back(F.col("doc_id") % 2 == 1, "seq"))
    return rows.select("doc_id", F.inline(F.array(leaves, parts, pages, root))).distinct()


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as they should be, and with some gone, some changed and some added."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text", "doc_id")
    expected = d.select("path", F.col("text").alias("content"))
    actual = d.where("doc_id % 10 <> 0").select("path", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    extra = d.where("doc_id % 13 = 0").select(F.concat(F.lit("new/"), F.col("path")).alias("path"), F.col("text").alias("content"))
    return expected, actual.unionByName(extra)
