"""Declared fields: one row for each of them and document, whatever the extractor says.

Defined results: rows without a doc_id or field name match nothing; of rows with one ``ord`` the least value comes first, nulls ahead;
repeated rows count once where one is chosen and are kept elsewhere; empty tables give no rows, or placeholders for what is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def declared(skills: DataFrame, keys: tuple[str, ...] = ("name", "version")) -> DataFrame:
    """``*keys, field_pos, field_name``: the keys of the output schema's top-level properties, in order."""
    names = F.json_object_keys(F.get_json_object("output_schema", "$.properties"))
    return skills.select(*keys, F.posexplode(names).alias("field_pos", "field_name"))


def drop_undeclared(raw: DataFrame, fields: DataFrame, on: tuple[str, ...] = ("field_name",)) -> DataFrame:
    return raw.join(fields.select(*on).distinct(), [*on], "left_semi")


def first_arrival(raw: DataFrame) -> DataFrame:
    """Of rows for the same document and field, the first by ``ord``, then value, start and end."""
    order = Window.partitionBy("doc_id", "field_name").orderBy("ord", "value", "start", "end")
    return raw.select(F.struct("*").alias("row"), F.row_number().over(order).alias("n")).where("n = 1").select("row.*")


def sane_intervals(raw: DataFrame) -> DataFrame:
    """Intervals that are missing, negative or empty become null and their rows ungrounded."""
    good = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")), F.lit(False))
    return raw.withColumns({"start": F.when(good, F.col("start")), "end": F.when(good, F.col("end")), "grounded": good})


def violations(raw: DataFrame) -> DataFrame:
    """Rows whose ``grounded`` and offsets contradict each other."""
    both = F.col("start").isNotNull() & F.col("end").isNotNull()
    sound = both & (F.col("start") >= 0) & (F.col("start") < F.col("end"))
    reason = F.when(F.col("grounded") & ~both, "grounded_without_offsets").when(F.col("grounded") & ~sound, "bad_interval").when(~F.col("grounded") & (F.col("start").isNotNull() | F.col("end").isNotNull()), "ungrounded_with_offsets")
    return raw.select("doc_id", "ord", reason.alias("reason")).where("reason is not null")


def observed_attempts(docs: DataFrame, prompts: DataFrame) -> DataFrame:
    """The most attempts of a document's prompts, at least 1."""
    most = prompts.groupBy("doc_id").agg(F.max("attempts").alias("most"))
    return docs.select("doc_id").join(most, "doc_id", "left").select("doc_id", F.greatest(F.coalesce("most", F.lit(1)), F.lit(1)).alias("attempts"))


def completed(wanted: DataFrame, fields: DataFrame) -> DataFrame:
    """``fields`` (a row for each document and field found), and placeholders for the rest of ``wanted`` (doc_id, field_pos,
    field_name)."""
    rows = wanted.join(fields, ["doc_id", "field_name"], "left")
    return rows.withColumns({
        "status": F.coalesce("status", F.lit("failed")),
        "source": F.coalesce("source", F.lit("document")),
        "grounded": F.coalesce("grounded", F.lit(False)),
    })


def to_extract(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents that go to the extractor: with text and with declared fields (``doc_id`` rows of ``fields``)."""
    return docs.where(F.length("full_text") > 0).join(fields.select("doc_id").distinct(), "doc_id", "left_semi")
