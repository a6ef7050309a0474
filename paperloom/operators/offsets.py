"""Concatenated text and the index of its blocks' offsets (code points).

Defined results: a null text is an empty one; blocks with one ``seq`` follow each other by text, then id, in both; repeated blocks are
blocks of their own; a point without an offset lies in no entry; a point's columns are kept whatever their names; empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\n\n"
#: Width of the stretches of text on which points and entries meet.
STRETCH = 4096


def concatenated(blocks: DataFrame, docs: DataFrame | None = None, separator: str = SEPARATOR) -> DataFrame:
    """``doc_id, full_text``; with ``docs``, those without blocks have an empty text."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    whole = blocks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("full_text"))
    if docs is None:
        return whole
    return docs.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("full_text", F.lit("")).alias("full_text"))


def offset_index(blocks: DataFrame, separator: str = SEPARATOR) -> DataFrame:
    """``doc_id, idx, start, end, block_id``: one entry for each block, half-open."""
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("doc_id").orderBy("seq", text, "block_id")
    so_far = F.sum((F.length(text) + len(separator)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(separator)
    return blocks.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), (so_far - F.length(text)).alias("start"), so_far.alias("end"), "block_id")


def index_violations(offsets: DataFrame) -> DataFrame:
    """A row for each broken rule of an entry: negative, inverted, or beginning before the one ahead of it ends."""
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("idx"))
    rules = {"negative": (F.col("start") < 0) | (F.col("end") < 0), "inverted": F.col("start") > F.col("end"), "overlap": F.col("start") < before}
    reasons = F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda r: r.isNotNull())
    return offsets.select("doc_id", "idx", reasons.alias("reasons")).select("doc_id", "idx", F.explode("reasons").alias("reason"))


def lookup(points: DataFrame, offsets: DataFrame, keep: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """``points`` (doc_id, offset, ...) with columns ``keep`` of the entry that holds the offset and the ``local`` offset in it.

    Entries are laid out on stretches of the text, so that points and entries of one document meet by equality of document and
    stretch, and a long document is not one task's product of its points and entries."""
    stretch = lambda c: F.floor(c / STRETCH)
    held = offsets.where("start < end").select(F.col("doc_id").alias("of"), F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end") - 1))).alias("stretch"), F.struct("start", "end", *keep).alias("entry"))
    asked = points.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"), F.col("offset").alias("place"), stretch(F.col("offset")).alias("at"))
    inside = (F.col("place") >= F.col("entry.start")) & (F.col("place") < F.col("entry.end"))
    joined = asked.join(held, (F.col("own") == F.col("of")) & (F.col("at") == F.col("stretch")) & inside, "left")
    return joined.select("row.*", *(F.col(f"entry.{c}").alias(c) for c in keep), (F.col("place") - F.col("entry.start")).alias("local"))


def block_count(offsets: DataFrame) -> DataFrame:
    return offsets.groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
