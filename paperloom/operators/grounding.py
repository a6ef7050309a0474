"""From spans of the concatenated text to rectangles on pages.

Windows look at what they have passed, in one order or the other, so Spark streams them.

Defined results: null offsets are in no block; of blocks with one id the last is shown; repeated spans are spans of their own; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match
from .offsets import lookup


def _entries(offsets: DataFrame) -> DataFrame:
    """Index entries with the start of the next one that has any width."""
    passed = Window.partitionBy("doc_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("start") < F.col("end"), F.col("start")), ignorenulls=True).over(passed)
    return offsets.withColumns({"next_start": following, "entry_end": F.col("end")})


def spans(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    """``raw`` with the blocks its span begins and ends in and what that makes of it: status, source, grounded, reason.

    A null value is failed; an ungrounded one, or one whose offsets lie in no block, is inferred. An end in the gap behind the
    start's block is taken back to that block's end."""
    entries = _entries(offsets)
    raw = raw.select("doc_id", "ord", "field_name", "value", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("grounded").alias("claimed"))
    starts = lookup(raw.withColumn("offset", F.col("start")), entries, ("block_id", "entry_end", "next_start"))
    starts = starts.withColumnsRenamed({"block_id": "start_block", "local": "local_start"}).drop("offset")
    ends = lookup(starts.withColumn("offset", F.col("end") - 1), entries, ("block_id",)).withColumnsRenamed({"block_id": "end_hit", "local": "end_local"})
    last = F.col("end") - 1
    clamped = F.col("end_hit").isNull() & F.col("start_block").isNotNull() & (last >= F.col("entry_end")) & (last < F.col("next_start"))
    clamped = F.coalesce(clamped, F.lit(False))
    found = ends.withColumns({
        "clamped": clamped,
        "end_block": F.when(clamped, F.col("start_block")).otherwise(F.col("end_hit")),
        "local_end": F.when(clamped, F.col("entry_end") - F.col("start") + F.col("local_start")).otherwise(F.col("end_local") + 1),
    })
    hit = F.col("value").isNotNull() & F.col("claimed") & F.col("start_block").isNotNull() & F.col("end_block").isNotNull()
    hit = F.coalesce(hit, F.lit(False))
    return found.select(
        "doc_id", "ord", "field_name", "value",
        F.when(F.col("value").isNull(), "failed").otherwise("extracted").alias("status"),
        F.when(F.col("value").isNull() | hit, "document").otherwise("inferred").alias("source"),
        hit.alias("grounded"),
        F.when(F.col("value").isNull(), "no_value").when(~F.coalesce("claimed", F.lit(False)), "ungrounded").when(~hit, "hallucinated_offsets").when(F.col("clamped"), "clamped").alias("reason"),
        *(F.when(hit, F.col(c)).alias(c) for c in ("start_block", "end_block", "local_start", "local_end")),
    )


def _last_blocks(blocks: DataFrame) -> DataFrame:
    """A rectangle and text for each block id: of repeated ids the last block's."""
    return blocks.groupBy("doc_id", "block_id").agg(F.max_by(F.struct("page", "text", "bbox"), "seq").alias("b")).select("doc_id", "block_id", "b.*")


def methods(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """How the value of each span within one block is found in its text: ``doc_id, ord, match_method`` (offset, then the matcher's
    methods, then matcher_failed)."""
    text = _last_blocks(blocks).select("doc_id", F.col("block_id").alias("start_block"), "text")
    inside = found.where("grounded and start_block = end_block").join(text, ["doc_id", "start_block"])
    exact = F.substring("text", (F.col("local_start") + 1).cast("int"), (F.col("local_end") - F.col("local_start")).cast("int")) == F.col("value")
    inside = inside.select("doc_id", "ord", "value", "text", exact.alias("exact"))
    tried = match(inside.where("not exact")).select("doc_id", "ord", F.coalesce("match_method", F.lit("matcher_failed")).alias("match_method"))
    return inside.where("exact").select("doc_id", "ord", F.lit("offset").alias("match_method")).unionByName(tried)


def boxes(found: DataFrame, offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, ord, box_no, block_id, page, x0..y1, broken``: whole-block rectangles of grounded spans in order of the index.

    A span over several blocks has each block between once, those without width left out. Where the index has the end before the
    start, it has the start's block alone, and ``broken`` says why.

    Entries that have width are numbered, and each entry knows how many of them stand before it, so that a span is the interval of
    their numbers and makes as many rows as it has entries with width, however many empty ones lie between."""
    has_width = F.when(F.col("start") < F.col("end"), 1).otherwise(0)
    ahead = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    numbered = offsets.withColumn("number", F.coalesce(F.sum(has_width).over(ahead), F.lit(0)))
    seen = numbered.groupBy("doc_id", "block_id").agg(F.min("idx").alias("first"), F.min("number").alias("from_number"), F.max("idx").alias("last"))
    start = seen.select("doc_id", F.col("block_id").alias("start_block"), F.col("first").alias("from_idx"), "from_number")
    end = seen.select("doc_id", F.col("block_id").alias("end_block"), F.col("last").alias("end_last"))
    rows = found.where("grounded").select("doc_id", "ord", "start_block", "end_block").join(start, ["doc_id", "start_block"], "left").join(end, ["doc_id", "end_block"], "left")
    broken = F.when(F.col("start_block") == F.col("end_block"), None).when(F.col("from_idx").isNull(), "start_block_not_seen").when(F.col("end_last").isNull(), "end_block_not_seen_after_start").when(F.col("end_last") < F.col("from_idx"), "end_block_seen_before_start_block")
    rows = rows.withColumn("broken", broken)
    several = rows.where("start_block <> end_block and broken is null")
    stop = F.struct(F.col("idx"), (F.col("number") + has_width - 1).alias("to_number"))
    none = F.lit(None)
    stops = numbered.select("doc_id", "block_id", F.col("idx").alias("at"), stop.alias("stop"), none.cast("int").alias("ord"), none.cast("long").alias("from_number"))
    asked = several.select("doc_id", F.col("end_block").alias("block_id"), F.col("from_idx").alias("at"), none.cast(stops.schema["stop"].dataType).alias("stop"), "ord", "from_number")
    passed = Window.partitionBy("doc_id", "block_id").orderBy(F.desc("at"), F.asc_nulls_last("stop")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    several = stops.unionByName(asked).withColumn("to", F.last("stop", ignorenulls=True).over(passed)).where("stop is null").select("doc_id", "ord", "from_number", "to.to_number").distinct()
    several = several.where("from_number <= to_number").withColumn("number", F.explode(F.sequence("from_number", "to_number")))
    wide = numbered.where("start < end").select("doc_id", "number", "idx", "block_id")
    chosen = several.join(wide, ["doc_id", "number"]).groupBy("doc_id", "ord", "block_id").agg(F.min("idx").alias("idx")).withColumn("broken", F.lit(None).cast("string"))
    one = rows.where("start_block = end_block or broken is not null").select("doc_id", "ord", F.col("start_block").alias("block_id"), F.lit(0).alias("idx"), "broken")
    chosen = chosen.unionByName(one).join(_last_blocks(blocks), ["doc_id", "block_id"])
    order = Window.partitionBy("doc_id", "ord").orderBy("idx")
    return chosen.select("doc_id", "ord", (F.row_number().over(order) - 1).alias("box_no"), "block_id", "page", "bbox.*", "broken")


def resolved(found: DataFrame, boxed: DataFrame) -> DataFrame:
    """Fields with ``bbox_refs``, an array of page and rectangle."""
    refs = boxed.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("box_no", "page", "x0", "y0", "x1", "y1"))).alias("refs"))
    none = F.array().cast("array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>")
    shown = F.transform("refs", lambda r: F.struct(r["page"].alias("page"), r["x0"].alias("x0"), r["y0"].alias("y0"), r["x1"].alias("x1"), r["y1"].alias("y1")))
    return found.join(refs, ["doc_id", "ord"], "left").withColumn("bbox_refs", F.coalesce(shown, none)).drop("refs")


def highlights(boxed: DataFrame, heights: DataFrame) -> DataFrame:
    """A rectangle with a top-left origin for each box that has an area."""
    rows = boxed.where("x0 <> x1 and y0 <> y1").join(heights.select("doc_id", "page", "height"), ["doc_id", "page"])
    return rows.select("doc_id", "ord", "box_no", "page", "x0", (F.col("height") - F.col("y1")).alias("y0"), "x1", (F.col("height") - F.col("y0")).alias("y1"))
