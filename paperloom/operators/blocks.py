"""From source text items to the block table.

Defined results: an item with a null text is like one without text; blocks with one number follow each other by text, nulls ahead;
repeated blocks are blocks of their own; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_text_and_place(items: DataFrame) -> DataFrame:
    """Items that have text and a provenance, with the first provenance."""
    return items.where((F.col("text") != "") & (F.size("provs") > 0)).withColumn("prov", F.col("provs")[0]).drop("provs")


def in_reading_order(items: DataFrame) -> DataFrame:
    """``seq`` numbered by ``reading_seq``, in storage order (``storage_seq``) where there is none."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("reading_seq", "storage_seq"), "storage_seq", "text")
    return items.withColumn("seq", F.row_number().over(order) - 1)


def bottom_left(items: DataFrame, heights: DataFrame) -> DataFrame:
    """Rectangles with a bottom-left origin; ``known`` is false where an item must be flipped and its page has no height."""
    p = F.col("prov")
    top = F.coalesce(p["coord_origin"].endswith("TOPLEFT"), F.lit(False))
    joined = items.withColumn("page", p["page"]).join(heights.select("doc_id", "page", "height"), ["doc_id", "page"], "left")
    y0, y1 = F.when(top, F.col("height") - p["b"]).otherwise(p["b"]), F.when(top, F.col("height") - p["t"]).otherwise(p["t"])
    box = F.struct(p["l"].alias("x0"), y0.alias("y0"), p["r"].alias("x1"), y1.alias("y1"))
    return joined.select("doc_id", "seq", "page", "text", box.alias("bbox"), (~top | F.col("height").isNotNull()).alias("known"))


def with_block_ids(blocks: DataFrame) -> DataFrame:
    """``block_id``: p{page}_b{i}, i counting a page's blocks from 0."""
    within = Window.partitionBy("doc_id", "page").orderBy("seq", "text")
    return blocks.withColumn("block_id", F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), (F.row_number().over(within) - 1).cast("string")))


def geometry_violations(blocks: DataFrame) -> DataFrame:
    """A row for each broken rule of a block's rectangle or page."""
    b = F.col("bbox")
    rules = {"x_inverted": b["x0"] > b["x1"], "y_inverted": b["y0"] > b["y1"], "page_below_1": F.col("page") < 1}
    reasons = F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda r: r.isNotNull())
    return blocks.select("doc_id", "block_id", F.explode(reasons).alias("reason"))


def of_page(blocks: DataFrame, page: int) -> DataFrame:
    return blocks.where(F.col("page") == page)


def too_many_pages(docs: DataFrame, limit: int = 200) -> DataFrame:
    return docs.where(F.col("page_count") > limit).select("doc_id", F.lit(limit).alias("limit"), F.col("page_count").alias("actual"))


def without_blocks(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    return docs.join(blocks.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("PDF_NO_TEXT_EXTRACTABLE").alias("code"))
