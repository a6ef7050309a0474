"""Connected components of an edge table, by alternating large and small stars.

Each round is a few joins and aggregations on node ids; its edges are written to the shared folder, which cuts the lineage. A node
with many edges costs an aggregation that Spark combines before it shuffles, and a join that it can split.

Defined results: edges with a null end link nothing; repeated edges count once; an edge from a node to itself says nothing; no
edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Link each node's neighbours to the least of them: those above the node (large star) or below it (small star); and the written
    table that it reads."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where("v < u")
    least = written(seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")  # written: a join of two exchanges can split a hot node
    linked = (seen.where("v > u") if large else seen).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), least


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) of all nodes in ``edges`` (u, v) but the least ones themselves. It ends when every node
    is linked to one below it or has others linked to it, not both."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")  # a round reads them many times
    while True:
        up, held = _star(edges, True)
        down, also = _star(up, False)
        before, edges = edges, written(down.distinct(), "edges")
        discard(before, held, also)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
