"""Reading order of item trees: preorder numbers of parent and child tables.

A tree's Euler tour enters each node before its children and leaves it after them, so each entry and exit has one successor, which
follows from a node's first child, next sibling and parent. Ranks in these lists come from pointer doubling: in each round an element
adds what its successor has counted and takes over its successor's successor, so a list of n elements takes about log2(n) rounds,
each a join on the elements' numbers, whether the tree is flat or one long path. A round's table is written, which cuts the lineage; a document
takes part in as many rounds as its own number of nodes asks for, so small trees do not go along with the largest.

Defined results: children of one parent come by ``ordinal``, nulls first, then by node; a node whose parent is not in its document is
a root, and roots follow each other like siblings; nodes that reach no root (a circle and what hangs on it) have a null number and
level; a null document or node is left out, a node that is repeated counts once, with the least parent and ordinal; other columns are ignored; no
nodes give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Write = Callable[[DataFrame, str], DataFrame]


def _tour(nodes: DataFrame) -> DataFrame:
    """``id`` (twice a node's number to enter it, one more to leave it), ``to`` (null at the end), ``n`` (entries from here on, so far),
    ``up`` (entries less exits) and ``rounds`` of ``nodes`` (doc_id, node, number, above, ordinal, rounds)."""
    siblings = Window.partitionBy("doc_id", "above").orderBy("ordinal", "node")
    kids = nodes.select("number", "above", "rounds", F.lead("number").over(siblings).alias("following"), F.row_number().over(siblings).alias("place"))
    first = kids.where("place = 1 and above is not null").select(F.col("above").alias("number"), F.col("number").alias("child"))
    kids = kids.join(first, "number", "left")
    enter, leave = 2 * F.col("number"), 2 * F.col("number") + 1
    step = lambda at, to, n, up: F.struct(at.alias("id"), to.alias("to"), F.lit(n).cast("int").alias("n"), F.lit(up).cast("int").alias("up"))
    after = F.coalesce(2 * F.col("following"), 2 * F.col("above") + 1)
    inner = F.array(step(enter, 2 * F.col("child"), 1, 1), step(leave, after, 0, -1))
    return kids.select("rounds", F.inline(F.when(F.col("child").isNull(), F.array(step(enter, after, 1, 0))).otherwise(inner)))  # a leaf is left as it is entered


def preorder(nodes: DataFrame, write: Write) -> DataFrame:
    """``doc_id, node, seq`` (from 0), ``level`` (0 for roots) of ``nodes`` (doc_id, node, parent, ordinal); ``write(df, name)`` writes
    a table and reads it back."""
    own = nodes.where("doc_id is not null and node is not null").groupBy("doc_id", "node").agg(F.min(F.struct("parent", "ordinal")).alias("least")).select("doc_id", "node", "least.*")
    own = write(own.withColumn("number", F.monotonically_increasing_id()), "nodes")
    known = own.select("doc_id", F.col("node").alias("parent"), F.col("number").alias("above"))
    rounds = own.groupBy("doc_id").agg(F.length(F.bin(2 * F.count("*") - 1)).alias("rounds"))  # so often its tour's length is halved
    tour = write(_tour(own.join(known, ["doc_id", "parent"], "left").join(rounds, "doc_id")), "tour0")
    most = tour.agg(F.max("rounds")).first()[0] or 0  # one number
    done = None
    for k in range(1, most + 1):
        tour = tour.where(F.col("rounds") >= k)
        ahead = tour.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("n").alias("more"), F.col("up").alias("more_up"))
        sum_of = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        joined = tour.join(ahead, "to", "left")
        tour = write(joined.select("rounds", "id", F.col("far").alias("to"), sum_of("n", "more"), sum_of("up", "more_up")), f"tour{k}")
        ended = tour.where(F.col("rounds") == k)
        done = ended if done is None else done.unionByName(ended)
    if done is None:
        done = tour
    entries = own.select("doc_id", "node", "number").join(done.where("id % 2 = 0").select(F.shiftright("id", 1).alias("number"), "to", "n", "up"), "number")
    whole = entries.where("to is null").groupBy("doc_id").agg(F.max("n").alias("whole"))
    ended = F.col("to").isNull()
    return entries.join(whole, "doc_id", "left").select("doc_id", "node", F.when(ended, F.col("whole") - F.col("n")).cast("int").alias("seq"), F.when(ended, -F.col("up")).cast("int").alias("level"))
