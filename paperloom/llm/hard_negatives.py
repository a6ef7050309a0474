"""Hard negatives by a secondary-sort shuffle.

Anchors are rows whose vec_id ``every`` divides. A row's score is its inner product with the anchor in whole numbers; of equal scores
the smaller vec_id comes first. An anchor's positives are its first rows of the same label, itself left out; a positive's negatives
are the first rows of other labels whose scores are ``low`` to 100 hundredths of its own.

The stated anchors are scored against all rows in blocks: anchors are written to the shared folder in blocks, and tasks, which hold
some rows at a time, read one block after another. What cannot be in a result is left out before the shuffle, exactly:

1. Of the rows that a task holds, the first positives of each anchor, as many as are asked for. The same number of them all are the
   anchor's positives, found by the streaming pass of step 3.
2. Of the rows that a task holds, the first negatives within each positive's window.
3. What is left is packed into keys of bytes (anchor, descending score, positive or negative, vec_id) and shuffled by
   ``repartitionAndSortWithinPartitions`` on the anchor. A task streams its anchors' keys in order: a positive opens a window, a
   negative goes to each window that is open and not full, and a window ends with the first score below it. So a task holds a few
   windows, never an anchor's rows.

Scores are exact: by floating-point products where no sum can pass 2^53, else by whole ones of 64 bits, else they are an error, as
in ANSI SQL.

Defined results: rows with a null label or vec_id, a null vector, or a null or non-finite component take no part; vectors of unlike
lengths have no score; an anchor that repeats is an anchor each time, and other rows of its vec_id may be its positives or negatives;
repeated rows count each; an anchor without positives, and a positive without negatives, gives no rows; an empty table gives none;
other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, files_of, partitions, written

EVERY, RELABELLED, LABELS, POSITIVES, NEGATIVES, LOW = 100, 7, 10, 5, 5, 80
SCALE = 256
#: Anchors in a block, and numbers of vectors that a task holds at a time.
BLOCK, HELD = 256, 1 << 20
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Anchor's number, descending score, 0 for positives and 1 for negatives, vec_id.
KEY = struct.Struct(">QQBQ")
TOP = (1 << 63) - 1


def vectors(embeddings: DataFrame) -> DataFrame:
    """``row`` (its number), ``vec_id, label, vector`` (whole numbers) of rows that take part; written."""
    label = F.when(F.col("vec_id") % RELABELLED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    rows = rows.repartition(partitions(embeddings.sparkSession)).withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE)))
    return written(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "label", "vector"), "vectors")  # written: numbers stay


Find = Callable[["Rows", "Rows", pa.Table], Iterator[tuple[int, int, int]]]


class Rows:
    """Some rows of vectors of one length, in order of vec_id."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        self.row, self.vec_id, self.label = (table[c].to_numpy() for c in ("row", "vec_id", "label"))
        self.matrix = table["vector"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)


def by_length(table: pa.Table) -> dict[int, Rows]:
    sizes = np.array(table["vector"].combine_chunks().value_lengths()) if len(table) else np.empty(0, int)
    return {int(n): Rows(table.take(pa.array(np.flatnonzero(sizes == n)))) for n in np.unique(sizes)}


def _most(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.min(initial=0))), abs(int(matrix.max(initial=0))))


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, as whole numbers."""
    bound = _most(anchors) * _most(rows) * max(1, rows.shape[1])
    if bound < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    if bound <= TOP:
        return anchors @ rows.T
    exact = anchors.astype(object) @ rows.astype(object).T
    if (abs(exact) > TOP).any():
        raise OverflowError("a score does not fit 64 bits")
    return exact.astype(np.int64)


def ordered(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row of ``scores`` in ascending order, and the columns they were in; of equal ones the later column comes first."""
    n = scores.shape[1]
    bits = np.int64(n.bit_length())
    if _most(scores) >> (62 - int(bits)) == 0:  # both fit one number, which sorts faster
        both = scores << bits | np.arange(n - 1, -1, -1)
        both.sort(axis=1)
        return both >> bits, n - 1 - (both & ((np.int64(1) << bits) - 1))
    order = np.argsort(scores[:, ::-1], axis=1, kind="stable")
    return np.take_along_axis(scores[:, ::-1], order, axis=1), n - 1 - order


def first_positives(anchors: Rows, rows: Rows, many: int) -> Iterator[tuple[int, int, int]]:
    """Anchor's row, vec_id and score of the first ``many`` of ``rows`` for each anchor that have its label and are not itself."""
    for label in np.unique(anchors.label).tolist():
        of, own = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label == label)
        if not len(own):
            continue
        scores, at = (x[:, -many - 1 :][:, ::-1] for x in ordered(products(anchors.matrix[of], rows.matrix[own])))
        for a, best, places in zip(anchors.row[of].tolist(), scores.tolist(), own[at], strict=True):
            others = [(vec_id, score) for score, vec_id, row in zip(best, rows.vec_id[places].tolist(), rows.row[places].tolist(), strict=True) if row != a]
            for vec_id, score in others[:many]:
                yield a, vec_id, score


def first_negatives(anchors: Rows, rows: Rows, windows: dict[int, list[int]], many: int, low: int) -> Iterator[tuple[int, int, int]]:
    """Anchor's row, vec_id and score of the first ``many`` of ``rows`` of other labels within each of the anchor's windows (scores of
    positives); a row in several windows once."""
    for label in np.unique(anchors.label).tolist():
        of, own = np.flatnonzero(anchors.label == label), np.flatnonzero(rows.label != label)
        if not len(own):
            continue
        scores, at = ordered(products(anchors.matrix[of], rows.matrix[own]))
        for a, values, columns in zip(anchors.row[of].tolist(), scores, at, strict=True):
            highest = np.array(windows.get(a, ()), np.int64)
            pasts, firsts = np.searchsorted(values, highest, "right"), np.searchsorted(values, [-(-low * int(h) // 100) for h in highest])
            taken = {k for first, past in zip(firsts.tolist(), pasts.tolist(), strict=True) for k in range(max(first, past - many), past)}
            for k in taken:
                yield a, int(rows.vec_id[own[columns[k]]]), int(values[k])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(3).flatten())
        if size > HELD:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _blocks(path: str) -> Iterator[pa.Table]:
    """Anchors from the shared folder, ``BLOCK`` of them at a time."""
    import pyarrow.parquet as pq

    system, names = files_of(path)
    for name in names:
        with system.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(BLOCK):
                yield pa.Table.from_batches([batch])


def _scored(rows: DataFrame, anchors: DataFrame, find: Find, name: str) -> DataFrame:
    """``anchor`` (its row), ``vec_id, score`` that ``find(anchors, rows, block)`` yields for the rows that a task holds and each block of
    ``anchors``, both of one length of vectors; written."""
    path = anchors.written_to

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            own = by_length(table)
            for block in _blocks(path):
                found = [x for n, some in by_length(block).items() if n in own for x in find(some, own[n], block)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["anchor", "vec_id", "score"])

    return written(rows.mapInArrow(score, "anchor long, vec_id long, score long"), name)


def packed(anchor: int, negative: bool, vec_id: int, score: int) -> bytes:
    """A key whose order as bytes is that of anchors, descending scores, positives ahead of negatives, then vec_ids."""
    return KEY.pack(anchor, TOP - score, negative, vec_id + TOP + 1)


def unpacked(key: bytes) -> tuple[int, bool, int, int]:
    anchor, descending, negative, vec_id = KEY.unpack(key)
    return anchor, bool(negative), vec_id - TOP - 1, TOP - descending


def mined(keys: Iterable[bytes], positives: int, negatives: int, low: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """From sorted keys: anchor, positive, rank, negative, positive's score, negative's score. A rank of 0 opens a window and has no
    negative."""
    anchor, opened, windows = None, 0, []
    for key in keys:
        of, negative, vec_id, score = unpacked(key)
        if of != anchor:
            anchor, opened, windows = of, 0, []
        if not negative:
            if opened < positives:
                opened += 1
                windows.append([vec_id, score, 0])
                yield anchor, vec_id, 0, vec_id, score, score
            continue
        windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]
        for w in windows:
            w[2] += 1
            yield anchor, w[0], w[2], vec_id, w[1], score


def _streamed(found: DataFrame, positives: int, negatives: int, low: int) -> DataFrame:
    """``mined`` of ``found`` (anchor, negative, vec_id, score): the secondary-sort shuffle."""
    spark = found.sparkSession
    keys = found.rdd.map(lambda r: (packed(r["anchor"], r["negative"], r["vec_id"], r["score"]), None))
    sorted_keys = keys.repartitionAndSortWithinPartitions(partitions(spark), lambda key: zlib.crc32(key[:8]))
    rows = sorted_keys.mapPartitions(lambda pairs: mined((k for k, _ in pairs), positives, negatives, low))
    return spark.createDataFrame(rows, "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(embeddings: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """``anchor_id, positive_id, rank`` (from 1), ``negative_id, positive_score, negative_score``."""
    rows = vectors(embeddings)
    anchors = written(rows.where(F.col("vec_id") % every == 0), "anchors")
    near = _scored(rows, anchors, lambda some, own, _: first_positives(some, own, positives), "near")
    chosen = _streamed(near.withColumn("negative", F.lit(False)), positives, negatives, low).where("rank = 0")
    chosen = written(chosen.select("anchor", F.col("positive_id").alias("vec_id"), F.col("positive_score").alias("score")), "positives")

    opened = chosen.groupBy("anchor").agg(F.collect_list("score").alias("windows"))  # ``positives`` numbers at most
    windowed = written(anchors.join(opened, anchors["row"] == opened["anchor"]).select("row", "vec_id", "label", "vector", "windows"), "windows")

    def within(some: Rows, own: Rows, block: pa.Table) -> Iterator[tuple[int, int, int]]:
        return first_negatives(some, own, dict(zip(block["row"].to_pylist(), block["windows"].to_pylist(), strict=True)), negatives, low)

    apart = _scored(rows, windowed, within, "apart")
    both = chosen.withColumn("negative", F.lit(False)).unionByName(apart.withColumn("negative", F.lit(True)))
    result = _streamed(both, positives, negatives, low).where("rank > 0")
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    result = written(result.join(named, "anchor").select(*(c.split()[0] for c in RESULT.split(", "))), "hard_negatives")
    discard(rows, anchors, near, chosen, windowed, apart)
    return result
