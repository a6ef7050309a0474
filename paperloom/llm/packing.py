"""Best-fit packing by minimum bin slack.

For each bin, the longest piece left is placed and a bitset subset-sum over the lengths left finds the fullest feasible
combination for the rest, which is then removed. The search needs only how many pieces of each length are left, so the corpus
enters it as a histogram of at most ``max_tokens`` rows, whatever its size; and while the counts allow it, the same combination
is the fullest one again, so it is taken as often as they allow at once. The plan therefore depends on ``max_tokens``, not on the
number of documents. Spark tokenizes, numbers the pieces of each length (within salted groups, as one length may hold most
pieces), and looks each number up in the plan.

Defined results: a null text is an empty one (a single id 0); repeated rows are packed each; an empty table gives no rows; a null
doc_id is kept as such; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import partitions, text_or_empty, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0, split_chars: int = 1 << 15) -> DataFrame:
    """Documents as token ids with ``end_id`` after each; those over ``max_tokens`` are cut, the first piece taking the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.encode_long(text, split_chars), end_id).astype("<u4")
                ends = range((len(ids) - 1) % max_tokens + 1, len(ids) + 1, max_tokens)
                start = 0
                for k, end in enumerate(ends):
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, PIECES)


def fullest(left: list[tuple[int, int]], room: int) -> dict[int, int]:
    """Of ``(length, count)``, longest first, a combination that fills ``room`` as far as any can: {length: how many}."""
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length, count in left:
        most, part = min(count, room // length), 1
        while most > 0:
            part = min(part, most)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & full
            most -= part
            part *= 2
        if reach >> room:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            taken[length] = taken.get(length, 0) + part
    return taken


def plan(counts: dict[int, int], max_tokens: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first number, first bin, how many a bin, offset in the bin); and how many bins there are."""
    left = dict(sorted(counts.items(), reverse=True))
    used, rows, bins = dict.fromkeys(left, 0), {n: [] for n in left}, 0
    while left:
        longest = next(iter(left))
        rest = [(n, c - (n == longest)) for n, c in left.items() if n <= max_tokens - longest and c > (n == longest)]
        taken = fullest(rest, max_tokens - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times, offset = min(left[n] // k for n, k in taken.items()), 0
        for n, k in taken.items():
            rows[n].append((used[n], bins, k, offset))
            offset += n * k
            used[n] += k * times
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}, bins


def pack(cut: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    salts = 8 * partitions(spark)
    cut = written(cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("row")), "pieces")
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))  # rows of one doc_id, or of none, are dealt out too
    groups = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_tokens rows at most
    lookup, _ = plan(counts, max_tokens)

    own = Window.partitionBy("length", "salt").orderBy("row")
    numbered = (
        cut.withColumn("own", F.row_number().over(own) - 1)
        .join(groups.select("length", "salt", "before"), ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("number"))
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, numbers = frame["length"].to_numpy(), frame["number"].to_numpy()
            for n in np.unique(lengths):
                at, rows = np.flatnonzero(lengths == n), lookup[int(n)]
                row = rows[np.searchsorted(rows[:, 0], numbers[at], side="right") - 1]
                within = numbers[at] - row[:, 0]
                sequence[at] = row[:, 1] + within // row[:, 2]
                offset[at] = row[:, 3] + within % row[:, 2] * n
            yield frame.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    return numbered.mapInPandas(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces(docs, tokenizer, max_tokens, end_id), max_tokens)
