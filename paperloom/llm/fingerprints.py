"""Document fingerprints: a quartile bucket digest.

A five-byte window slides over the UTF-8 bytes; the six triplets that hold its newest byte are hashed into 128 buckets and
counted. The digest has two hex digits for the length (on a logarithmic scale) and two bits a bucket: in which quartile of all
buckets its count lies. Digests are compared by a bounded difference: per bucket 0, 1 or 2, and 6 for opposite quartiles, plus
the difference of the lengths' codes; likeness is 1 at no difference and 0 from ``MOST`` on.

``edited_pairs`` compares each document with its next one in order of doc_id. Rows are dealt out by ranges of doc_id, so a task
sees neighbours together and a text is shuffled once; what the last row of a range needs of the first row of the next one is
handed on in a small join with one row for each range.

Defined results: a null text is an empty one, whose digest is all zeros; texts under five bytes are padded with zero bytes;
equal texts have equal digests; rows with equal doc_id follow each other by a hash of their texts; a null doc_id comes first; a single row is its
own next one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, written

BUCKETS = 128
MOST = 300
#: Which bytes of a window, counted from its newest, form triplets.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
BLOCK = 1 << 18
#: Difference of two bytes that hold the codes of four buckets each.
_CODES = np.array([[(b >> s) & 3 for s in (0, 2, 4, 6)] for b in range(256)])
_STEPS = np.array([0, 1, 2, 6])
_DIFFERENCE = _STEPS[np.abs(_CODES[:, None, :] - _CODES[None, :, :])].sum(axis=2)


def _counts(data: bytes) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    if not data:
        return counts
    raw = np.frombuffer(data.ljust(5, b"\0"), np.uint8)
    for at in range(0, len(raw) - 4, BLOCK):
        block = raw[at : at + BLOCK + 4].astype(np.uint32)
        a, b, c = block * np.uint32(0x9E3779B1), block * np.uint32(0x85EBCA77), block * np.uint32(0xC2B2AE3D)
        n = len(block) - 4
        for salt, (i, j, k) in enumerate(TRIPLETS):
            h = a[4 - i : 4 - i + n] + b[4 - j : 4 - j + n]
            h += c[4 - k : 4 - k + n]
            h += np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h >>= np.uint32(25)
            counts += np.bincount(h, minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> str:
    data = text.encode()
    counts = _counts(data)
    ranked = np.sort(counts)
    quartiles = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quartiles[None, :]).sum(axis=1).reshape(-1, 4)
    packed = (codes << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    length = min(255, round(math.log1p(len(data)) * 10))
    return f"{length:02x}{packed.tobytes().hex()}"


def likeness(one: str, other: str) -> float:
    a, b = np.frombuffer(bytes.fromhex(one), np.uint8), np.frombuffer(bytes.fromhex(other), np.uint8)
    difference = int(_DIFFERENCE[a[1:], b[1:]].sum()) + abs(int(a[0]) - int(b[0]))
    return max(0.0, 1.0 - difference / MOST)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of each row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(fingerprint, texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_chars long, fingerprint string")


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_KINDS = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in _RESULT.split(", ")]


def _compared(doc_id: int | None, text: str, own: str, next_text: str, next_own: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + next_text[:half]
    changed = fingerprint(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_own)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's digest, that of its text with the second half taken from the next document, and their likeness."""
    spark = docs.sparkSession
    names, kinds = [*_NAMES, "part", "place", "text"], [*_KINDS, pa.int32(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        edge = lambda place, row: (row[0], None, None, row[2], None, None, None, part, place, row[1])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = doc_id, text, fingerprint(text)
                rows.append(edge("first", row) if last is None else (*_compared(*last, *row[1:]), part, "inner", None))
                last = row
            if rows:
                yield batch_of(rows)
        if last is not None:
            yield batch_of([edge("last", last)])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text"))  # so that ranges can split rows of one doc_id, or of none
    ranges = rows.repartitionByRange(partitions(spark), "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    found = written(ranges.mapInArrow(neighbours, f"{_RESULT}, part int, place string, text string"), "neighbours")

    first = found.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    every = Window.orderBy("part")  # one small row for each range
    after = found.where("place = 'first'").select("part", F.coalesce(F.lead("part").over(every), F.min("part").over(Window.partitionBy())).alias("next_part"))
    edges = found.where("place = 'last'").select("doc_id", "text", "fingerprint", "part").join(after, "part").join(first, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_compared(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), _KINDS, strict=True)], _NAMES)

    return found.where("place = 'inner'").select(*_NAMES).unionByName(edges.mapInArrow(across, _RESULT))
