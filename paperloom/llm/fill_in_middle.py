"""Fill-in-middle by in-place block rotation.

A text is cut into units at two places that its doc_id decides: prefix, middle, suffix. The text's bytes go into one bytearray, the
sentinels are inserted at the cuts, so that it holds ``<P>`` prefix ``<M>`` middle ``<S>`` suffix, and neighbouring blocks change
places by a rotation of three reversals within the array: the last two for the form psm (prefix, suffix, middle), the last and all
before it for spm (suffix, prefix, middle). ``restore`` finds the sentinels, turns the same rotation back and takes them out. The
bytearray is the only copy of a text that grows with it: units are found, and stretches reversed, ``CHUNK`` bytes at a time.

A text that holds a sentinel stays plain, and in other outputs the parts are kept apart by sentinels, so no sentinel is found but
those inserted: one that was made of the ends of a part and a sentinel would need ``<`` inside the inserted one.

Every row is judged by itself: no shuffle, and a long text costs what its length says.

Defined results: a null text is an empty one, without units and plain; a null doc_id has the empty string in place of its number;
repeated rows give repeated rows; an empty table gives none. ``transform`` ignores other columns; ``restore`` keeps them, whatever
their names, but for one named ``restored``, which it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts how many are transformed, and of 100 of those how many take the form spm.
RATE, SPM_RATE = 50, 80
SEED = 42
CHUNK = 1 << 16
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that the doc_id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


class Units:
    """Units of a text's bytes: white space (space and U+0009 to U+000D) with what follows up to the next; at the end of the text
    white space alone. A unit therefore ends before white space that stands behind something else, and where the text ends."""

    def __init__(self, data: bytes):
        self.size, self.raw = len(data), np.frombuffer(data, np.uint8)
        self.counts = [len(self._ends(at)) for at in range(0, self.size, CHUNK)]
        self.total = sum(self.counts)

    def _ends(self, at: int) -> np.ndarray:
        """Where units end, past ``at`` and up to a chunk further."""
        part = self.raw[at : at + CHUNK + 1]
        blank = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        ends = at + 1 + np.flatnonzero(~blank[:-1] & blank[1:])
        return np.append(ends, self.size) if at + CHUNK >= self.size else ends

    def end(self, units: int) -> int:
        """Where the first ``units`` end."""
        if not units:
            return 0
        for chunk, n in enumerate(self.counts):
            if units <= n:
                return int(self._ends(chunk * CHUNK)[units - 1])
            units -= n
        raise IndexError("more units than the text has")


def reverse(raw: np.ndarray, start: int, end: int) -> None:
    """Reverse a stretch in place, a chunk from either end at a time."""
    while end - start > 1:
        k = min(CHUNK, (end - start) // 2)
        left = raw[start : start + k].copy()
        raw[start : start + k] = raw[end - k : end][::-1]
        raw[end - k : end] = left[::-1]
        start, end = start + k, end - k


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the neighbouring blocks [start, middle) and [middle, end) of ``buffer`` by three reversals."""
    raw = np.frombuffer(buffer, np.uint8)
    reverse(raw, start, middle)
    reverse(raw, middle, end)
    reverse(raw, start, end)


def chars(data: bytes | memoryview) -> int:
    """Code points of UTF-8 bytes."""
    raw = np.frombuffer(data, np.uint8)
    return sum(int(np.count_nonzero((raw[at : at + CHUNK] & 0xC0) != 0x80)) for at in range(0, len(raw), CHUNK))


def split(data: bytes, form: str, first: int, second: int) -> bytearray:
    """``data``, cut at two bytes, in a form other than plain."""
    buffer = bytearray(data)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def joined(output: bytes, form: str) -> bytes | bytearray:
    """The text that ``split`` made ``output`` of."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    else:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return buffer


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``doc_id, n`` (units), ``form`` (plain, psm, spm), ``prefix_chars, middle_chars`` (code points, null if plain), ``output`` of
    each row."""
    schema = T._parse_datatype_string(SCHEMA)

    def cut(doc_id: int | None, data: bytes) -> tuple:
        units = Units(data)
        h1, h2, h3, h4 = draws(doc_id, seed)
        if not data or h3 % 100 >= rate or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
            return doc_id, units.total, "plain", None, None, data
        first, second = (units.end(k) for k in sorted((h1 % (units.total + 1), h2 % (units.total + 1))))
        form = "spm" if h4 % 100 < spm_rate else "psm"
        view = memoryview(data)
        return doc_id, units.total, form, chars(view[:first]), chars(view[first:second]), split(data, form, first, second)

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            rows = [cut(*row) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("data"))
    return rows.mapInArrow(every, schema).withColumn("output", F.col("output").cast("string"))


def restore(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``form`` and ``output``) and the text that each was made of, as ``restored``; null where one of both is."""
    schema = T.StructType([T.StructField("row", T.StructType(rows.schema.fields)), T.StructField("restored", T.BinaryType())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if f is None or o is None else joined(o, f) for f, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], schema.names)

    held = rows.select(F.struct(*rows.columns).alias("row"), "form", F.col("output").cast("binary").alias("output"))
    kept = [F.col("row").getField(c).alias(c) for c in rows.columns if c != "restored"]
    return held.mapInArrow(back, schema).select(*kept, F.col("restored").cast("string").alias("restored"))


def digests(docs: DataFrame) -> DataFrame:
    """What ``transform`` makes of each row, with digests in place of the texts, and of those restored."""
    rows = restore(transform(docs))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
