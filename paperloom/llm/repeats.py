"""Suffix-array dedup by distributed prefix doubling: remove bytes covered by a string of ``length`` bytes that also starts
anywhere else.

A round knows positions by the rank of their first h bytes. It pairs the rank at a position with that at a growing offset, Spark
sorts the distinct pairs, and their place in that order is the rank of a longer prefix. Positions whose pair no other has are
unique and leave; the rest go on until the prefix has passed ``length``. Ranks of strings of ``length / 4`` bytes, q, come from the
bytes (shorter ones decide nothing), so the offsets are q, then what is missing of two of 2q bytes, then the last 15 bytes.

Ranking every byte's position would sort the corpus several times over, so positions that must share their fate share a row:

1. Each window of ``length`` bytes has an anchor: of all strings of q bytes in it, the place of that with the least fingerprint.
   Equal windows have their anchors at the same offset. Successive windows with one anchor form a run.
2. Round at q: runs are ranked by their anchor's string. Alone with its rank, no window of a run occurs elsewhere. A run that
   occurs elsewhere as a whole, with all its windows' bytes, is removed. The others go on, and with them one of each kind of
   removed runs of their rank, which they may match in part.
3. Rounds at 2q and at ``length - 15``: runs are cut into blocks of up to 16 windows at fixed offsets from the anchor, ranked by
   the bytes that all of a block's windows share, and judged alike.
4. Round at ``length``: the windows of the blocks left over, by the pair of the block's rank and their own 15 bytes.

Words get the first round alone: strings of ``words / 2`` words that each window of ``words`` words has one of are ranked, and those
that also start elsewhere are counted. A document without any holds no passage of ``words`` words that is also anywhere else,
however few bytes it has.

In a stretch of a short period, such as padding, each window would be a run of its own. There a window that equals the one a period
before it is removed at once, with that one, and only the first of such a chain goes into the rounds, where it stands for all. So a
text has about a run for every hundred bytes, whatever it holds, and what a document's task holds grows with its length alone.

Fingerprints of 64 bits only choose anchors and candidates; what is removed is equal in digests of 128 bits or in bytes. Ranks
are counted by aggregations that Spark combines before the shuffle, written, and joined back, so no group is taken whole into a
task and the join can split a hot one. Texts are shuffled once, to the runs that may repeat, and after that only those of
documents with such runs.

Defined results: a null text is an empty one; documents of fewer than ``length`` bytes keep all; repeated rows are documents of
their own, so their bytes repeat; a null doc_id is a document too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import _U, _Powers, mix
from .common import discard, text_or_empty, written

LENGTH, WORDS = 400, 51
BLOCK = 16
#: Bytes, and words, of a text that are fingerprinted at once.
SEGMENT, WORD_SEGMENT = 1 << 18, 1 << 15
#: How often neighbouring anchors of a segment must be a period apart for it to be looked at.
OFTEN = 64
#: Rows of blocks that a task holds before it hands them on.
HELD = 1 << 15


class Prints:
    """Fingerprints of stretches of some numbers."""

    def __init__(self, numbers: np.ndarray):
        up, self.down = _Powers.to(len(numbers) + 1)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum((numbers.astype(_U) + _U(1)) * up[: len(numbers)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] ^ ((end - start).astype(_U) << _U(40)))

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n] ^ (_U(size) << _U(40)))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive values."""
    blocks = np.concatenate((values, np.full(-len(values) % width, 2**64 - 1, _U))).reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def _anchored(numbers: np.ndarray, length: int, size: int) -> tuple[np.ndarray, ...]:
    """Of each run of windows of ``length`` of the ``numbers``: its anchor, how far its first and last windows start before the
    anchor, the fingerprint of the anchor's string of ``size``."""
    strings = Prints(numbers).all(size)
    found = least((strings & _U(0xFFFFFFFF00000000)) | np.arange(len(strings), dtype=_U), length - size + 1)
    anchors = (found & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(anchors)) + 1))
    last = np.concatenate((first[1:], [len(anchors)])) - 1
    anchor = anchors[first]
    return anchor, anchor - first, anchor - last, strings[anchor]


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, _U))


def _twins(data: np.ndarray, start: int, end: int, length: int, period: int) -> np.ndarray:
    """For each window that starts from ``start`` to ``end``, whether it equals the one a period before it."""
    low = max(0, start - period)
    same = np.concatenate(([0], np.cumsum(data[low : end + length - 1 - period] == data[low + period : end + length - 1])))
    whole = same[length:] - same[:-length] == length  # of windows low to end - period, and those a period after them
    return np.concatenate((np.zeros(low + period - start, bool), whole))[: end - start]


def byte_runs(data: bytes, length: int) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int]]]:
    """``_anchored`` for the bytes of a text, some windows at a time, without windows that equal one a short period before them; and
    the stretches of those windows and of the ones that they equal."""
    parts, spans, whole, size = [], [], np.frombuffer(data, np.uint8), length // 4
    for at in range(0, len(whole) - length + 1, SEGMENT):
        end = min(at + SEGMENT, len(whole) - length + 1)
        anchor, first, last, strings = _anchored(whole[at : end + length - 1], length, size)
        anchor = anchor + at
        steps = np.diff(anchor)[(np.diff(strings.view(np.int64)) == 0) & (np.diff(anchor) < size)]
        periods = [p for p, n in zip(*np.unique(steps, return_counts=True), strict=True) if n > OFTEN]
        if periods:
            dropped = np.zeros(end - at, bool)
            for period in periods:
                twins = _twins(whole, at, end, length, int(period))
                edges = at + np.flatnonzero(np.diff(np.concatenate(([0], twins.view(np.int8), [0]))))
                spans += [(int(a - period), int(b - 1 + length)) for a, b in edges.reshape(-1, 2)]
                dropped |= twins
            lost = np.concatenate(([0], np.cumsum(dropped)))
            begin, past = anchor - first - at, anchor - last - at + 1
            gone = lost[past] - lost[begin]
            for k in np.flatnonzero((gone > 0) & (gone < past - begin)).tolist():  # cut the runs around what is dropped
                edges = np.flatnonzero(np.diff(np.concatenate(([0], (~dropped[begin[k] : past[k]]).view(np.int8), [0])))).reshape(-1, 2) + at + begin[k]
                parts.append((np.full(len(edges), anchor[k]), anchor[k] - edges[:, 0], anchor[k] - edges[:, 1] + 1, np.full(len(edges), strings[k])))
            kept = gone == 0
            anchor, first, last, strings = anchor[kept], first[kept], last[kept], strings[kept]
        parts.append((anchor, first, last, strings))
    return _joined(parts), _merged(spans)


def word_strings(text: str, words: int) -> np.ndarray:
    """Fingerprints of the anchored strings of half as many words, one for each run of windows of ``words`` words."""
    raw = np.frombuffer(" ".join(text.split()).encode(), np.uint8)
    spaces = np.flatnonzero(raw == 32)
    all_starts, all_ends = np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(raw)]))
    parts = [np.empty(0, _U)]
    for at in range(0, len(all_starts) - words + 1, WORD_SEGMENT):
        starts, ends = all_starts[at : at + WORD_SEGMENT + words - 1], all_ends[at : at + WORD_SEGMENT + words - 1]
        hashes = Prints(raw[starts[0] : ends[-1]]).of(starts - starts[0], ends - starts[0])
        anchor, _, _, strings = _anchored(hashes, words, words // 2)
        parts.append(strings[1:] if at and anchor[0] + at == before else strings)
        before = anchor[-1] + at
    return np.concatenate(parts)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _ranked(pairs: list[DataFrame], key: list[str], name: str) -> DataFrame:
    """``key`` and its rank ``name`` for what occurs more than once in ``pairs``: the distinct keys, sorted and numbered in order."""
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    several = every.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
    ordered = several.repartitionByRange(*key).sortWithinPartitions(*key)
    return written(ordered.withColumn(name, F.monotonically_increasing_id()), name)  # written: numbers stay, and a join of two exchanges can split a hot key


def _judged(rows: DataFrame, rank: list[str], whole: list[str]) -> tuple[DataFrame, DataFrame]:
    """The kinds of ``rows``, written; ``rows`` with ``repeated``: whether others of their ``rank`` have ``whole`` as well; and ``goes_on``: whether the next round
    needs it, as it is not repeated, or as the first of its likes, which rows that are not repeated may match in part."""
    kinds = rows.groupBy(*rank, *whole).agg(F.count("*").alias("n"), F.min(F.struct("id", "print", "anchor")).alias("least"))
    lone = kinds.groupBy(*rank).agg((F.min("n") == 1).alias("lone"))
    kinds = written(kinds.join(lone, rank), "kinds")
    rows = rows.join(kinds, [*rank, *whole])
    first = F.struct("id", "print", "anchor") == F.col("least")
    return kinds, rows.withColumn("repeated", F.col("n") > 1).withColumn("goes_on", (F.col("n") == 1) | (F.col("lone") & first)).drop("n", "least", "lone")


def _identified(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("print"))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows, strict=True), types, strict=True)], list(names))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def _covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """``_merged`` for arrays."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    heads = np.flatnonzero(np.append(True, starts[1:] > ends[:-1])) if len(starts) else np.empty(0, int)
    return list(zip(starts[heads].tolist(), ends[np.append(heads[1:], len(starts)) - 1].tolist(), strict=True)) if len(heads) else []


def _marks(column: pa.ListArray) -> Iterator[dict[str, np.ndarray]]:
    """The fields of each row's array of structs, as arrays; empty ones for null."""
    for row in range(len(column)):
        structs = column.slice(row, 1).flatten()
        yield {structs.type.field(i).name: structs.field(i).to_numpy(zero_copy_only=False) for i in range(structs.type.num_fields)}


def _rounds(runs: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Spans (id, print, start, end) of windows that repeat in part of their runs; and the written tables they are read from."""
    quarter, shared = length // 4, length - BLOCK + 1
    offset = shared - 2 * quarter
    schema = "id long, print long, anchor int, block int, low int, high int, a binary, b binary, c binary, d binary, left binary, right binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, text, marks in zip(*(c.to_pylist() for c in batch.columns[:3]), _marks(batch.column(3)), strict=True):
                data = text.encode()
                for at, first, last in zip(*(x[marks["goes_on"]].tolist() for x in (marks["anchor"], marks["first"], marks["last"])), strict=True):
                    if len(out) > HELD:
                        yield _batch(out, schema)
                        out = []
                    for b in range(last // BLOCK * BLOCK, first + 1, BLOCK):
                        low, high, begin = max(b, last), min(b + BLOCK - 1, first), at - b
                        strings = (_digest(data[begin + o : begin + o + quarter]) for o in (0, quarter, offset, offset + quarter))
                        out.append((doc, mark, at, b, low, high, *strings, data[at - high : begin], data[begin + shared : at - low + length]))
            if out:
                yield _batch(out, schema)

    cut = written(runs.mapInArrow(blocks, schema), "blocks")
    two = _ranked([cut.select("a", "b"), cut.select(F.col("c").alias("a"), F.col("d").alias("b"))], ["a", "b"], "rank")
    near, far = two.withColumnRenamed("rank", "near"), two.select(F.col("a").alias("c"), F.col("b").alias("d"), F.col("rank").alias("far"))
    rows = written(cut.join(near, ["a", "b"]).drop("a", "b").join(far, ["c", "d"]).drop("c", "d"), "twice")  # 2q bytes at the block and at the offset
    discard(cut, two)
    ranks = _ranked([rows.select("near", "far")], ["near", "far"], "rank")
    ranked = written(rows.join(ranks, ["near", "far"]).drop("near", "far"), "shared")
    discard(rows, ranks)
    kinds, judged = _judged(ranked, ["block", "rank"], ["low", "high", "left", "right"])
    judged = written(judged, "judged")
    discard(ranked, kinds)

    single = judged.where("goes_on").withColumn("back", F.explode(F.sequence("low", "high")))
    before = F.substring("left", F.octet_length("left") - (F.col("back") - F.col("block")) + 1, F.col("back") - F.col("block"))
    after = F.substring("right", F.lit(1), F.col("block") + (BLOCK - 1) - F.col("back"))
    single = single.select("id", "print", (F.col("anchor") - F.col("back")).alias("start"), "rank", "back", F.concat(before, after).alias("rest"))
    last = _ranked([single.select("rank", "back", "rest")], ["rank", "back", "rest"], "last")
    found = single.join(last, ["rank", "back", "rest"]).select("id", "print", "start", (F.col("start") + length).alias("end"))
    whole = judged.where("repeated").select("id", "print", (F.col("anchor") - F.col("high")).alias("start"), (F.col("anchor") - F.col("low") + length).alias("end"))
    return found.unionByName(whole), [judged, last]


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Of documents with runs that may repeat: ``id, print`` (of the row), ``doc_id, n_bytes, spans, kept``; spans are the maximal
    removed stretches of bytes, kept the other bytes."""
    if length < 2 * BLOCK:
        raise ValueError(f"length must be {2 * BLOCK} or more")
    rows = _identified(docs)
    names = ["id", "print", "anchor", "first", "last", "string", "whole"]

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in names[:-1]]
            wholes: list[bytes] = []
            for doc, mark, text in zip(batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                (anchor, first, last, strings), near = byte_runs(data, length)
                starts, ends = (np.array(x, np.int64) for x in zip(*near, strict=True)) if near else (np.empty(0, np.int64),) * 2
                n = len(anchor) + len(near)
                for c, x in zip(columns, (np.full(n, doc), np.full(n, mark), np.append(anchor, starts), np.append(first, 0 * starts), np.append(last, starts - ends + length), np.append(strings.astype(np.int64), 0 * starts)), strict=True):
                    c.append(x)
                wholes += [_digest(data[a:b]) for a, b in zip((anchor - first).tolist(), (anchor - last + length).tolist(), strict=True)]
                wholes += [None] * len(near)
            if wholes:
                joined = [np.concatenate(c).astype(np.int64) for c in columns]
                joined[2:5] = [c.astype(np.int32) for c in joined[2:5]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, joined), pa.array(wholes, pa.binary())], names)

    long_enough = rows.where(F.octet_length("text") >= length).select("id", "print", "text")
    anchors = written(long_enough.mapInArrow(anchored, "id long, print long, anchor int, first int, last int, string long, whole binary"), "anchors")
    runs = anchors.where("whole is not null")
    ranks = _ranked([runs.select("string")], ["string"], "rank")
    several = written(runs.join(ranks, "string").drop("string"), "several")
    kinds, marks = _judged(several, ["rank"], ["first", "last", "whole"])
    near = anchors.where("whole is null").select("id", "print", "anchor", "first", "last", F.lit(True).alias("repeated"), F.lit(False).alias("goes_on"))
    marks = marks.select(*near.columns).unionByName(near)
    marks = marks.groupBy("id", "print").agg(F.collect_list(F.struct("anchor", "first", "last", "repeated", "goes_on")).alias("marks"))
    touched = written(rows.join(marks, ["id", "print"]), "touched")
    discard(anchors, ranks, several, kinds)

    found, held = _rounds(touched.where(F.exists("marks", lambda m: m["goes_on"])).select("id", "print", "text", "marks"), length)
    found = found.groupBy("id", "print").agg(F.collect_set(F.struct("start", "end")).alias("more"))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, mark, doc_id, text, marks, more in zip(*(c.to_pylist() for c in batch.columns[:4]), _marks(batch.column(4)), _marks(batch.column(5)), strict=True):
                data, again = text.encode(), marks["repeated"]
                starts, ends = marks["anchor"][again] - marks["first"][again], marks["anchor"][again] - marks["last"][again] + length
                cover = _covered(np.append(starts, more["start"]), np.append(ends, more["end"]))
                edges = [0, *(x for span in cover for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, mark, doc_id, len(data), [{"start": a, "end": b} for a, b in cover], kept))
            if out:
                kinds = (*[pa.int64()] * 4, spans, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "print", "doc_id", "n_bytes", "spans", "kept"])

    every = touched.join(found, ["id", "print"], "left").select("id", "print", "doc_id", "text", "marks", "more")
    every = every.mapInArrow(removed, "id long, print long, doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    every.read_from = [touched, *held]
    return every


def shared_strings(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``id, print`` (of the row), ``n_shared``: how many different anchored strings of ``words / 2`` words of a document also start
    elsewhere, and so may be part of a repeated passage of ``words`` words; documents without any are left out."""
    if words < 4:
        raise ValueError("words must be 4 or more")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_strings(t, words) for t in batch.column(2).to_pylist()]
            sizes = [len(f) for f in found]
            if sum(sizes):
                ids, prints = (np.repeat(batch.column(c).to_numpy(), sizes) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(prints), pa.array(np.concatenate(found).astype(np.int64))], ["id", "print", "string"])

    rows = written(_identified(docs).select("id", "print", "text").mapInArrow(strings, "id long, print long, string long"), "strings")
    ranks = _ranked([rows.select("string")], ["string"], "rank")
    shared = written(rows.join(ranks, "string").select("id", "print", "rank").distinct().groupBy("id", "print").agg(F.count("*").alias("n_shared")), "shared_strings")
    discard(rows, ranks)
    return shared


def deduplicated(docs: DataFrame, length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row; then ``n_kept``, ``spans`` (start:end of the removed
    stretches of bytes, comma-joined) and ``n_shared`` (of ``shared_strings``)."""
    number = lambda c: c.cast("long")
    every = repeats(docs, length)
    found = every.select(
        "id",
        "print",
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        number(F.size("spans")).alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        number(F.octet_length("kept")).alias("n_kept"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
    )
    found = written(found, "removed")
    discard(*every.read_from)
    size, none = number(F.octet_length("text")), F.lit(0).cast("long")
    rest = _identified(docs).select("id", "print", "doc_id", size.alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), size.alias("n_kept"), F.lit("").alias("spans"))
    rest = rest.join(found.select("id", "print").distinct(), ["id", "print"], "left_anti")
    whole = rest.unionByName(found).join(shared_strings(docs, words), ["id", "print"], "left")
    return whole.withColumn("n_shared", F.coalesce("n_shared", none)).drop("id", "print")
