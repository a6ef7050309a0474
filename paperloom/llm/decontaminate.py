"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased words with single spaces between them. An item of n characters may differ by
e = floor(n * rate) edits. Cut into e + 1 pieces, an occurrence with at most e edits holds one of them unchanged; all pieces are
looked up at once by an Aho-Corasick automaton, and around each hit Myers' bit-parallel algorithm finds the least distance of the
item to any substring. Before the whole item, growing runs of its pieces are verified around a hit: the pieces are halved again
and again, and of two halves of k pieces in all, one has fewer errors than pieces if the whole has fewer than k. An item too short for
an error is found as whole words only: "art" is in "the art of" and not in "party".

The items are written to the shared folder in blocks of about ``block_chars`` characters, and tasks read them there, so the driver
knows only how many blocks there are. Documents are scanned once and not shuffled. A worker holds the automata of ``HELD_BLOCKS``
blocks (130 MB each); with more blocks a task gathers ``GATHERED_CHARS`` of documents, looks them up in one block after another and
builds the automata anew for the next ones. In a trial, building took 1.5 s a block and looking up 2 MB of documents 15 s.

Defined results: a null or wordless text or item matches nothing; repeated documents or items are matched each; one row for each
document row and item, with the least distance and, of equal ones, the first end; an empty table gives no rows; a null id is kept;
other columns are ignored by ``leaks`` and kept, whatever their names, by ``without_leaks``.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import files_of, new_path

RATE = 0.1
BLOCK_CHARS, GATHERED_CHARS, HELD_BLOCKS = 1 << 21, 1 << 24, 4


def words(text: str) -> Column:
    """Lower-cased words of letters and digits with a single space between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``item`` cut into ``errors + 1`` pieces of nearly equal length, with their places."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def bounded(text: str, start: int, end: int) -> bool:
    """Whether words begin at ``start`` and end at ``end``."""
    return (start <= 0 or text[start - 1] == " ") and (end >= len(text) or text[end] == " ")


class Myers:
    """Edit distances of one pattern to substrings of texts, a column of the table in one word of as many bits."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.places: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.places[c] |= 1 << i

    def scores(self, text: str, anchored: bool = False) -> Iterator[int]:
        """For each prefix of ``text`` the least distance of the pattern to a suffix of it; if anchored, to all of it."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, score = full, 0, self.size
        get = self.places.get
        for c in text:
            equal = get(c, 0)
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (full & ~(across | plus)), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1 | anchored) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
            yield score


def runs(many: int) -> list[list[tuple[int, int]]]:
    """For each of so many pieces, the runs of pieces (first, past the last) that it is halved out of, smallest first."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(many)]

    def halve(first: int, past: int) -> None:
        if past - first > 1:
            middle = (first + past + 1) // 2
            halve(first, middle)
            halve(middle, past)
            for k in range(first, past):
                out[k].append((first, past))

    halve(0, many)
    return out


class Matcher:
    def __init__(self, items: tuple[tuple[int | None, str, int], ...], rate: float):
        """``items``: id, words, how often it occurs."""
        import ahocorasick

        self.items, places = items, defaultdict(list)
        self.errors = [budget(text, rate) for _, text, _ in items]
        self.cuts = [pieces(text, e) for (_, text, _), e in zip(items, self.errors, strict=True)]
        for k, cuts in enumerate(self.cuts):
            for j, (at, piece) in enumerate(cuts):
                places[piece].append((k, j, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, of in places.items():
            self.automaton.add_word(piece, of)
        if places:
            self.automaton.make_automaton()
        self.some = bool(places)
        self.forward, self.backward = functools.cache(lambda k: Myers(items[k][1])), functools.cache(lambda k: Myers(items[k][1][::-1]))
        self.runs = functools.cache(runs)
        self.run = functools.lru_cache(1 << 14)(self._run)

    def _run(self, k: int, first: int, past: int) -> tuple[Myers, int, int]:
        """The pattern of a run of pieces, its place and its length."""
        begin, end = self.cuts[k][first][0], self.cuts[k][past - 1][0] + len(self.cuts[k][past - 1][1])
        return Myers(self.items[k][1][begin:end]), begin, end - begin

    def likely(self, text: str, k: int, j: int, start: int) -> bool:
        """Whether the runs around piece ``j``, short of the whole item, have fewer errors than pieces if the item begins near ``start``."""
        for first, past in self.runs(len(self.cuts[k]))[j][:-1]:
            pattern, at, size = self.run(k, first, past)
            most = past - first - 1
            begin = max(0, start + at - most)
            if not any(score <= most for score in pattern.scores(text[begin : max(0, start + at + size + most)])):
                return False
        return True

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item with a piece in ``text``, the stretches in which an occurrence can lie."""
        hits: dict[int, set[int]] = defaultdict(set)
        for end, of in self.automaton.iter(text):
            for k, j, at, size in of:
                start = end + 1 - size - at
                if start not in hits[k] and (self.likely(text, k, j, start) if self.errors[k] else bounded(text, start, end + 1)):
                    hits[k].add(start)
        out = {}
        for k, starts in hits.items():
            merged: list[list[int]] = []
            slack, size = self.errors[k], len(self.items[k][1])
            for s in sorted(starts):
                begin, end = max(0, s - slack), min(len(text), s + size + slack)
                if merged and begin <= merged[-1][1]:
                    merged[-1][1] = end
                elif end > begin:
                    merged.append([begin, end])
            if merged:
                out[k] = merged
        return out

    def nearest(self, text: str, k: int, windows: list[list[int]]) -> tuple[int, int, int] | None:
        """Distance, start and end of the best occurrence within the error budget."""
        item, best = self.items[k][1], (self.errors[k] + 1, 0, 0)
        for begin, end in windows:
            at = text.find(item, begin, end)
            if at >= 0:
                return 0, at, at + len(item)
        for begin, end in windows:
            for i, score in enumerate(self.forward(k).scores(text[begin:end])):
                if score < best[0]:
                    best = score, begin, begin + i + 1
        distance, begin, end = best
        if distance > self.errors[k]:
            return None
        back = text[max(begin, end - len(item) - distance) : end][::-1]
        length = next(i + 1 for i, score in enumerate(self.backward(k).scores(back, True)) if score == distance)
        return distance, end - length, end

    def leaks(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """Item, distance, start and end of every item that occurs in ``text``."""
        if self.some and text:
            for k, windows in sorted(self.windows(text).items()):
                if found := self.nearest(text, k, windows):
                    for _ in range(self.items[k][2]):
                        yield self.items[k][0], *found


@dataclass(frozen=True)
class Items:
    """Where the benchmark's items are, in how many blocks."""

    path: str
    blocks: int


def items_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Items:
    """Write the items as words, dealt out to blocks; repeated ones are written once, with how often they occur."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words("text").alias("words")).where("words <> ''")
    rows = rows.groupBy("item_id", "words").agg(F.count("*").alias("times"))
    blocks = -(-(rows.agg(F.sum(F.length("words"))).first()[0] or 0) // block_chars)  # one number
    out = Items(new_path(benchmark.sparkSession, "items"), blocks)
    if blocks:
        rows.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks))).write.partitionBy("block").parquet(out.path)
    return out


@functools.lru_cache(maxsize=HELD_BLOCKS)
def _matcher(items: Items, block: int, rate: float) -> Matcher:
    import pyarrow.parquet as pq

    system, names = files_of(f"{items.path}/block={block}")
    rows = [r for n in names for r in pq.ParquetFile(system.open_input_file(n)).read().to_pylist()]
    return Matcher(tuple((r["item_id"], r["words"], r["times"]) for r in sorted(rows, key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["words"]))), rate)


def _found(texts: list[str], items: Items, rate: float, open_rows: Callable[[int], bool] = lambda _: True) -> Iterator[tuple[int, tuple]]:
    """Row and leak (item, distance, start, end) for all leaks of ``texts``, block by block; rows that are no longer open are not looked at."""
    for block in range(items.blocks):
        matcher = _matcher(items, block, rate)
        for i, text in enumerate(texts):
            if open_rows(i):
                for leak in matcher.leaks(text):
                    yield i, leak


def _gathered(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if blocks <= HELD_BLOCKS or size > GATHERED_CHARS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, start, end`` (in the words of the text) of every item that a document holds."""
    items = items_of(benchmark, block_chars)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("words"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, items.blocks):
            ids = table.column(0).to_pylist()
            found = [(ids[i], *leak) for i, leak in _found(table.column(1).to_pylist(), items, rate)]
            if found:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["doc_id", "item_id", "distance", "start", "end"])

    return rows.mapInArrow(search, "doc_id long, item_id long, distance int, start int, end int")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    items = items_of(benchmark, block_chars)
    rows = docs.select(F.struct("*").alias("row"), words("text").alias("words"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, items.blocks):
            dirty: set[int] = set()
            for i, _ in _found(table.column(1).to_pylist(), items, rate, lambda i, dirty=dirty: i not in dirty):
                dirty.add(i)
            keep = pa.array((i not in dirty for i in range(len(table))), pa.bool_())
            yield from table.select([0]).filter(keep).to_batches()

    return rows.mapInArrow(clean, T.StructType([rows.schema["row"]])).select("row.*")
