"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from its code point, so no alphabet is set beforehand. A letter trigram is the
product of its letters' vectors, each rotated by its place; a text is the sum of its trigrams' vectors, a language the sum of its
texts. A text is given the language whose vector has the largest cosine with its own. As sums are linear, the texts' vectors are
their trigram counts times the trigrams' vectors, computed for ``PART`` trigrams and ``GROUP_CHARS`` characters at a time; a longer
text is counted in segments, so what a task holds does not depend on the length of texts or on their scripts. Sums are of whole
numbers, so profiles do not depend on the partitioning. They are gathered by an aggregation over all labelled rows; the driver
holds a vector for each language.

Letters are lower-cased; all else separates words.

Defined results: a text that is null or has no letter is ``und`` with score 0; ties go to the first language in order of name;
without any labelled row every text is ``und``; a labelled row without a doc_id is not held out; rows are judged one by one, so
repeated rows get equal answers, and count as often as they occur in learning; an empty table gives no rows; lang, source and
doc_id are not looked at in a prediction; other columns are ignored or, if named in ``keep``, kept whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 1024
UNKNOWN = "und"
#: Characters, texts and trigrams that are looked at at once.
GROUP_CHARS, GROUP_TEXTS, PART = 1 << 19, 128, 2048
#: Counts of up to so many possible trigrams are kept in a table, of more by sorting; results are equal.
DENSE = 1 << 18


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool)


def _signs(letters: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """A vector of signs for each code point, from the bits of a multiplicative hash, so that every worker has the same."""
    out = np.empty((len(letters), dimensions), np.int8)
    for at in range(0, len(letters), 256):
        x = letters[at : at + 256].astype(np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = (x ^ (x >> np.uint64(31))) & np.uint64(1)
        out[at : at + 256] = np.where(bits == 1, 1, -1)
    return out


def _segments(text: str) -> Iterator[np.ndarray]:
    """The text as code points of letters and single separators (0), one at either end, in segments that share two of them."""
    text = text.lower()
    held = np.zeros(1, np.uint32)
    for at in range(0, len(text), GROUP_CHARS):
        codes = np.frombuffer(text[at : at + GROUP_CHARS].encode("utf-32-le", "surrogatepass"), np.uint32)
        last = np.zeros(int(at + GROUP_CHARS >= len(text)), np.uint32)
        held = np.concatenate((held, np.where(_is_letter()[codes], codes, 0), last))
        held = held[np.concatenate(([True], (held[1:] != 0) | (held[:-1] != 0)))]
        if len(held) > 2:
            yield held
        held = held[-2:]


def _groups(texts: list[str], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and segments of about ``most`` code points."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _segments(text):
            if rows and size + len(part) > most:
                yield rows, parts
                rows, parts, size = [], [], 0
            rows.append(i)
            parts.append(part)
            size += len(part)
    if rows:
        yield rows, parts


def _added(sums: np.ndarray, rows: list[int], parts: list[np.ndarray], seed: int) -> None:
    """Add the vectors of the parts' trigrams to the ``sums`` of their rows."""
    whole = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    inner = np.ones(len(whole), bool)
    inner[np.concatenate((ends - 1, ends - 2))] = False
    letters = np.flatnonzero(np.bincount(whole))
    place = np.zeros(letters[-1] + 1, np.int64)
    place[letters] = np.arange(len(letters))
    many, own = len(letters), place[whole]
    at = np.flatnonzero(inner)
    ids = (own[at] * many + own[at + 1]) * many + own[at + 2]
    row = np.repeat(rows, [len(p) - 2 for p in parts])
    if many**3 <= DENSE:
        known = np.flatnonzero(np.bincount(ids))
        nth = np.zeros(known[-1] + 1, np.int64)
        nth[known] = np.arange(len(known))
        nth = nth[ids]
    else:
        known, nth = np.unique(ids, return_inverse=True)
    signs = _signs(letters, sums.shape[1], seed)
    first, second, third = np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1), signs
    for start in range(0, len(known), PART):
        part = known[start : start + PART]
        here = slice(None) if len(known) <= PART else (nth >= start) & (nth < start + PART)
        counts = np.bincount(row[here] * len(part) + nth[here] - start, minlength=len(sums) * len(part)).reshape(len(sums), -1)
        sums += counts.astype(sums.dtype) @ (first[part // many**2] * second[part // many % many] * third[part % many]).astype(sums.dtype)


class Profiles:
    """Unit vectors of languages, in order of name."""

    def __init__(self, names: list[str], vectors: np.ndarray, seed: int):
        self.names, self.seed = names, seed
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = np.divide(vectors, norms, out=np.zeros_like(vectors, dtype=float), where=norms > 0).astype(np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names: list[str] = []
        scores = []
        for start in range(0, len(texts), GROUP_TEXTS):
            held = [t or "" for t in texts[start : start + GROUP_TEXTS]]
            vectors = np.zeros((len(held), self.vectors.shape[1]), np.float32)
            for rows, parts in _groups(held, GROUP_CHARS):
                _added(vectors, rows, parts, self.seed)
            norms = np.linalg.norm(vectors, axis=1)
            if not self.names:
                norms[:] = 0
            some = norms > 0
            best, sure = np.zeros(len(held), int), np.zeros(len(held))
            if some.any():
                cosines = (vectors[some] @ self.vectors.T) / norms[some, None]
                best[some] = cosines.argmax(axis=1)
                sure[some] = cosines.max(axis=1)
            names += [self.names[b] if ok else UNKNOWN for b, ok in zip(best, some, strict=True)]
            scores.append(np.clip(sure, 0.0, 1.0))
        return names, np.concatenate(scores).astype(float) if scores else np.empty(0)


def learn(labelled: DataFrame, dimensions: int = DIMENSIONS, seed: int = 1) -> Profiles:
    """Profiles from all rows of ``text, lang`` with neither null."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                held = totals.setdefault(lang, np.zeros((1, dimensions)))
                for rows, parts in _groups(texts.tolist(), GROUP_CHARS):
                    _added(held, [0] * len(rows), parts, seed)
            if len(totals) > 256:  # bounds what a task holds
                yield from listed(totals)
                totals = {}
        yield from listed(totals)

    def listed(totals: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
        for lang, held in totals.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(dimensions), "part": held[0].astype(np.int64)})

    rows = labelled.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text")
    bundles = rows.mapInPandas(count, "lang string, place int, part long").groupBy("lang", "place").agg(F.sum("part").alias("whole"))
    found = bundles.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "whole"))).alias("vector")).orderBy("lang").collect()  # a row for each language
    vectors = np.array([[v["whole"] for v in r["vector"]] for r in found], float).reshape(-1, dimensions)
    return Profiles([r["lang"] for r in found], vectors, seed)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row``, a struct of the columns ``keep`` of ``docs``, then ``lang_pred`` and ``score``; the prediction sees ``text`` alone."""
    rows = docs.select(F.col("text"), F.struct(*keep).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = profiles.predict(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

    return rows.mapInArrow(judge, schema)


def held_out(fold: int = 0, folds: int = 5) -> Column:
    """True for rows that are not learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learn from the labelled rows that are not held out and predict all rows."""
    held = F.coalesce(held_out(), F.lit(False))
    judged = predict(docs.select("doc_id", "text", held.alias("held_out")), learn(docs.where(~held)), ("doc_id", "held_out"))
    return judged.select("row.*", "lang_pred", "score")


def recognised(docs: DataFrame, least: float) -> DataFrame:
    """The rows of ``docs`` whose text resembles a language learned from the labelled rows that are not held out, with a score of
    ``least`` or more. Columns of ``docs`` are kept whatever their names."""
    judged = predict(docs, learn(docs.where(~F.coalesce(held_out(), F.lit(False)))), tuple(f"`{c}`" for c in docs.columns))
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
