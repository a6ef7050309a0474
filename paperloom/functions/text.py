"""Column functions on text. Whitespace is what Python's str.isspace means, which is wider than SQL's.

A value is located exactly, then with runs of whitespace as one space, then in compatibility form (NFKC) as well. The first two stay in
the JVM; a Python function sees only rows that both have missed and that have a character beyond ASCII, as others have no other form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import let

SPACE = r"(?U)[\s\x1c-\x1f]"
RANGE = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", " ")


def located(text: Column, value: Column) -> Column:
    """Lowest exact occurrence as a range; an empty value is at 0, a miss is null."""
    at = F.call_function("locate", value, text)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.when(value == "", span(F.lit(0), F.lit(0))).when(at > 0, span(at - 1, at - 1 + F.length(value)))


Mapped = tuple[str, Sequence[int]]
#: Runs of characters that NFKC may change, and runs of whitespace that are not one plain space.
_BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")
_RUN = re.compile(r"\s{2,}|[^\S ]")


def _runs(text: str) -> Iterator[tuple[int, int]]:
    return (found.span() for found in _RUN.finditer(text))


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """Each character beyond ASCII with the combining marks after it; marks at the head of a run belong to the character before."""
    for found in _BEYOND_ASCII.finditer(text):
        begin, end = found.span()
        starts = [i for i in range(begin, end) if unicodedata.category(text[i])[0] != "M"]
        if not starts or starts[0] != begin:
            starts.insert(0, max(begin - 1, 0))
        yield from zip(starts, [*starts[1:], end], strict=True)


def _compose(text: str) -> Mapped:
    """NFKC of each character with the combining marks after it; the j-th character of the result stands for the j-th of them. What is
    its own NFKC is copied as a whole."""
    out, origins, at = [], [], 0
    for begin, end in _segments(text):
        new = unicodedata.normalize("NFKC", text[begin:end])
        if new != text[begin:end]:
            out += (text[at:begin], new)
            origins += range(at, begin)
            origins += (min(begin + j, end - 1) for j in range(len(new)))
            at = end
    if not out:
        return text, range(len(text))
    origins += range(at, len(text))
    return "".join((*out, text[at:])), origins


def _find(text: str, value: str, normal: Callable[[str], Mapped]) -> tuple[int, int] | None:
    """Where the whitespace-collapsed ``normal`` form of ``value`` is in that of ``text``. Only a hit's two ends are traced back."""
    wanted = _RUN.sub(" ", normal(value)[0])
    if not wanted:
        return None
    whole, origins = normal(text)
    at = _RUN.sub(" ", whole).find(wanted)
    if at < 0:
        return None
    first, past = _uncollapsed(whole, at), _uncollapsed(whole, at + len(wanted))
    return origins[first], origins[past] if past < len(origins) else len(text)


def _uncollapsed(text: str, place: int) -> int:
    """The place in ``text`` of one in its collapsed form; a space stands for its run's first character."""
    for begin, end in _runs(text):
        if place <= begin:
            break
        place += end - begin - 1
    return place


def whitespace_range(text: Column, value: Column) -> Column:
    """Where ``value`` is in ``text`` if runs of whitespace count as one space, as a range of ``text``; a space stands for its whole run.
    Null for a miss, and for null or empty texts and values.

    A place of the shortened text is moved on by what the runs before it are longer than a space: the lengths of the runs are an
    array, and as many of them count as there are spaces ahead of the place."""

    def origin(held: Column, place: Column) -> Column:
        ahead = F.substring(held["short"], F.lit(1), place)
        spaces = F.length(ahead) - F.length(F.replace(ahead, F.lit(" "), F.lit("")))
        return place + F.aggregate(F.slice(held["runs"], F.lit(1), spaces), F.lit(0), lambda a, b: a + b) - spaces

    def found(held: Column) -> Column:
        span = lambda at: F.struct(origin(held, at - 1).cast("int").alias("start"), origin(held, at - 1 + F.length(held["wanted"])).cast("int").alias("end"))
        return let(F.call_function("locate", held["wanted"], held["short"]), lambda at: F.when(at > 0, span(at)))

    runs = F.transform(F.regexp_extract_all(text, F.lit(f"{SPACE}+"), F.lit(0)), F.length)
    held = F.struct(collapsed(text).alias("short"), collapsed(value).alias("wanted"), runs.alias("runs"))
    return F.when((text != "") & (value != ""), let(held, found))


@F.pandas_udf(RANGE)
def nfkc_range(texts: pd.Series, values: pd.Series) -> pd.DataFrame:
    """The same in compatibility form; null texts and values cost nothing."""
    found = [_find(t, v, _compose) if t and v else None for t, v in zip(texts, values, strict=True)]
    return pd.DataFrame({"start": pd.array([f and f[0] for f in found], "Int32"), "end": pd.array([f and f[1] for f in found], "Int32")})


def match(rows: DataFrame, text: str = "text", value: str = "value") -> DataFrame:
    """``rows`` with ``match_method`` (direct, whitespace, nfkc; null for a miss) and ``match_start, match_end``.

    One pass: the Python function gets nulls for rows that it cannot help. A null or empty text, or a null value, is a miss; an empty
    value is at 0; rows are kept as often as they occur."""
    tried = rows.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(value).alias("value"))
    tried = tried.withColumn("hit", located(F.col("text"), F.col("value")))
    tried = tried.withColumn("near", F.when(F.col("hit").isNull(), whitespace_range(F.col("text"), F.col("value"))))
    other = F.col("hit").isNull() & F.col("near").isNull() & (F.col("text").rlike(r"[^\x00-\x7f]") | F.col("value").rlike(r"[^\x00-\x7f]"))
    open_text, open_value = (F.when(other, F.col(c)) for c in ("text", "value"))
    tried = tried.select("row", "hit", "near", nfkc_range(open_text, open_value).alias("far"))
    first = lambda part: F.coalesce(*(F.col(f"{c}.{part}") for c in ("hit", "near", "far"))).alias(f"match_{part}")
    method = F.when(F.col("hit").isNotNull(), "direct").when(F.col("near").isNotNull(), "whitespace").when(F.col("far.start").isNotNull(), "nfkc").alias("match_method")
    return tried.select("row.*", method, first("start"), first("end"))
