"""Column expressions that SQL has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, CHUNK = 128, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: inside lambdas an expression is else computed for each element."""
    return F.transform(F.array(value), use)[0]


def running(numbers: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of all elements before each element, 0 being neutral, by way of blocks, so that no array is rebuilt for
    each element."""
    total = lambda a: F.aggregate(a, F.lit(0), combine)

    def of_blocks(a: Column, sums: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(sums) - 1), lambda b: total(F.slice(sums, F.lit(1), b)))
        return let(before, lambda ahead: F.transform(a, lambda _, i: combine(ahead[(i / BLOCK).cast("int")], total(F.slice(a, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))

    def made(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(a) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(a, b * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(a) > 0, let(blocks, lambda sums: of_blocks(a, sums))).otherwise(F.array().cast("array<int>"))

    return let(numbers, made)


def running_sums(numbers: Column) -> Column:
    """The sum of all elements before each element."""
    return running(numbers, lambda a, b: a + b)


def merged(spans: Column) -> Column:
    """Runs (start, end) of overlapping ``spans``, structs in order of start."""

    def joined(s: Column, before: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: s[i]["start"] >= before[i])
        end = lambda h, k: F.coalesce(F.get(before, F.get(h, k + 1)), F.array_max(F.transform(s, lambda x: x["end"])))
        return let(heads, lambda h: F.transform(h, lambda i, k: F.struct(s[i]["start"].alias("start"), end(h, k).alias("end"))))

    some = lambda s: let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda before: joined(s, before))
    return let(spans, lambda s: F.when(F.size(s) > 0, some(s)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def chunked(text: Column) -> Column:
    """``text`` in stretches of ``CHUNK`` code points, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part(chunks: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` on of a chunked text."""
    first, last = (start / CHUNK).cast("int"), ((start + size - 1) / CHUNK).cast("int")
    return F.when(size > 0, F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start % CHUNK + 1, size)).otherwise(F.lit(""))


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """``text`` with each run of overlapping ``spans`` (in order of start) replaced by what ``by`` makes of its length."""

    def cut(runs: Column, chunks: Column, size: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(F.lit(0))
        parts = F.transform(runs, lambda r, i: F.concat(part(chunks, before(i), r["start"] - before(i)), by(r["end"] - r["start"])))
        last = F.element_at(runs, -1)["end"]
        return F.concat(F.array_join(parts, ""), part(chunks, last, size - last))

    held = F.struct(chunked(text).alias("chunks"), F.length(text).alias("size"))
    return F.when(F.size(spans) > 0, let(merged(spans), lambda runs: let(held, lambda h: cut(runs, h["chunks"], h["size"])))).otherwise(text)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches, leftmost and not overlapping: structs of start, end (code points, end exclusive), found, and the group's text."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def placed(parts: Column) -> Column:
        starts = running_sums(F.zip_with(F.slice(parts["between"], F.lit(1), F.size(parts["found"])), parts["found"], lambda b, f: F.length(b) + F.length(f)))
        at = lambda before: F.transform(parts["found"], lambda f, i: F.struct((before[i] + F.length(parts["between"][i])).alias("start"), (before[i] + F.length(parts["between"][i]) + F.length(f)).alias("end"), f.alias("found"), parts["inner"][i].alias("inner")))
        return let(starts, at)

    empty = F.array().cast("array<struct<start:int,end:int,found:string,inner:string>>")
    return F.when(text.rlike(pattern), let(F.struct(found.alias("found"), between.alias("between"), inner.alias("inner")), placed)).otherwise(empty)
