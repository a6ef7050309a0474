"""Latency reports.

A report has few groups and any number of samples, so no group is taken whole into a task: percentiles come from counts of distinct
values, dealt out to ranges of values; of the warm-up only the first iterations of each task's part are compared.

Defined results: null seconds are no samples; a group without samples has null percentiles; equal values count as often as they occur;
samples of one iteration are warm-up together; an empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OVERHEAD_TARGET = 2.0
#: Ranges that values are dealt out to.
RANGES = 128
CELL = ("fixture", "mode")


def percentiles(samples: DataFrame, wanted: dict[str, float], keys: tuple[str, ...] = CELL, value: str = "seconds") -> DataFrame:
    """``*keys`` and a column for each name in ``wanted``: that percentile of ``value``, exact, by linear interpolation."""
    rows = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    cuts = rows.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)])).first()[0] or []  # RANGES numbers
    place = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c < F.col("v")))
    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("n")).withColumn("place", place)
    sums = counts.groupBy(*keys, "place").agg(F.sum("n").alias("n"))  # a row for each range and group
    along = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("n").over(along.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "place", "n", before.alias("before"), F.sum("n").over(along).alias("total"))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p / 100).alias("p")) for name, p in wanted.items())))
    ranks = sums.select("*", asked.alias("w")).withColumn("at", F.col("w.p") * (F.col("total") - 1))
    ranks = ranks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).where("rank >= before and rank < before + n")
    within = Window.partitionBy(*keys, "place").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(*keys, "place", "v", "n", F.sum("n").over(within).alias("upto"))
    ranks = ranks.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("place").alias("of_place"), "before", "at", "rank", F.col("w.name").alias("name"))
    same = F.col("place") == F.col("of_place")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = (F.col("rank") < F.col("before") + F.col("upto")) & (F.col("rank") >= F.col("before") + F.col("upto") - F.col("n"))
    found = placed.join(ranks, same & inside).groupBy(*keys, "name").agg(F.min_by("v", "rank").alias("low"), F.max_by("v", "rank").alias("high"), F.first("at").alias("at"))
    exact = F.when(F.floor("at") == F.ceil("at"), F.col("low")).otherwise((F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, exact)).alias(name) for name in wanted))


def without_warmup(samples: DataFrame, count: int = 1, keys: tuple[str, ...] = CELL) -> DataFrame:
    """``samples`` without the first ``count`` iterations of each group. Spark limits ranks before it shuffles them."""
    first = F.dense_rank().over(Window.partitionBy(*keys).orderBy("iter"))
    warm = samples.select(*keys, "iter").withColumn("nth", first).where(F.col("nth") <= count).select(*keys, "iter").distinct()
    return samples.join(warm, [*keys, "iter"], "left_anti")


def report(samples: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean, p50 and p95 for each cell of ``grid`` (fixture, mode); null where there are no samples."""
    means = samples.groupBy(*CELL).agg(F.avg("seconds").alias("mean"), F.count("*").alias("n"))
    return grid.join(means, [*CELL], "left").join(percentiles(samples, {"p50": 50, "p95": 95}), [*CELL], "left")


def against_targets(stats: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target (fixture, metric, target): the value in JSON_ONLY and whether it passes."""
    long = stats.where("mode = 'JSON_ONLY' and n > 0").select("fixture", F.inline(F.array(F.struct(F.lit("p50").alias("metric"), F.col("p50").alias("value")), F.struct(F.lit("p95").alias("metric"), F.col("p95").alias("value")))))
    return long.join(targets, ["fixture", "metric"]).withColumn("passes", F.col("value") <= F.col("target"))


def overhead(samples: DataFrame) -> DataFrame:
    """p50 of PDF_ONLY over that of JSON_ONLY for each fixture that has both."""
    halves = percentiles(samples.where("mode in ('JSON_ONLY', 'PDF_ONLY')"), {"p50": 50})
    of = lambda mode: F.max(F.when(F.col("mode") == mode, F.col("p50")))
    rows = halves.groupBy("fixture").agg((of("PDF_ONLY") - of("JSON_ONLY")).alias("overhead")).where("overhead is not null")
    return rows.withColumn("passes", F.col("overhead") <= OVERHEAD_TARGET)


def missing(expected: DataFrame, found: DataFrame, on: str = "fixture") -> DataFrame:
    return expected.select(on).distinct().join(found.select(on).distinct(), on, "left_anti")


def quality(fields: DataFrame, keys: tuple[str, ...] = ("field_name",), extracted_target: float = 0.9, grounded_target: float = 0.95) -> DataFrame:
    """Shares of declared fields that were extracted and of extracted ones that have a box."""
    extracted = F.col("status") == "extracted"
    rows = fields.groupBy(*keys).agg(F.avg(extracted.cast("int")).alias("extracted_rate"), F.avg(F.when(extracted, F.col("grounded").cast("int"))).alias("grounded_rate"))
    return rows.withColumns({"extracted_ok": F.col("extracted_rate") >= extracted_target, "grounded_ok": F.col("grounded_rate") >= grounded_target})
