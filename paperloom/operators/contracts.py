"""Message contracts and snapshots.

Defined results: a null text is empty, and so is one of white space alone, as Python means it; names are letters, digits and
underscores of any script; of repeated keys each is judged; null codes and keys match nothing; empty tables have no problems but those
of what they lack.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Kinds of parameters, the forms of codes and parameter names, and what refers to a parameter.
KINDS = ("string", "integer", "number", "boolean")
CODE, NAME = "^[A-Z][A-Z0-9_]*$", "^[a-zA-Z_][a-zA-Z0-9_]*$"
REFERENCE = r"(?U)\{\{(\w+)\}\}"


def catalogue_problems(codes: DataFrame) -> DataFrame:
    """``code, problem`` of ``codes`` (code, http_status, params: name, type)."""
    own = F.filter(F.array(F.when(~F.col("code").rlike(CODE), "bad_code"), F.when(~F.col("http_status").between(400, 599), "bad_status")), lambda p: p.isNotNull())
    names = F.transform(F.filter("params", lambda p: ~p["name"].rlike(NAME)), lambda p: F.concat(F.lit("bad_param:"), p["name"]))
    kinds = F.transform(F.filter("params", lambda p: ~p["type"].isin(*KINDS)), lambda p: F.concat(F.lit("bad_type:"), p["name"]))
    return codes.select("code", F.explode(F.concat(own, names, kinds)).alias("problem"))


def required_keys(params: DataFrame, codes: DataFrame) -> DataFrame:
    """``code, params``: each code's parameter names, sorted; ``params`` are rows of code, name."""
    named = params.groupBy("code").agg(F.array_sort(F.collect_list("name")).alias("params"))
    return codes.select("code").distinct().join(named, "code", "left").select("code", F.coalesce("params", F.array().cast("array<string>")).alias("params"))


def translation_problems(required: DataFrame, translations: DataFrame, languages: tuple[str, ...] = ()) -> DataFrame:
    """``lang, key, problem`` of ``translations`` (lang, key, text) against ``required`` (code, params). ``languages`` are those that
    must be there; one without any translation has one problem, ``missing_language``. The driver holds the names of the languages."""
    found = {r["lang"] for r in translations.select("lang").distinct().collect()} - {None}
    wanted = required.select(F.col("code").alias("key"), "params", F.explode(F.array(*map(F.lit, sorted(found))).cast("array<string>")).alias("lang"))
    rows = wanted.withColumn("wanted", F.lit(True)).join(translations.withColumn("given", F.lit(True)), ["lang", "key"], "full")
    used = F.array_distinct(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)))
    blank = F.col("text").isNull() | (strip(F.col("text")) == "")
    named = lambda kind, names: F.transform(names, lambda n: F.concat(F.lit(kind), n))
    problems = (
        F.when(F.col("given").isNull(), F.array(F.lit("missing_key")))
        .when(F.col("wanted").isNull(), F.array(F.lit("extra_key")))
        .when(blank, F.array(F.lit("empty")))
        .otherwise(F.concat(named("missing_param:", F.array_except("params", used)), named("undefined_param:", F.array_except(used, "params"))))
    )
    lacking = F.array(*map(F.lit, sorted(set(languages) - found))).cast("array<string>")
    whole = required.sparkSession.range(1).select(F.explode(lacking).alias("lang"), F.lit(None).cast("string").alias("key"), F.lit("missing_language").alias("problem"))
    return rows.select("lang", "key", F.explode(problems).alias("problem")).unionByName(whole)


def drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``path, drift`` (missing, extra, differs) of two tables of path, content."""
    digest = lambda df, name: df.select("path", F.sha2("content", 256).alias(name))
    rows = digest(expected, "want").join(digest(actual, "have"), "path", "full")
    kind = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "differs")
    return rows.select("path", kind.alias("drift")).where("drift is not null")
