"""The registry of skills: what files say, checks that report all problems, and lookups.

A registry table has a row for each file: ``path``, ``name, version, description, prompt, examples`` (input, output as JSON),
``output_schema`` (JSON, its keys in the file's order), ``ocr, table_mode``, and ``shape``, what is wrong with the file as a whole.

Defined results: what a file does not have, or has in another kind, is null and in ``shape``; checks of single values say nothing of
nulls; of files with one name and version the first in order of path stays; repeated rows are files of their own, all but the first
duplicates; a null path is stray; no files give no rows, and a report that the registry is empty.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import elements, json_kind
from .json_schema import levels_of, most_levels, with_violations

#: What a schema may not hold at its root, the form of names, and the settings.
COMPOSITION = ("anyOf", "oneOf", "allOf", "$ref")
SLUG = r"^[a-z0-9][a-z0-9_\-]*$"
OCR, TABLE_MODES = ("auto", "force", "off"), ("fast", "accurate")
#: What a file must be; other keys are refused.
_TEXT, _OPTIONAL = {"type": "string"}, {"type": ["string", "null"]}
_EXAMPLE = {"type": "object", "required": ["input", "output"], "additionalProperties": False, "properties": {"input": _TEXT, "output": {"type": "object"}}}
_SETTINGS = {"type": ["object", "null"], "additionalProperties": False, "properties": {"ocr": _OPTIONAL, "table_mode": _OPTIONAL}}
FILE = json.dumps({
    "type": "object",
    "required": ["name", "version", "prompt", "examples", "output_schema"],
    "additionalProperties": False,
    "properties": {
        "name": _TEXT,
        "version": {"type": "integer", "minimum": -(2**31), "maximum": 2**31 - 1},
        "description": _OPTIONAL,
        "prompt": _TEXT,
        "examples": {"type": "array", "items": _EXAMPLE},
        "output_schema": {"type": "object"},
        "docling": _SETTINGS,
    },
})


def from_files(files: DataFrame) -> DataFrame:
    """The registry table of ``files`` (path, text). Broken JSON, with repeated keys or none, is a file of nulls."""
    rows = files.select("path", "text", F.try_parse_json("text").alias("body"))
    rows = with_violations(rows, F.col("body"), F.parse_json(F.lit(FILE)), levels_of(FILE), "shape")
    at = lambda place, kind="variant": F.try_variant_get("body", f"$.{place}", kind)
    text = lambda place: F.when(json_kind(at(place)) == "string", at(place, "string"))
    part = lambda e, name: F.try_variant_get(e, f"$.{name}", "variant")
    example = lambda e: F.struct(F.when(json_kind(part(e, "input")) == "string", F.try_variant_get(e, "$.input", "string")).alias("input"), F.to_json(part(e, "output")).alias("output"))
    return rows.select(
        "path",
        text("name").alias("name"),
        F.when(json_kind(at("version")) == "integer", at("version", "int")).alias("version"),
        text("description").alias("description"),
        text("prompt").alias("prompt"),
        F.transform(elements(at("examples")), example).alias("examples"),
        F.when(json_kind(at("output_schema")) == "object", F.get_json_object("text", "$.output_schema")).alias("output_schema"),
        text("docling.ocr").alias("ocr"),
        text("docling.table_mode").alias("table_mode"),
        "shape",
    )


def _listed(*problems: Column) -> Column:
    return F.filter(F.array(*problems), lambda p: p.isNotNull())


def path_problem(path: Column) -> Column:
    """Null for ``<name>/<stem>.yaml``."""
    return F.when(path.endswith(".yml"), "bad_extension").when(~F.coalesce(path.rlike(r"^[^/]+/[^/]+\.yaml$"), F.lit(False)), "stray")


def placed(skills: DataFrame) -> DataFrame:
    return skills.where(path_problem(F.col("path")).isNull())


def row_problems(skills: DataFrame) -> DataFrame:
    """``path, problem`` of well-placed files: what is wrong with their shape, as place: rule, and rules of single values."""
    stem, folder = F.regexp_extract("path", r"([^/]+)\.yaml$", 1), F.regexp_extract("path", "^([^/]+)/", 1)
    number = F.when(stem.rlike("^[+-]?[0-9]+$"), stem.try_cast("int"))
    problems = _listed(
        F.when(~F.col("name").rlike(SLUG), "name_not_a_slug"),
        F.when(F.col("version") <= 0, "version_not_positive"),
        F.when(F.col("prompt") == "", "prompt_empty"),
        F.when(F.size("examples") == 0, "no_examples"),
        F.when(number.isNull(), "stem_not_an_integer"),
        F.when(number != F.col("version"), "stem_is_not_version"),
        F.when(folder != F.col("name"), "folder_is_not_name"),
    )
    shape = F.transform("shape", lambda v: F.concat(v["place"], F.lit(": "), v["rule"]))
    return placed(skills).select("path", F.explode(F.concat(shape, problems)).alias("problem"))


def schema_problems(skills: DataFrame) -> DataFrame:
    """``path, problem``: unsupported composition at the root, and schemas that permit an object but declare no property."""
    schema = F.col("output_schema")
    used = F.array_intersect(F.array(*map(F.lit, COMPOSITION)), F.json_object_keys(schema))
    kind = F.get_json_object(schema, "$.type")
    permits = kind.isNull() | (kind == "object") | (kind.startswith("[") & F.coalesce(F.array_contains(F.from_json(kind, "array<string>"), "object"), F.lit(False)))
    declared = F.coalesce(F.size(F.json_object_keys(F.get_json_object(schema, "$.properties"))), F.lit(0))
    problem = F.when(F.size(used) > 0, F.concat(F.lit("composition:"), F.array_join(used, ","))).when(permits & (declared <= 0), "no_properties")
    return placed(skills).where("output_schema is not null").select("path", problem.alias("problem")).where("problem is not null")


def example_problems(skills: DataFrame) -> DataFrame:
    """``path, example_no, place, rule``: where examples break their skill's schema, whatever it is. A schema that is no JSON object
    breaks nothing here; it is a problem of its own."""
    levels = most_levels(skills, "output_schema")
    rows = placed(skills).select("path", "output_schema", F.posexplode("examples").alias("example_no", "example"))
    rows = with_violations(rows, F.try_parse_json("example.output"), F.try_parse_json("output_schema"), levels)
    return rows.select("path", "example_no", F.inline("violations"))


def duplicates(skills: DataFrame) -> DataFrame:
    """``path, kept_path``: files that repeat the name and version of one before them in order of path."""
    order = Window.partitionBy("name", "version").orderBy("path")
    rows = placed(skills).where("name is not null and version is not null").select("path", F.first("path").over(order).alias("kept_path"), F.row_number().over(order).alias("n"))
    return rows.where("n > 1").drop("n")


def report(problems: DataFrame, skills: DataFrame) -> DataFrame:
    """One row: how many problems and files with problems there are, whether the registry is refused, and whether it has no files,
    which is only a warning. The texts stay in the table of problems, which is the report; one row cannot hold those of a large registry."""
    both = problems.select("path", F.lit(True).alias("bad")).unionByName(skills.select("path", F.lit(False).alias("bad")))
    n = F.count_if("bad")
    return both.agg(n.alias("n_problems"), F.count_distinct(F.when(F.col("bad"), F.col("path"))).alias("n_files"), (n > 0).alias("refused"), (F.count_if(~F.col("bad")) == 0).alias("empty"))


def problems(skills: DataFrame) -> DataFrame:
    """All of them: ``path, problem``."""
    misplaced = skills.select("path", path_problem(F.col("path")).alias("problem")).where("problem is not null")
    return (
        misplaced.unionByName(row_problems(skills))
        .unionByName(schema_problems(skills))
        .unionByName(example_problems(skills).select("path", F.concat(F.lit("example "), F.col("example_no").cast("string"), F.lit(": "), F.col("place"), F.lit(": "), F.col("rule")).alias("problem")))
        .unionByName(duplicates(skills).select("path", F.concat(F.lit("duplicate of "), F.col("kept_path")).alias("problem")))
    )


def latest(skills: DataFrame) -> DataFrame:
    """The highest version of each name."""
    return skills.groupBy("name").agg(F.max("version").alias("version"))


def lookup(requests: DataFrame, skills: DataFrame) -> DataFrame:
    """``requests`` with the ``version`` they mean and, where there is none, an error ``code``."""
    asked = F.col("skill_version")
    newest = latest(skills).select(F.col("name").alias("skill_name"), F.col("version").alias("latest"))
    rows = requests.join(newest, "skill_name", "left").withColumn("wanted", F.when(asked == "latest", F.col("latest")).otherwise(F.when(asked.rlike("^[0-9]+$"), asked.try_cast("int"))))
    known = skills.select(F.col("name").alias("skill_name"), F.col("version").alias("wanted"), F.lit(True).alias("known")).distinct()
    rows = rows.join(known, ["skill_name", "wanted"], "left")
    code = F.when(~asked.rlike("^(latest|[1-9][0-9]*)$"), "VALIDATION_FAILED").when(F.col("known").isNull(), "SKILL_NOT_FOUND")
    return rows.select(*requests.columns, F.when(code.isNull(), F.col("wanted")).alias("version"), code.alias("code"))


def knobs(skills: DataFrame, ocr: str = "auto", table_mode: str = "accurate") -> DataFrame:
    """Effective parser settings: a skill's own, else the default; ``bad`` where one is unknown."""
    own = {"ocr": F.coalesce("ocr", F.lit(ocr)), "table_mode": F.coalesce("table_mode", F.lit(table_mode))}
    rows = skills.select("path", *(c.alias(n) for n, c in own.items()))
    return rows.withColumn("bad", ~(F.col("ocr").isin(*OCR) & F.col("table_mode").isin(*TABLE_MODES)))
