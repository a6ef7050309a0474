"""JSON values held against JSON schemas, both of them data.

Value and schema are variants of a row. They are walked down together, a level at a time: each pair of a value and the schema for it
gives its violations and the pairs below it (properties, other members, items), all within the row and in the JVM, so nothing is
shuffled and a row's own schema decides. How many levels there are follows from the schemas: ``levels_of`` for a known one,
``most_levels`` for a column of them, which sends one number to the driver.

Of JSON Schema it knows type, enum, const, required, properties, additionalProperties, items (one schema for all), minimum, maximum,
minLength, maxLength, minItems, maxItems, and true and false as schemas. A whole number is an integer however it is written, booleans
are no numbers, and numbers are equal if their values are. Rules for another kind of value say nothing.

Defined results: a null value (broken JSON) has the one violation ``json`` at the root; a null schema, or one that is no object or
boolean, breaks nothing; repeated rows are rows of their own; columns are kept whatever their names; no rows give none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import elements, json_kind, let, members, number

STRING = r'"(\\.|[^"\\])*"'
VIOLATIONS = "array<struct<place:string,rule:string>>"
PAIRS = "array<struct<place:string,value:variant,schema:variant>>"


def levels_of(schema: str) -> int:
    """How deep the objects of a schema's text are nested, which is more than its schemas are."""
    depth = most = 0
    for brace in re.findall("[{}]", re.sub(STRING, "", schema)):
        depth += 1 if brace == "{" else -1
        most = max(most, depth)
    return most


def most_levels(rows: DataFrame, schema: str) -> int:
    """The same for the deepest of a column of texts."""
    braces = F.regexp_extract_all(F.regexp_replace(schema, STRING, ""), F.lit("[{}]"), F.lit(0))
    step = lambda s, b: let(s["depth"] + F.when(b == "{", 1).otherwise(-1), lambda d: F.struct(d.alias("depth"), F.greatest(s["most"], d).alias("most")))
    depth = F.aggregate(braces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")), step, lambda s: s["most"])
    return rows.agg(F.max(depth)).first()[0] or 0


def _get(schema: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(schema, f"$.{name}", kind)


def _names(schema: Column, name: str) -> Column:
    """An array of strings, or a string as an array of one; null for anything else."""
    return F.coalesce(_get(schema, name, "array<string>"), F.when(json_kind(_get(schema, name)) == "string", F.array(_get(schema, name, "string"))))


def _plain(value: Column, kind: Column) -> Column:
    """A text that equal values share."""
    whole = F.coalesce(F.try_variant_get(value, "$", "decimal(38,0)").cast("string"), number(value).cast("string"))
    return F.when(kind == "integer", whole).when(kind == "number", number(value).cast("string")).otherwise(F.to_json(value))


def _broken(value: Column, schema: Column, kind: Column) -> Column:
    """The rules of ``schema`` that ``value`` breaks, some of them null."""
    same = lambda other: _plain(value, kind) == _plain(other, json_kind(other))
    is_a = lambda t: (kind == t) | ((t == "number") & (kind == "integer"))
    numeric, text = kind.isin("integer", "number"), F.try_variant_get(value, "$", "string")
    none = F.array().cast("array<string>")
    rule = lambda name, broken: F.when(broken, F.lit(name))
    wrong = F.when(_names(schema, "type").isNotNull(), ~F.exists(_names(schema, "type"), is_a))
    single = F.array(
        rule("type", wrong),
        rule("false", F.to_json(schema) == "false"),
        rule("enum", ~F.exists(_get(schema, "enum", "array<variant>"), same)),
        rule("const", ~same(_get(schema, "const"))),
        rule("minimum", numeric & (number(value) < _get(schema, "minimum", "double"))),
        rule("maximum", numeric & (number(value) > _get(schema, "maximum", "double"))),
        rule("minLength", (kind == "string") & (F.length(text) < _get(schema, "minLength", "double"))),
        rule("maxLength", (kind == "string") & (F.length(text) > _get(schema, "maxLength", "double"))),
        rule("minItems", (kind == "array") & (F.size(elements(value)) < _get(schema, "minItems", "double"))),
        rule("maxItems", (kind == "array") & (F.size(elements(value)) > _get(schema, "maxItems", "double"))),
    )
    absent = F.filter(_get(schema, "required", "array<string>"), lambda name: ~F.map_contains_key(members(value), name))
    closed = F.when(F.to_json(_get(schema, "additionalProperties")) == "false", _others(value, schema))
    named = lambda kind, names: F.coalesce(F.transform(names, lambda n: F.concat(F.lit(f"{kind}:"), n)), none)
    return F.concat(single, named("required", absent), named("unknown", closed))


def _others(value: Column, schema: Column) -> Column:
    """Names of members that the schema does not list; null for a value that is no object."""
    listed = F.coalesce(F.map_keys(_get(schema, "properties", "map<string,variant>")), F.array().cast("array<string>"))
    return F.array_except(F.map_keys(members(value)), listed)


def _violations(pair: Column) -> Column:
    broken = let(json_kind(pair["value"]), lambda kind: _broken(pair["value"], pair["schema"], kind))
    return F.transform(F.filter(broken, lambda r: r.isNotNull()), lambda r: F.struct(pair["place"].alias("place"), r.alias("rule")))


def _below(pair: Column) -> Column:
    """The pairs of members and elements with the schemas for them."""
    value, schema = pair["value"], pair["schema"]
    properties, rest = _get(schema, "properties", "map<string,variant>"), _get(schema, "additionalProperties")
    one = lambda place, value, schema: F.struct(F.concat(pair["place"], place).alias("place"), value.alias("value"), schema.alias("schema"))
    member = lambda name, schema: one(F.concat(F.lit("."), name), F.element_at(members(value), name), schema)
    listed = F.transform(F.array_intersect(F.map_keys(properties), F.map_keys(members(value))), lambda n: member(n, F.element_at(properties, n)))
    others = F.when(json_kind(rest) == "object", F.transform(_others(value, schema), lambda n: member(n, rest)))
    items = F.when(_get(schema, "items").isNotNull(), F.transform(elements(value), lambda v, i: one(F.concat(F.lit("["), i.cast("string"), F.lit("]")), v, _get(schema, "items"))))
    none = F.array().cast(PAIRS)
    return F.concat(F.coalesce(listed, none), F.coalesce(others, none), F.coalesce(items, none))


def with_violations(rows: DataFrame, value: Column, schema: Column, levels: int, name: str = "violations") -> DataFrame:
    """``rows`` with ``name``: the violations (place, rule) of ``value`` against ``schema``, sorted and distinct.

    They come out of an explode of one element: a filter on them, which would else be moved down to the scan and walk all levels once
    more for each mention of their pairs, stays above it."""
    root = F.when(json_kind(schema).isin("object", "boolean") & value.isNotNull(), F.array(F.struct(F.lit("$").alias("place"), value.alias("value"), schema.alias("schema"))))
    broken = F.when(value.isNull(), F.array(F.struct(F.lit("$").alias("place"), F.lit("json").alias("rule")))).otherwise(F.array().cast(VIOLATIONS))
    walked = rows.select(F.struct("*").alias("row"), broken.alias("found"), F.coalesce(root, F.array().cast(PAIRS)).alias("pairs"))
    below = F.flatten(F.transform("pairs", _below)).alias("pairs")  # columns that every level shares are built once
    with_own = F.concat("found", F.flatten(F.transform("pairs", _violations))).alias("found")
    for level in range(levels + 1):
        walked = walked.select("row", with_own, below) if level < levels else walked.select("row", with_own)
    return walked.select("row.*", F.explode(F.array(F.array_sort(F.array_distinct("found")))).alias(name))


def places(violations: Column) -> Column:
    """The places of ``violations``, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(violations, lambda v: v["place"])))
