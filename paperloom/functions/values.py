"""Column helpers that SQL has no function for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: inside lambdas an expression is else computed for each element."""
    return F.transform(F.array(value), use)[0]


def members(value: Column) -> Column:
    """The members of a variant that is an object, by name; null for others."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """The elements of a variant that is an array; null for others."""
    return F.try_variant_get(value, "$", "array<variant>")


def number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def json_kind(value: Column) -> Column:
    """object, array, string, boolean, null, integer (whole numbers however they are written) or number of a variant."""
    scalar = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None))
        .when(F.is_variant_null(value), "null")
        .when(members(value).isNotNull(), "object")
        .when(elements(value).isNotNull(), "array")
        .when(scalar == "STRING", "string")
        .when(scalar == "BOOLEAN", "boolean")
        .when(number(value) % 1 == 0, "integer")  # floor() is a long, which large numbers are beyond
        .otherwise("number")
    )
