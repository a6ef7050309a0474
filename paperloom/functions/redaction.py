"""Log redaction.

Defined results: nulls stay null; a map's null values stay, its keys are compared without case; repeated rows are rows of their own; no
rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that are never logged, what replaces the rest, and the patterns. What costs least is asked first at each place.
KEYS = ("pdf_bytes", "raw_output", "extracted_value", "prompt", "field_values")
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
REQUEST_ID = r"(?!(?<=(?i:request[_-]id=|x-request-id: |x-request-id:))[0-9a-fA-F]{32}\b)"
NUMBER = rf"(?U)(?=\d)\b(?<!line ){REQUEST_ID}(?:\d{{1,3}}(?:[,\s]\d{{3}})+(?:\.\d+)?|\d{{4,}}(?:\.\d+)?)\b"
CUT = "... [truncated]"


def without_emails(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "[REDACTED_EMAIL]")


def without_numbers(c: Column) -> Column:
    """Long numbers go, but not in ``line 1234`` and not as an id behind a request id's name."""
    return F.regexp_replace(c, NUMBER, "[REDACTED_NUMBER]")


def exception_text(c: Column) -> Column:
    return without_numbers(without_emails(c))


def cut(c: Column, most: int = 500, binary: bool = False) -> Column:
    if binary:
        return F.when(F.octet_length(c) > most, F.concat(F.lit("<bytes len="), F.octet_length(c).cast("string"), F.lit(" truncated>"))).otherwise(F.decode(c, "UTF-8"))
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(CUT))).otherwise(c)


def scrubbed(c: Column, kind: T.DataType, keys: tuple[str, ...] = KEYS, most: int = 500) -> Column:
    """``c`` without the keys named in ``keys``, in any case and at any depth, and with long strings cut."""
    hidden = [k.casefold() for k in keys]
    if isinstance(kind, T.MapType):
        kept = F.map_filter(c, lambda k, _: ~F.lower(k).isin(hidden))
        return F.transform_values(kept, lambda _, v: scrubbed(v, kind.valueType, keys, most))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: scrubbed(v, kind.elementType, keys, most))
    if isinstance(kind, T.StructType):
        fields = [f for f in kind.fields if f.name.casefold() not in hidden]
        return F.when(c.isNotNull(), F.struct(*(scrubbed(c[f.name], f.dataType, keys, most).alias(f.name) for f in fields)))
    if isinstance(kind, T.StringType):
        return cut(c, most)
    return cut(c, most, True) if isinstance(kind, T.BinaryType) else c


def scrubbed_table(events: DataFrame, exempt: str = "event", keys: tuple[str, ...] = KEYS, most: int = 500, exception: str = "exception") -> DataFrame:
    """All columns scrubbed but the top-level ``exempt``; columns named in ``keys`` are dropped, and a text in the top-level column
    ``exception`` loses e-mails and long numbers before it is cut."""
    hidden = [k.casefold() for k in keys]

    def kept(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if f.name == exempt:
            return c
        if f.name == exception and isinstance(f.dataType, T.StringType):
            c = exception_text(c)
        return scrubbed(c, f.dataType, keys, most).alias(f.name)

    return events.select(*(kept(f) for f in events.schema.fields if f.name == exempt or f.name.casefold() not in hidden))


def request_id(given: Column, *keys: Column) -> Column:
    """``given`` if it is 32 lower-case hex digits, else an id made of ``keys``, the same at each run."""
    return F.when(F.coalesce(given.rlike("^[a-f0-9]{32}$"), F.lit(False)), given).otherwise(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys))))


def access_log(events: DataFrame) -> DataFrame:
    """``event_id, status, duration_ms`` (two places, half to even), ``level``."""
    status = F.coalesce("response_status", "error_status", F.lit(500))
    return events.select("event_id", status.alias("status"), F.bround("duration_ms", 2).alias("duration_ms"), F.when(status >= 500, "warning").otherwise("info").alias("level"))
