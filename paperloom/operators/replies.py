"""Model replies: cleaning, parsing, validation, retries, prompts.

JSON is parsed by ``try_parse_json``; unlike Python's decoder it refuses NaN. Of repeated keys the last counts only with
``spark.sql.variant.allowDuplicateKeys``; without it such a reply is a parse error.

Defined results: a null reply has no JSON object; of a document's replies with one attempt number the least valid text is chosen, and each
refused one gives a cause; a document without replies is in no result; repeated rows are judged each; empty tables give no rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from ..functions.values import json_kind
from . import json_schema

MAX_RETRIES = 3
#: The envelope that every reply must be.
ENVELOPE = {"type": "object", "required": ["extractions"], "properties": {"extractions": {"type": "array"}}}
#: The texts between the parts of a correction prompt.
REPLY_IS = "\n\nThe previous response was not valid JSON matching the required schema.\nPrevious output:\n"
FAILED_AS = "\n\nValidation failure:\n"
SCHEMA_IS = "\n\nExpected schema:\n"
ONLY_JSON = "\n\nReturn only a valid JSON object matching the schema. Do not include any commentary, markdown fences, or surrounding prose."

def clean(raw: Column) -> Column:
    """Without surrounding whitespace and without one code fence at either end."""
    opened = F.regexp_replace(strip(raw), f"^(```json|```JSON|```){SPACE}*", "")
    return strip(F.regexp_replace(opened, f"{SPACE}*```{SPACE}*$", ""))


def parse(cleaned: Column) -> Column:
    """The JSON value from the first brace on as a variant; null if there is none or it is broken."""
    at = F.instr(cleaned, "{")
    return F.try_parse_json(F.when(at > 0, F.substring(cleaned, at, F.length(cleaned))))


def with_violations(rows: DataFrame, schema: dict, parsed: str = "parsed") -> DataFrame:
    """``rows`` with ``violations``: where the variant ``parsed`` breaks a schema, and which rule."""
    text = json.dumps(schema)
    return json_schema.with_violations(rows, F.col(parsed), F.parse_json(F.lit(text)), json_schema.levels_of(text))


def failure(cleaned: Column, value: Column, violations: Column) -> Column:
    """Why a reply is refused; null if it is valid. Names places, never values."""
    refused = F.when(F.instr(cleaned, "{") == 0, "no_json_object").when(value.isNull(), "json_parse_error").when(json_kind(value) != "object", "not_object")
    return refused.when(F.size(violations) > 0, F.concat(F.lit("schema_violation:"), F.array_join(json_schema.places(violations), ",")))


def judged(completions: DataFrame, schema: dict = ENVELOPE) -> DataFrame:
    """``completions`` with ``cleaned, parsed, violations, cause``."""
    rows = completions.withColumn("cleaned", clean(F.col("raw_text")))
    rows = with_violations(rows.withColumn("parsed", parse(F.col("cleaned"))), schema)
    return rows.withColumn("cause", failure(F.col("cleaned"), F.col("parsed"), F.col("violations")))


def first_valid(judged_rows: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``doc_id, attempt, cleaned, causes, code``: the first valid attempt of those allowed, or an error; and the causes in order."""
    allowed = judged_rows.where(F.col("attempt") <= max_retries + 1)
    won = F.min(F.when(F.col("cause").isNull(), F.struct("attempt", "cleaned")))
    causes = F.array_sort(F.collect_list(F.when(F.col("cause").isNotNull(), F.struct("attempt", "cause"))))
    rows = allowed.groupBy("doc_id").agg(won.alias("won"), causes.alias("lost"))
    before = F.filter("lost", lambda x: F.col("won").isNull() | (x["attempt"] < F.col("won.attempt")))
    return rows.select("doc_id", "won.attempt", "won.cleaned", F.array_join(F.transform(before, lambda x: x["cause"]), ";").alias("causes"), F.when(F.col("won").isNull(), "STRUCTURED_OUTPUT_FAILED").alias("code"))


def correction_prompt(prompt: Column, output: Column, reason: Column, schema: Column) -> Column:
    """``schema`` is pretty JSON with sorted keys (``pretty``)."""
    return F.concat(prompt, F.lit(REPLY_IS), output, F.lit(FAILED_AS), reason, F.lit(SCHEMA_IS), schema, F.lit(ONLY_JSON))


def pretty(schema: dict) -> str:
    return json.dumps(schema, indent=2, sort_keys=True)


Predict = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def infer(prompts: DataFrame, predict: Predict, callers: int | None = None) -> DataFrame:
    """``doc_id, attempt, raw_text`` of ``prompts`` (doc_id, attempt, prompt, text) by a batch function; ``callers`` bounds how many
    tasks call the model at once."""
    return (prompts.repartition(callers) if callers else prompts).mapInPandas(predict, "doc_id long, attempt int, raw_text string")


def infer_with_retries(prompts: DataFrame, predict: Predict, write: Callable[[DataFrame, str], DataFrame], schema: dict = ENVELOPE, max_retries: int = MAX_RETRIES) -> DataFrame:
    """``judged`` completions of up to ``max_retries`` + 1 rounds. Each round is written by ``write(df, name)``; only what is still
    invalid goes into the next one, with a correction prompt."""
    asked, done = prompts.withColumn("attempt", F.lit(1)), None
    for attempt in range(1, max_retries + 2):
        replies = write(infer(asked, predict), f"round{attempt}")
        done = replies if done is None else done.unionByName(replies)
        refused = judged(replies, schema).where("cause is not null").select("doc_id", "raw_text", "cause")
        if attempt > max_retries or refused.isEmpty():
            break
        fixed = correction_prompt(F.col("prompt"), F.col("raw_text"), F.col("cause"), F.lit(pretty(schema)))
        asked = asked.join(refused, "doc_id").select("doc_id", F.lit(attempt + 1).alias("attempt"), fixed.alias("prompt"), "text")
    return judged(done, schema)


def regex_extractor(patterns: dict[str, str]) -> Predict:
    """A deterministic stand-in for a model: the first match of each field's pattern, as an envelope."""
    import re

    compiled = {name: re.compile(p) for name, p in patterns.items()}

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [[{name: m.group(0), f"{name}_attributes": {}} for name, p in compiled.items() if (m := p.search(text or ""))] for text in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "attempt": frame["attempt"], "raw_text": [json.dumps({"extractions": f}) for f in found]})

    return predict


def flattened(rows: DataFrame, parsed: str = "parsed") -> DataFrame:
    """``doc_id, ord, field_name, value``: a row for each field of each element of the envelope, in order of the array."""
    elements = F.variant_get(F.col(parsed), "$.extractions", "array<variant>")
    entries = F.map_entries(F.map_filter(F.try_variant_get(F.col("element"), "$", "map<string,variant>"), lambda k, _: ~k.endswith("_attributes")))
    flat = rows.select("doc_id", F.posexplode(elements).alias("ord", "element")).select("doc_id", "ord", F.explode(entries).alias("e"))
    return flat.select("doc_id", "ord", F.col("e.key").alias("field_name"), F.when(~F.is_variant_null("e.value"), F.coalesce(F.try_variant_get("e.value", "$", "string"), F.to_json("e.value"))).alias("value"))


def examples(skills: DataFrame, keys: tuple[str, ...] = ("name", "version")) -> DataFrame:
    """Few-shot examples: ``*keys, example_no, input, field_name, value`` with the values as text."""
    rows = skills.select(*keys, F.posexplode("examples").alias("example_no", "example"))
    values = F.from_json(F.col("example.output"), "map<string,string>")
    return rows.select(*keys, "example_no", F.col("example.input").alias("input"), F.explode(values).alias("field_name", "value"))
