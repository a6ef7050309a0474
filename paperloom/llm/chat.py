"""Preference formatting of chat turns.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal role and text) is rendered once as the
prompt; the turns after it are rendered as two completions, each with the spans a loss may count: what assistants say there,
end marks included, never role marks or other roles' turns. Spans are code points of their completion, end exclusive.

Turns come as rows; one conversation is one row of the result, so its turns are gathered by an aggregation on its id, in order of
turn, then role and text. Defined results: a null role or text is an empty one; rows with an equal turn are all kept; rows without
a pair id are left out; a pair with one side missing gets an empty prompt and an empty completion for that side; equal
conversations give empty completions; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let, running_sums

END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def spans(turns: Column, trained: str = "assistant") -> Column:
    """start:end of each trained stretch of ``render(turns)``, comma-joined."""
    size = lambda t: F.length(_head(t)) + F.length(t["text"]) + len(END)
    at = lambda starts: F.transform(turns, lambda t, i: F.when(t["role"] == trained, F.concat_ws(":", (starts[i] + F.length(_head(t))).cast("string"), (starts[i] + size(t)).cast("string"))))
    return F.array_join(let(running_sums(F.transform(turns, size)), at), ",")


def gathered(turns: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row for each key: its turns in order."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.where(F.col(key).isNotNull()).groupBy(key).agg(whole.alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """From ``pair_id, chosen, rejected`` (arrays of role, text): the prompt, the completions and their spans."""
    none = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select("pair_id", F.coalesce("chosen", none).alias("chosen"), F.coalesce("rejected", none).alias("rejected"))
    least = F.least(F.size("chosen"), F.size("rejected"))
    head = lambda side: F.slice(side, F.lit(1), least)
    differs = F.array_position(F.zip_with(head("chosen"), head("rejected"), lambda a, b: a == b), False)
    rows = rows.withColumn("shared", F.when(differs > 0, differs - 1).otherwise(least).cast("int"))
    rest = lambda side: F.slice(side, F.col("shared") + 1, F.size(side))
    rows = rows.select("pair_id", "shared", F.slice("chosen", F.lit(1), F.col("shared")).alias("both"), rest("chosen").alias("won"), rest("rejected").alias("lost"))
    return rows.select(
        "pair_id",
        F.col("shared").cast("long").alias("prompt_turns"),
        render(F.col("both")).alias("prompt"),
        render(F.col("won")).alias("chosen"),
        spans(F.col("won")).alias("chosen_spans"),
        render(F.col("lost")).alias("rejected"),
        spans(F.col("lost")).alias("rejected_spans"),
    )


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """From two tables of ``pair_id, turn, role, text``."""
    return format_pairs(gathered(chosen).withColumnRenamed("turns", "chosen").join(gathered(rejected).withColumnRenamed("turns", "rejected"), "pair_id", "full"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of conversations: each is chosen over itself with its last assistant's turn taken from the
    conversation whose id differs in the lowest bit (an empty turn if there is none)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text")
    whole = gathered(rows)
    answers = rows.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("answer"))
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("answer.text").alias("other"))  # one text of each conversation
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"] == "assistant"), True).cast("int")
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.coalesce("other", F.lit("")).alias("text"))).otherwise(t))
    rows = whole.join(other, "pair_id", "left").withColumn("last", last)
    return rows.select("pair_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))
