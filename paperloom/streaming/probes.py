"""Health state with a time to live: a check counts only if the last one that counted is at least ``ttl`` old.

Defined results: checks come by time, then by number; one without a time does not count; of checks of one key, time and number one
counts, a failed one if there is any; a null outcome is a failure; a null key is a key; no checks give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def events_schema(checks: DataFrame) -> str:
    """Of what the stream returns: times are of the kind that they have in ``checks``."""
    return f"key long, ts {dict(checks.dtypes)['ts']}, seq long, event string"


def _micros(checks: DataFrame) -> Column:
    """``ts`` in microseconds. Times without a zone are taken as UTC, whatever the session's zone is, so that a ttl is as long at any time."""
    ts = F.col("ts")
    if dict(checks.dtypes)["ts"] == "timestamp_ntz":
        ts = F.make_timestamp_ltz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts), F.lit("UTC"))
    return F.unix_micros(ts)


def transitions(checks: DataFrame) -> DataFrame:
    """With a ttl of 0 every check counts: ``key, ts, seq, event`` where the state changes."""
    rows = _checks(checks)
    before = F.lag("ok").over(Window.partitionBy("key").orderBy("ts", "seq"))
    return rows.select("key", "ts", "seq", _event(before, F.col("ok")).alias("event")).where("event is not null")


def _checks(checks: DataFrame) -> DataFrame:
    rows = checks.where("ts is not null").select("key", "ts", "seq", F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.groupBy("key", "ts", "seq").agg(F.min("ok").alias("ok"))


def _event(before: Column, now: Column) -> Column:
    return F.when(now & ~before, "recovered").when(~now & before, "became_unreachable")


def _successors(rows: DataFrame) -> DataFrame:
    """``id, to``: the first check of its key that is at least a ttl later, of those that have one. ``rows``: id, key, at (in microseconds), seq,
    stretch (of time, a ttl long), ask (when the ttl is over).

    A check and the end of its ttl lie in successive stretches, so each meets the checks of one stretch, in order of time; where
    there is none the successor is the first check of the next stretch that has any."""
    points = rows.select("key", "stretch", "at", F.lit(1).alias("check"), "seq", "id").unionByName(rows.select("key", (F.col("stretch") + 1).alias("stretch"), F.col("ask").alias("at"), F.lit(0).alias("check"), F.lit(None).cast("long").alias("seq"), "id"))
    later = Window.partitionBy("key", "stretch").orderBy(F.desc("at"), F.desc("check"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = points.withColumn("to", F.last(F.when(F.col("check") == 1, F.col("id")), ignorenulls=True).over(later)).where("check = 0").select("id", "to")
    firsts = rows.groupBy("key", "stretch").agg(F.min_by("id", F.struct("at", "seq")).alias("first"))
    by_time = Window.partitionBy("key").orderBy("stretch")  # a row for each stretch
    one, two = (F.lead(F.struct("stretch", "first"), k).over(by_time) for k in (1, 2))
    firsts = firsts.withColumns({"one": one, "two": two}).select("key", "stretch", F.when(F.col("one.stretch") > F.col("stretch") + 1, F.col("one.first")).otherwise(F.col("two.first")).alias("far"))
    own = rows.select("id", F.col("key").alias("k"), F.col("stretch").alias("s"))
    found = own.join(firsts, F.col("k").eqNullSafe(F.col("key")) & (F.col("s") == F.col("stretch"))).join(near, "id")
    return found.select("id", F.coalesce("to", "far").alias("to")).where("to is not null")


def transitions_with_ttl(checks: DataFrame, ttl: float, write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The same for any ttl in seconds. The checks that count are a chain: the first one, its successor, and so on. Successors are found
    within stretches of time, and the chain by pointer doubling: each round adds what is twice as far down. So a key with most checks
    is dealt out like others. ``write(df, name)`` writes a table and reads it back."""
    micros = round(ttl * 1_000_000)
    if micros <= 0:
        return transitions(checks)
    at = _micros(checks)
    rows = _checks(checks).withColumns({"id": F.monotonically_increasing_id(), "at": at, "ask": at + micros, "stretch": F.floor(at / F.lit(micros))})
    rows = write(rows, "checks")
    chain = write(_successors(rows), "successors")
    jumps, reached = chain, write(rows.groupBy("key").agg(F.min_by("id", F.struct("at", "seq")).alias("id")).select("id"), "reached0")
    for k in range(1, 64):
        more = reached.join(jumps, "id").select(F.col("to").alias("id"))
        before, reached = reached, write(reached.unionByName(more), f"reached{k}")
        if reached.count() == before.count():
            break
        jumps = write(jumps.join(jumps.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), f"jumps{k}")
    state = rows.select("id", "ok")
    now = rows.select(F.col("id").alias("to"), "key", "ts", "seq", F.col("ok").alias("now"))
    changed = reached.join(chain, "id").join(state, "id").join(now, "to")
    return changed.select("key", "ts", "seq", _event(F.col("ok"), F.col("now")).alias("event")).where("event is not null")


class Health(StatefulProcessor):
    """Holds of each key when the last check that counted was, and whether it succeeded."""

    def __init__(self, ttl: float):
        self.micros = round(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at long, up boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, up = self.state.get() or (None, False)  # each call goes to the JVM and back
        for at, _, ok, ts, seq in sorted(((r["at"], -(1 << 63) if r["seq"] is None else r["seq"], bool(r["ok"]), r["ts"], r["seq"]) for r in rows), key=lambda r: r[:3]):
            if last is not None and at - last < self.micros:
                continue
            if last is not None and ok != up:
                yield Row(key=key[0], ts=ts, seq=seq, event="recovered" if ok else "became_unreachable")
            last, up = at, ok
        if last is not None:
            self.state.update((last, up))

    def close(self) -> None:
        pass


def stream_transitions(checks: DataFrame, ttl: float) -> DataFrame:
    """The same for a stream whose micro-batches have each key's checks in order of time; a micro-batch's checks of one key, which
    the source's limits bound, are sorted. Needs the RocksDB state store."""
    rows = checks.where("ts is not null").withColumn("at", _micros(checks))
    return rows.groupBy("key").transformWithState(Health(ttl), events_schema(checks), "Append", "None")
