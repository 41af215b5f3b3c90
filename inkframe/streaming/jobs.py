"""The states of jobs, from a stream or a table of requests: which were granted, and which jobs went stale.

A job asks for a next state. ``ALLOWED`` says which states may follow which; a
request for another is rejected and changes nothing. A job that has been in a
running state for longer than ``stale`` without a granted request has failed
from then on. In the stream each job is keyed state with an event-time timer
for the moment at which it goes stale; requests of a job are taken in their
order of time, and those of one batch are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State before -> states that may follow; None is a job that nobody knows yet. Fixed values.
ALLOWED = {
    None: ("queued",),
    "queued": ("running", "failed"),
    "running": ("review", "completed", "failed"),
    "review": ("queued", "failed"),
    "completed": (),
    "failed": ("queued",),
}
#: States that go stale.
WATCHED = ("running",)
SCHEMA = "job long, request long, at timestamp, before string, wanted string, granted boolean, stale boolean"


class Transitions(StatefulProcessor):
    """State and time of the last change of each job; its timer is when it goes stale."""

    def __init__(self, stale: timedelta):
        self.stale = stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "state string, since timestamp")

    def _watch(self, state: str | None, since) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state in WATCHED:
            self.handle.registerTimer(int((pd.Timestamp(since) + self.stale).timestamp() * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["at", "request"])
        held = self.last.get() if self.last.exists() else (None, None)
        state, since = held[0], held[1]
        out = []
        for request, at, wanted in zip(asked["request"], asked["at"], asked["wanted"], strict=True):
            if state in WATCHED and at - pd.Timestamp(since) > self.stale:
                gone = pd.Timestamp(since) + self.stale
                out.append((key[0], None, gone, state, "failed", True, True))
                state, since = "failed", gone
            granted = wanted in ALLOWED.get(state, ())
            out.append((key[0], request, at, state, wanted, granted, False))
            if granted:
                state, since = wanted, at
        if state is not None:
            self.last.update((state, pd.Timestamp(since).to_pydatetime()))
            self._watch(state, since)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since = self.last.get()
        if state in WATCHED:
            gone = pd.Timestamp(since) + self.stale
            self.last.update(("failed", gone.to_pydatetime()))
            yield _frame([(key[0], None, gone, state, "failed", True, True)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["job", "request", "at", "before", "wanted", "granted", "stale"])
    return made.astype({"request": "Int64", "granted": bool, "stale": bool, "before": object, "wanted": object})


def stream_transitions(requests: DataFrame, stale: timedelta, delay: str = "0 seconds") -> DataFrame:
    """A stream of transitions from a stream of (job, request, at, wanted). A session must use the RocksDB state store."""
    dealt = requests.select("job", "request", "at", "wanted").withWatermark("at", delay).groupBy("job")
    return dealt.transformWithStateInPandas(Transitions(stale), SCHEMA, "Append", "EventTime")


def transitions(requests: DataFrame, stale: timedelta) -> DataFrame:
    """The same rows for a table of requests, as the stream has them when it has seen the last request of all.

    A job's requests are folded in order; they are as many as one job makes.
    """
    seconds = stale.total_seconds()
    asked = F.array_sort(F.collect_list(F.struct("at", "request", "wanted")))
    rows = requests.groupBy("job").agg(asked.alias("asked"))
    text = F.lit(None).cast("string")
    entry = "array<struct<request:bigint,at:timestamp,before:string,wanted:string,granted:boolean,stale:boolean>>"
    start = F.struct(text.alias("state"), F.lit(None).cast("timestamp").alias("since"), F.array().cast(entry).alias("out"))

    def may_follow(state: Column, wanted: Column) -> Column:
        found = F.lit(False)
        for before, after in ALLOWED.items():
            if after:
                found = found | ((state.isNull() if before is None else state.eqNullSafe(F.lit(before))) & wanted.isin(*after))
        return found

    def row(request: Column, at: Column, before: Column, wanted: Column, granted: Column, stale_: bool) -> Column:
        fields = (("request", request), ("at", at), ("before", before), ("wanted", wanted), ("granted", granted), ("stale", F.lit(stale_)))
        return F.struct(*(v.alias(k) for k, v in fields))

    def step(held: Column, r: Column) -> Column:
        ends = F.timestamp_micros(F.unix_micros(held["since"]) + int(seconds * 1e6))
        gone = F.coalesce(held["state"].isin(*WATCHED) & (r["at"] > ends), F.lit(False))
        now = F.struct(F.when(gone, F.lit("failed")).otherwise(held["state"]).alias("state"), F.when(gone, ends).otherwise(held["since"]).alias("since"), held["out"].alias("out"), gone.alias("gone"), held["state"].alias("was"), ends.alias("ends"))
        return F.aggregate(F.array(now), held, lambda _, n: request(n, r))

    def request(n: Column, r: Column) -> Column:
        granted = F.coalesce(may_follow(n["state"], r["wanted"]), F.lit(False))
        added = F.concat(
            n["out"],
            F.when(n["gone"], F.array(row(F.lit(None).cast("long"), n["ends"], n["was"], F.lit("failed"), F.lit(True), True))).otherwise(F.array().cast(entry)),
            F.array(row(r["request"], r["at"], n["state"], r["wanted"], granted, False)),
        )
        return F.struct(F.when(granted, r["wanted"]).otherwise(n["state"]).alias("state"), F.when(granted, r["at"]).otherwise(n["since"]).alias("since"), added.alias("out"))

    folded = rows.select("job", F.aggregate("asked", start, step).alias("f"))
    known = folded.select("job", F.explode("f.out").alias("o")).select("job", "o.*")
    now = requests.agg(F.max("at").alias("now"))  # one row
    ends = F.timestamp_micros(F.unix_micros("f.since") + int(seconds * 1e6))
    last = folded.filter(F.col("f.state").isin(*WATCHED)).crossJoin(F.broadcast(now)).filter(ends < F.col("now"))
    gone = last.select("job", row(F.lit(None).cast("long"), ends, F.col("f.state"), F.lit("failed"), F.lit(True), True).alias("o")).select("job", "o.*")
    return known.unionAll(gone)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that has landed, and read what it wrote; a run that was stopped goes on at its checkpoint."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(path)
