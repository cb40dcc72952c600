"""Presence as keyed state: what a source no longer sees is stale, and gone after enough live polls.

State is held per (stream, shard), a shard being a share of the stream's keys by hash, so a stream of any
weight is spread.  The keys of a shard lie in a map of the state store and pass a task one by one; the poll
days of the window are a second map, from which days that left the window are removed.  An event-time timer
closes each day once the watermark has passed it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

DAY = 86_400_000  # milliseconds
ROWS_AT_ONCE = 10_000  # changes handed on together
CHANGE = "stream string, shard int, l2_domain string, mac string, as_of int, day int, missed bigint"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _end(day: int) -> int:
    return (day + 1) * DAY


def changes(
    last: int | None, missed: int | None, waiting: list[int], live: list[int], days: range, window: int
) -> tuple[int | None, int | None, list[int], list[tuple[int, int, int]]]:
    """One key over the days that close: its state after them and a (as_of, day, missed) per change.

    ``waiting`` are days the key was seen on that had not closed, ``live`` the days of live polls, ascending.
    """
    told = []
    waiting = sorted(waiting)
    # Beyond the window after the last poll and sighting, nothing can change.
    newest = max([*live[-1:], *waiting[-1:], days.start])
    for today in range(days.start, min(days.stop, newest + window + 1)):
        before = (last, missed)
        while waiting and waiting[0] <= today:
            last = waiting.pop(0)
        if last is not None:
            start = max(last, today - window)
            missed = max(0, bisect_right(live, today) - bisect_right(live, start))
            if (last, missed) != before:
                told.append((today, last, missed))
    return last, missed, waiting, told


class _Presence(StatefulProcessor):
    """Keys and polls of one (stream, shard)."""

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "day int")
        self.keys = handle.getMapState(
            "keys", "l2_domain string, mac string", "last int, missed bigint, waiting array<int>"
        )
        self.polls = handle.getMapState("polls", "day int", "live boolean")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            low = int(part["day"].min())
            earliest = low if earliest is None else min(earliest, low)
            ran = part["mac"].isna()
            for day, live in part[ran].groupby("day")["live"].all().items():
                held = self.polls.getValue((int(day),))
                self.polls.updateValue((int(day),), (bool(live) and (held is None or held[0]),))
            for name, days in part[~ran].groupby(["l2_domain", "mac"])["day"].unique().items():
                last, missed, waiting = self.keys.getValue(name) or (None, None, [])
                self.keys.updateValue(name, (last, missed, sorted({*waiting, *map(int, days)})))
        held = self.next.get()
        if held is None or earliest < held[0]:
            if held is not None:
                self.handle.deleteTimer(_end(held[0]))
            self.next.update((earliest,))
            self.handle.registerTimer(_end(earliest))
        return iter(())

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        days = range(self.next.get()[0], timerValues.getCurrentWatermarkInMs() // DAY)
        polls = {day[0]: live[0] for day, live in self.polls.iterator()}
        live = sorted(day for day, ok in polls.items() if ok)
        out = []
        for name, (last, missed, waiting) in self.keys.iterator():
            after = changes(last, missed, list(waiting), live, days, self.window)
            if after[:3] != (last, missed, list(waiting)):
                self.keys.updateValue(tuple(name), after[:3])
            out += [(*key, *name, *told) for told in after[3]]
            if len(out) >= ROWS_AT_ONCE:
                yield self._frame(out)
                out = []
        for day in polls:
            if day <= days.stop - self.window:
                self.polls.removeKey((day,))
        self.next.update((days.stop,))
        self.handle.registerTimer(_end(days.stop))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGE.split(", ")])

    def close(self) -> None:
        pass


def stream_presence(
    seen: DataFrame, root: str, window: int, lateness: str, shards: int = 32
) -> StreamingQuery:
    """Logs each change of a key's presence, as of the day it changed, when that day closes.

    ``seen`` is (stream, at, live, l2_domain, mac): a row per sighting, and one without a mac for the poll
    itself, live or blind; a day of several polls is live if all were.  A day closes ``lateness`` after its
    end in event time, and what comes later than that is left to the batch operator (the engine counts it).
    ``shards`` spreads the keys of one stream, and repeats its polls that often.
    """
    spark = seen.sparkSession
    own = F.array(F.pmod(F.xxhash64("l2_domain", "mac"), F.lit(shards)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    rows = seen.select(
        "stream", F.col("at").cast("timestamp").alias("at"), "live",
        F.coalesce(F.col("l2_domain").cast("string"), F.lit("")).alias("l2_domain"), "mac",
        F.unix_date(F.col("at").cast("date")).alias("day"),
        F.explode(F.when(F.col("mac").isNull(), every).otherwise(own)).alias("shard"),
    )
    told = (
        rows.withWatermark("at", lateness)
        .groupBy("stream", "shard")
        .transformWithStateInPandas(_Presence(window), CHANGE, "Update", "EventTime")
    )

    def log(batch: DataFrame, n: int) -> None:
        batch.drop("shard").write.mode("overwrite").parquet(f"{root}/presence/batch={n}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)  # maps and timers need it; a query keeps what it started with
    try:
        return (
            told.writeStream.outputMode("update")
            .foreachBatch(log)
            .option("checkpointLocation", f"{root}/_presence")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STORE, before)


def presence_as_of(spark: SparkSession, root: str, day: str, misses: int) -> DataFrame:
    """(stream, l2_domain, mac, day, missed, state) on a closed day: the last change up to it, of each key."""
    now = F.unix_date(F.lit(day).cast("date"))
    log = spark.read.parquet(f"{root}/presence").where(F.col("as_of") <= now)
    newest = F.max_by(F.struct("day", "missed"), "as_of").alias("r")
    state = F.when(F.col("missed") >= misses, "gone").when(F.col("missed") > 0, "stale")
    return log.groupBy("stream", "l2_domain", "mac").agg(newest).select(
        "stream", "l2_domain", "mac", F.date_from_unix_date("r.day").alias("day"), "r.missed"
    ).withColumn("state", state.otherwise("present"))
