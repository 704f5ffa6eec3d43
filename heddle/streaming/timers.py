"""Keyed streams with timers and state that expires: consolidation by number or time, decisions and their outcomes, idle buffers.

State is kept per key in value and list states, each bounded by what is pending; timers fire when the watermark passes them, so
nothing waits for a next event of its key. Rows of one key are taken in order of time within a micro-batch. A row that is later
than its key's state is taken as it comes; rows later than the watermark are dropped by Spark.

These operators need the RocksDB state store (`use_rocksdb`), and a stream with a watermark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Events, or milliseconds since the last time, at which a key's events are consolidated.
EVENTS, INTERVAL = 10, 60_000
#: Milliseconds after which a pending decision expires.
PENDING = 30 * 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and lists of state live in RocksDB; set before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple]:
    """A key's rows of one micro-batch, as tuples in order of `by`."""
    parts = [p for p in rows if len(p)]
    if parts:
        yield from pd.concat(parts).sort_values(by, kind="stable").itertuples(index=False)


class Consolidation(StatefulProcessor):
    """Emits (key, events, at) when `most` events are held, or `interval` after the last time even if no further event comes.

    The first event of a key starts its clock. An event at or after the deadline finds the buffer already consolidated.
    """

    def __init__(self, most: int, interval: int):
        self.most, self.interval = most, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "n long, last long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, last = self.held.get() if self.held.exists() else (0, None)
        made = []
        for row in _in_order(rows, ["ms"]):
            at = int(row.ms)
            last = at if last is None else last
            if n and at >= last + self.interval:
                self.handle.deleteTimer(last + self.interval)
                last += self.interval
                made.append((key[0], n, last))
                n = 0
            n += 1
            if n >= self.most or at - last >= self.interval:
                if n > 1:
                    self.handle.deleteTimer(last + self.interval)
                made.append((key[0], n, at))
                n, last = 0, at
            elif n == 1:
                self.handle.registerTimer(last + self.interval)
        self.held.update((n, last))
        yield pd.DataFrame(made, columns=["key", "events", "at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, last = self.held.get()
        due = expiredTimerInfo.getExpiryTimeInMs()
        if n and due == last + self.interval:
            self.held.update((0, due))
            yield pd.DataFrame([(key[0], n, due)], columns=["key", "events", "at"])

    def close(self) -> None:
        pass


def consolidated(events: DataFrame, most: int = EVENTS, interval: int = INTERVAL, late: str = "0 seconds") -> DataFrame:
    """key, events, at (milliseconds) of each consolidation of events (key, ts)."""
    timed = events.withWatermark("ts", late).select("key", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("key").transformWithStateInPandas(Consolidation(most, interval), "key string, events long, at long", "Append", "EventTime")


class Outcomes(StatefulProcessor):
    """Emits (key, id, status, at): a decision is resolved by the first outcome of its key after it, or expires `pending` after it."""

    def __init__(self, pending: int):
        self.pending = pending

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id long, ms long")

    def _split(self, now: list[tuple], fine) -> tuple[list[tuple], list[tuple]]:
        return [x for x in now if fine(x)], [x for x in now if not fine(x)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = [tuple(x) for x in self.waiting.get()]
        made = []
        # Outcomes of a time come before its decisions: they resolve earlier ones only.
        for row in _in_order(rows, ["ms", "decision"]):
            at = int(row.ms)
            # What was due before this row has expired, though its timer may fire later.
            gone, now = self._split(now, lambda x: x[1] + self.pending < at)  # noqa: B023
            made += [(key[0], i, "expired", t + self.pending) for i, t in gone]
            if row.decision:
                now.append((int(row.id), at))
                self.handle.registerTimer(at + self.pending)
            else:
                done, now = self._split(now, lambda x: x[1] < at)  # noqa: B023
                made += [(key[0], i, "resolved", at) for i, _ in done]
        self._keep(now)
        yield pd.DataFrame(made, columns=["key", "id", "status", "at"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        gone, now = self._split([tuple(x) for x in self.waiting.get()], lambda x: x[1] + self.pending <= due)
        self._keep(now)
        yield pd.DataFrame([(key[0], i, "expired", t + self.pending) for i, t in gone], columns=["key", "id", "status", "at"])

    def _keep(self, now: list[tuple]) -> None:
        if now:
            self.waiting.put(now)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, pending: int = PENDING, late: str = "0 seconds") -> DataFrame:
    """key, id, status, at (milliseconds) of decisions among events (key, id, ts, decision: true for a decision, false for an outcome)."""
    timed = events.withWatermark("ts", late).select("key", "id", "ts", "decision", F.unix_millis("ts").alias("ms"))
    return timed.groupBy("key").transformWithStateInPandas(Outcomes(pending), "key string, id long, status string, at long", "Append", "EventTime")


class Buffer(StatefulProcessor):
    """Emits (key, units, tokens) when a buffer reaches its limit; a buffer that is not written to for `ttl` is forgotten."""

    def __init__(self, limit: int, ttl: int | None):
        self.limit, self.ttl = limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "n long, tokens long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, tokens = self.held.get() if self.held.exists() else (0, 0)
        made = []
        for part in rows:
            for t in part["tokens"]:
                n, tokens = n + 1, tokens + int(t)
                if tokens >= self.limit:
                    made.append((key[0], n, tokens))
                    n = tokens = 0
        self.held.update((n, tokens))
        yield pd.DataFrame(made, columns=["key", "units", "tokens"])

    def close(self) -> None:
        pass


def buffered(units: DataFrame, limit: int = 512, ttl: int | None = None) -> DataFrame:
    """key, units, tokens of each flush of units (key, tokens); ttl in milliseconds of processing time."""
    return units.groupBy("key").transformWithStateInPandas(Buffer(limit, ttl), "key string, units long, tokens long", "Append", "ProcessingTime")


# Event-time operators that need no state of their own


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: runs of a key's events (key, ts) with less than `gap` between them."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("s"), "key").agg(F.count("*").alias("n")).select("key", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of events with the same keys; a stream remembers keys for as long as events may be late."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def followed(first: DataFrame, then: DataFrame, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """key, id, ts, next_id, next_ts: each event of `first` with the events of `then` (key, id, ts) of its key that follow within a time."""
    if first.isStreaming:
        first, then = first.withWatermark("ts", late), then.withWatermark("ts", late)
    then = then.select(F.col("key").alias("_key"), F.col("id").alias("next_id"), F.col("ts").alias("next_ts"))
    met = (F.col("key") == F.col("_key")) & (F.col("next_ts") > F.col("ts")) & (F.col("next_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return first.join(then, met).select("key", "id", "ts", "next_id", "next_ts")
