"""Streams with timers against one pass over their events, with a restart from the checkpoint in between."""

import datetime
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from heddle.streaming import timers

DAY = 86_400_000


@pytest.fixture(scope="module")
def store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def at(ms):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=ms)


ZERO = int(at(0).timestamp() * 1000)


def run(spark, folder, schema, batches, operator, restart, ends=True):
    """Rows that a stream emits for batches of rows, each a micro-batch; with restart, each batch is read by a stream of its own.

    Streams in processing time have no end of their own (ends is false): state may expire at any later time.
    """
    source, out, check = (f"{folder}/{x}" for x in ("in", "out", "check"))
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if restart or k == len(batches) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            writer = operator(stream).writeStream.format("parquet").option("checkpointLocation", check)
            if ends:
                assert writer.trigger(availableNow=True).start(out).awaitTermination(240)
            else:
                query = writer.trigger(processingTime="1 second").start(out)
                limit = time.monotonic() + 60
                while sum(p["numInputRows"] for p in query.recentProgress) < len(rows) and time.monotonic() < limit and query.isActive:
                    time.sleep(0.5)
                query.stop()
    return spark.read.parquet(out).collect()


def plain_consolidation(events, most, interval, end):
    held, out = {}, []
    for ms, key in sorted(events):
        n, last = held.get(key, (0, ms))
        if n and ms >= last + interval:
            last += interval
            out.append((key, n, last))
            n = 0
        n += 1
        if n >= most or ms - last >= interval:
            out.append((key, n, ms))
            n, last = 0, ms
        held[key] = (n, last)
    return sorted(out + [(k, n, last + interval) for k, (n, last) in held.items() if n and last + interval <= end])


@pytest.mark.parametrize("restart", [False, True])
def test_consolidation_fires_without_a_next_event(store, tmp_path, restart):
    dice = random.Random(5)
    events, now = [], 0
    for _ in range(60):
        now += dice.choice([1_000, 5_000, 30_000, 70_000])
        events.append((now, dice.choice("abc")))
    # One event of another key, long after, moves the watermark.
    events.append((now + 500_000, "z"))
    batches = [[(k, at(ms)) for ms, k in part] for part in (events[:25], events[25:50], events[50:])]
    got = run(store, tmp_path, "key string, ts timestamp", batches, lambda s: timers.consolidated(s, most=4), restart)
    end = events[-1][0]
    assert sorted((r["key"], r["events"], r["at"] - ZERO) for r in got) == plain_consolidation(events, 4, timers.INTERVAL, end)


@pytest.mark.parametrize("restart", [False, True])
def test_pending_decisions_expire_by_timer(store, tmp_path, restart):
    dice = random.Random(3)
    rows = sorted((dice.randrange(0, 12 * DAY, DAY // 4), n, dice.choice("ab"), dice.random() < 0.7) for n in range(60))
    rows.append((20 * DAY, 99, "z", True))
    batches = [[(k, i, at(ms), d) for ms, i, k, d in rows if low <= ms < high] for low, high in itertools.pairwise((0, 4 * DAY, 9 * DAY, 30 * DAY))]
    got = run(store, tmp_path, "key string, id long, ts timestamp, decision boolean", batches, lambda s: timers.outcomes(s, pending=DAY), restart)
    want = []
    for ms, i, key, decision in rows:
        if decision and i != 99:
            after = [x for x, _, k, d in rows if k == key and not d and ms < x <= ms + DAY]
            want.append((i, "resolved", min(after)) if after else (i, "expired", ms + DAY))
    assert sorted((r["id"], r["status"], r["at"] - ZERO) for r in got) == sorted(want)


def test_buffers_flush_over_a_restart(store, tmp_path):
    batches = [[("a", 200), ("a", 200), ("b", 10)], [("a", 200), ("b", 600)], [("a", 512)]]
    got = run(store, tmp_path, "key string, tokens long", batches, lambda s: timers.buffered(s, ttl=3_600_000), True, ends=False)
    assert sorted(map(tuple, got)) == [("a", 1, 512), ("a", 3, 600), ("b", 2, 610)]


def events_of(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


def streamed(spark, folder, rows, operator):
    """Rows of a stream over batch rows; a last event far ahead closes what the watermark holds open."""
    last = rows.agg(F.max("ts")).first()[0] + datetime.timedelta(days=30)
    end = spark.createDataFrame([("end", -1, last, "end")], rows.schema)
    rows.union(end).repartition(3).sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    query = operator(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start(f"{folder}/out")
    assert query.awaitTermination(240)
    return spark.read.parquet(f"{folder}/out")


def test_sessions_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = events_of(spark)
    want = sorted(map(tuple, timers.sessions(rows, "1 day").collect()))
    got = sorted(tuple(r) for r in streamed(spark, tmp_path, rows, lambda s: timers.sessions(s, "1 day")).filter("key <> 'end'").collect())
    assert got == want and len(got) > 10


def test_repeats_are_dropped_in_streams_as_in_batches(spark, tmp_path):
    rows = events_of(spark)
    twice = rows.union(rows)
    got = streamed(spark, tmp_path, twice, lambda s: timers.once(s, ["id"])).filter("key <> 'end'").select("id").collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in rows.select("id").collect())


def test_joined_streams_equal_a_batch(spark, tmp_path):
    rows = events_of(spark)
    parts = lambda s: (s.filter("event_type = 'signup'"), s.filter("event_type = 'purchase'"))
    want = sorted(map(tuple, timers.followed(*parts(rows)).collect()))
    got = sorted(map(tuple, streamed(spark, tmp_path, rows, lambda s: timers.followed(*parts(s))).collect()))
    assert got == want and want
