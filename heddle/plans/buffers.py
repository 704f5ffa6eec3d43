"""Queries over buffers and lifecycles that a stream would keep as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.functions.text import estimated_tokens
from heddle.operators import folds, memory
from heddle.plans.registry import query
from heddle.sources.scratch import stored
from heddle.sources.tables import table


@query("""
    WITH RECURSIVE m AS (SELECT conv_id, turn, ceil(length(coalesce(text, '')) / 4)::BIGINT AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
    s AS (SELECT conv_id, k, turn, t AS held, 1::BIGINT AS n FROM m WHERE k = 1
          UNION ALL SELECT m.conv_id, m.k, m.turn, CASE WHEN s.held >= 64 THEN m.t ELSE s.held + m.t END, CASE WHEN s.held >= 64 THEN 1 ELSE s.n + 1 END FROM s JOIN m ON m.conv_id = s.conv_id AND m.k = s.k + 1)
    SELECT conv_id, turn, n AS units, held AS tokens FROM s WHERE held >= 64""")
def sensory_flushes(spark: SparkSession, d: str) -> DataFrame:
    """When a conversation's buffer is emptied: at the turn that brings it to 64 tokens."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", estimated_tokens(F.col("text")).alias("t"))
    # A buffer starts at the first turn before which 64 tokens or more have come since the last start.
    upto = stored(memory.running(turns, "conv_id", "turn", "t", "_upto").withColumn("_before", F.col("_upto") - F.col("t")), "buffer-turns")
    found = folds.grouped(upto, "conv_id", "turn", "_before", 64)
    full = found.groupBy("conv_id", "group").agg(F.max("turn").alias("turn"), F.count("*").alias("units"), F.sum("t").alias("tokens"))
    return full.filter("tokens >= 64").drop("group")


@query("""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
    SELECT event_id, min(r.ts) AS resolved_at, CASE WHEN min(r.ts) IS NULL THEN 'expired' ELSE 'resolved' END AS status
    FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.ts > p.ts AND r.ts <= p.ts + INTERVAL 1 DAY GROUP BY event_id""")
def outcome_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Pending decisions (signups) and the first purchase of the same user that resolves them within a day; the others expire."""
    events = table(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase"))
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    # From the latest event on, the least purchase so far is the next one. A purchase at the signup's own time resolves nothing,
    # so times are first made one row each: the purchase before a time in this order is at a later time.
    times = events.groupBy("user_id", "ts").agg(F.min(bought).alias("_bought"))
    line = W.Window.partitionBy("user_id").orderBy(F.desc("ts")).rowsBetween(W.Window.unboundedPreceding, -1)
    later = times.withColumn("_next", F.min("_bought").over(line)).select(F.col("user_id").alias("_user"), F.col("ts").alias("_at"), "_next")
    asked = events.filter("event_type = 'signup'")
    found = asked.join(later, F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("ts") == F.col("_at")), "left")
    at = F.when(F.col("user_id").isNotNull() & (F.col("_next") <= F.col("ts") + F.expr("INTERVAL 1 DAY")), F.col("_next"))
    return found.select("event_id", at.alias("resolved_at"), F.when(at.isNull(), "expired").otherwise("resolved").alias("status"))
