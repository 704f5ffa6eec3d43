"""Aggregates behind the service: timelines, messages, pages, histograms, percentiles, market and panel figures, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def timeline(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def last_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turns, role, text of each conversation's last turn; aggregated before rows move."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by(F.struct("role", "text"), "turn").alias("m")).select("conv_id", "turns", "m.role", "m.text")


def fork(messages: DataFrame, points: DataFrame) -> DataFrame:
    """Messages up to the fork point of their conversation (conv_id, until), as a new conversation of the same number below zero."""
    at = points.select(F.col("conv_id").alias("_conv"), "until")
    return messages.join(at, F.col("conv_id") == F.col("_conv")).filter(F.col("turn") <= F.col("until")).select((-F.col("conv_id") - 1).alias("conv_id"), "turn", "role", "text")


def page(rows: DataFrame, order: list, skip: int, limit: int, most: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(min(limit, most))


def histogram(events: DataFrame, edges: list[float]) -> DataFrame:
    """event_type, le, n: cumulative counts up to each bucket's edge, and in all."""
    counts = events.groupBy("event_type").agg(*[F.sum((F.col("value") <= e).cast("long")).alias(str(i)) for i, e in enumerate(edges)], F.count("value").alias("all"))
    rows = [F.struct(F.lit(str(e)).alias("le"), F.col(str(i)).alias("n")) for i, e in enumerate(edges)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return counts.select("event_type", F.explode(F.array(*rows)).alias("b")).select("event_type", "b.le", "b.n")


def at_ranks(rows: DataFrame, key: str, value: str, ranks: dict) -> DataFrame:
    """key, n and, by name, the values at ranks (functions of n, from 1) of a key's values in order.

    Values are dealt to a hundred ranges between approximate quantiles and counted there; only the range that holds a rank is
    sorted, by its different values. So a key's rows are never in one task.
    """
    rows = rows.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    edges = rows.groupBy(F.col("_k").alias("_key")).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(*[F.lit(i / 100) for i in range(1, 100)]), 1000).alias("edges"))
    counted = rows.groupBy("_k", "_v").agg(F.count("*").alias("c"))
    placed = counted.join(edges, F.col("_k").eqNullSafe(F.col("_key"))).withColumn("range", F.size(F.filter("edges", lambda e: e < F.col("_v")))).select("_k", "_v", "c", "n", "range")
    line = W.Window.partitionBy("_k").orderBy("range")
    sums = placed.groupBy("_k", "n", "range").agg(F.sum("c").alias("s")).withColumn("upto", F.sum("s").over(line))  # at most a hundred rows a key
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("rank")) for name, at in ranks.items()])).alias("w")
    hit = sums.select(F.col("_k").alias("_hk"), F.col("range").alias("_hr"), (F.col("upto") - F.col("s")).alias("before"), "upto", wanted).filter((F.col("w.rank") > F.col("before")) & (F.col("w.rank") <= F.col("upto")))
    inner = W.Window.partitionBy("_k", "range", "w.name").orderBy("_v")
    near = placed.join(hit, F.col("_k").eqNullSafe(F.col("_hk")) & (F.col("range") == F.col("_hr"))).withColumn("at", F.col("before") + F.sum("c").over(inner)).filter(F.col("at") >= F.col("w.rank"))
    return near.groupBy(F.col("_k").alias(key)).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("w.name") == name, F.col("_v"))).alias(name) for name in ranks])


def percentiles(events: DataFrame, shares: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """event_type and p<share>: nearest-rank percentiles."""
    return at_ranks(events, "event_type", "value", {f"p{p}": lambda n, p=p: F.ceil(n * p / 100) for p in shares}).drop("n")


def returns(orders: DataFrame) -> DataFrame:
    """day, r: relative change of each day's mean price to the day before. A row per day."""
    daily = orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    before = F.lag("price").over(W.Window.orderBy("day"))
    return daily.select("day", ((F.col("price") - before) / before).alias("r")).filter("r is not null")


def market_metrics(series: DataFrame) -> DataFrame:
    """n, mean, deviation, sharpe, win_rate and drawdown of the additive curve, whose peak starts at 0."""
    line = W.Window.orderBy("day").rowsBetween(W.Window.unboundedPreceding, 0)
    curve = series.withColumn("c", F.sum("r").over(line)).withColumn("peak", F.greatest(F.lit(0.0), F.max("c").over(line)))
    sd, mean = F.stddev_pop("r"), F.avg("r")
    return curve.agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean"), F.round(sd, 4).alias("deviation"), F.round(F.when(sd > 0, mean / sd).otherwise(0.0), 4).alias("sharpe"), F.round(F.avg((F.col("r") > 0).cast("double")), 4).alias("win_rate"), F.round(F.max(F.col("peak") - F.col("c")), 4).alias("drawdown"))


def convergence(answers: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean, deviation, iqr of a panel's answers; quartiles are the values at a quarter and three quarters of the order, and under four answers the deviation stands for their distance."""
    facts = answers.groupBy(key).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("deviation"))
    quarters = at_ranks(answers, key, value, {"q1": lambda n: F.floor(n * 0.25) + 1, "q3": lambda n: F.floor(n * 0.75) + 1}).select(F.col(key).alias("_qk"), "q1", "q3")
    both = facts.join(quarters, F.col(key).eqNullSafe(F.col("_qk")), "left")
    return both.select(key, "n", "mean", "deviation", F.when(F.col("n") < 4, F.col("deviation")).otherwise(F.round(F.col("q3") - F.col("q1"), 6)).alias("iqr"))


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, outcome, n: success where quality is good and the text not toxic, partial where only one holds, else failure."""
    both = docs.select("doc_id", "source").join(labels, "doc_id")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    return both.withColumn("outcome", F.when(good & clean, "success").when(good | clean, "partial").otherwise("failure")).groupBy("source", "outcome").agg(F.count("*").alias("n"))


def exchanges(messages: DataFrame) -> DataFrame:
    """conv_id, turn, instruction, output: each user turn with the assistant turn that follows it, for fine-tuning."""
    user = messages.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    reply = messages.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    return user.join(reply, ["conv_id", "turn"])


def preference_pairs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """source, chosen, rejected: each bad document with the first good one of its source; a null source is a source."""
    both = docs.select("doc_id", "source").join(labels, "doc_id")
    first = both.filter("quality = 1").groupBy(F.col("source").alias("_source")).agg(F.min("doc_id").alias("chosen"))
    bad = both.filter("quality = 0").select("source", F.col("doc_id").alias("rejected"))
    return bad.join(first, F.col("source").eqNullSafe(F.col("_source"))).select("source", "chosen", "rejected")


def workspace(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
