"""Rounds, scores and budgets: convergence of panels, debate ends, review ratios, rewards, fused contexts, versions, streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Weights of a reward: retrieval, steps that succeeded, completeness, efficiency.
REWARD = (0.3, 0.25, 0.25, 0.2)
#: Weights of a workflow's score: accuracy, efficiency, coherence.
WORKFLOW = (0.5, 0.3, 0.2)
#: What an outcome adds to a confidence, and the bounds of a confidence.
ADJUST = {"success": 0.15, "failure": -0.25, "partial": 0.05}
BOUNDS = (0.1, 1.0)


def entropy(answers: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """key, entropy: of the answers in equal bins of 0 to 1, by the most it can be; 1 without answers. Bins are counted before rows move."""
    bin_ = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    counts = answers.filter(F.col(value).isNotNull()).groupBy(key, bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("all"))
    share = F.col("n") / F.col("all")
    return counts.join(total, F.col(key).eqNullSafe(F.col("_key"))).groupBy(key).agg(F.round(F.sum(-share * F.log2(share)) / F.log2(F.lit(float(bins))), 6).alias("entropy"))


def rounds(answers: DataFrame, key: str, round_: str, value: str) -> DataFrame:
    """key, round_, n, mean, variance, median of each round's answers; a round's answers are one panel's."""
    return answers.groupBy(key, round_).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.var_pop(value), 6).alias("variance"), F.round(F.median(value), 6).alias("median"))


def first_agreement(answers: DataFrame, key: str, round_: str, value: str, least: float) -> DataFrame:
    """key, ended, rounds, confidence: the first round whose mean is `least` or more ends a debate; without one the last round does."""
    means = answers.groupBy(key, round_).agg(F.avg(value).alias("m"))
    met = F.when(F.col("m") >= least, F.col(round_))
    return means.groupBy(key).agg(F.min(met).alias("_ended"), F.max(round_).alias("_last"), F.min_by("m", F.when(F.col("m") >= least, F.col(round_))).alias("_m"), F.max_by("m", round_).alias("_l")).select(
        key, F.col("_ended").isNotNull().alias("agreed"), F.coalesce("_ended", "_last").alias("ended"), F.round(F.coalesce("_m", "_l"), 6).alias("confidence")
    )


def latest_consensus(answers: DataFrame, key: str, round_: str, value: str, least: float) -> DataFrame:
    """key, round_, confidence, action of the latest round: what a judge falls back to."""
    means = answers.groupBy(key, round_).agg(F.avg(value).alias("m"))
    return means.groupBy(key).agg(F.max(round_).alias(round_), F.max_by("m", round_).alias("m")).select(key, round_, F.round("m", 6).alias("confidence"), F.when(F.col("m") >= least, "accept").otherwise("continue").alias("action"))


def accepted_share(reviews: DataFrame, key: str, accepted: Column, least: float) -> DataFrame:
    """key, share, accepted: the share of reviews that accept, and whether it is enough."""
    share = F.avg(accepted.cast("double"))
    return reviews.groupBy(key).agg(F.round(share, 6).alias("share"), (share >= least).alias("accepted"))


def merged_reports(reports: DataFrame, key: str, analyst: str, confidence: str, text: str, advice: str) -> DataFrame:
    """key, reports, confidence, advice (distinct, in order), synthesis: the reports of a key joined in the analysts' order. A key is one task of a few analysts."""
    line = F.struct(F.col(analyst), F.concat(F.lit("["), F.col(analyst).cast("string"), F.lit("]: "), F.col(text)).alias("x"))
    out = reports.groupBy(key).agg(F.count("*").alias("reports"), F.round(F.avg(confidence), 6).alias("confidence"), F.array_sort(F.collect_set(advice)).alias("a"), F.array_sort(F.collect_list(line)).alias("l"))
    return out.select(key, "reports", "confidence", F.array_join("a", ",").alias("advice"), F.array_join(F.transform("l", lambda r: r["x"]), "\n\n").alias("synthesis"))


def reward(retrieval, steps, failed, answer_chars, all_chars) -> Column:
    """A trajectory's reward: retrieval 0.3 if unknown, share of steps that did not fail, a 500-character answer is complete, 1000 tokens are efficient."""
    done = F.when(steps > 0, (steps - failed) / steps).otherwise(0.0)
    parts = (F.coalesce(retrieval, F.lit(0.3)), done, F.least(F.lit(1.0), answer_chars / 500), 1 / F.greatest(F.lit(1.0), F.ceil(all_chars / 4) / 1000))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((p * w for p, w in zip(parts[1:], REWARD[1:], strict=True)), parts[0] * REWARD[0])))


def workflow_score(accuracy, efficiency, coherence) -> Column:
    return accuracy * WORKFLOW[0] + efficiency * WORKFLOW[1] + coherence * WORKFLOW[2]


def adjusted(confidence, outcome) -> Column:
    """A confidence after an outcome, inside its bounds."""
    by = F.coalesce(*[F.when(outcome == k, F.lit(v)) for k, v in ADJUST.items()], F.lit(0.0))
    return F.greatest(F.lit(BOUNDS[0]), F.least(F.lit(BOUNDS[1]), confidence + by))


def newest(rows: DataFrame, key: str, version: str, keep: int = 1) -> DataFrame:
    """The newest `keep` versions of each key, with next_version for the one that follows."""
    line = W.Window.partitionBy(key).orderBy(F.desc(version))
    return rows.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= keep).withColumn("next_version", F.when(F.col("rank") == 1, F.col(version) + 1))


def streaks(rows: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """key, longest, current: runs of failures in order, the longest one and the one at the end (0 if the last row did not fail)."""
    line = W.Window.partitionBy(key).orderBy(order)
    marked = rows.select(key, order, failed.alias("_f")).withColumn("_run", F.sum((~F.col("_f")).cast("int")).over(line))
    runs = marked.groupBy(key, "_run").agg(F.sum(F.col("_f").cast("int")).alias("n"), F.max(order).alias("_at"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "_at").alias("current"))


def fused(segments: DataFrame, budget: int, prefix: Column, text_col: str = "text", id_col: str = "id", score_col: str = "score", top: int = 100) -> DataFrame:
    """id, rank, chars, whole: segments by score until one overflows the budget of characters; that one is cut if over 100 characters are left for it.

    A segment counts with its prefix and a line end. Only the best `top` segments are looked at.
    """
    order = W.Window.orderBy(F.desc(score_col), id_col)
    head = segments.orderBy(F.desc(score_col), id_col).limit(top).withColumn("_p", F.length(prefix)).withColumn("_n", F.col("_p") + 1 + F.length(text_col))
    run = head.withColumn("rank", F.row_number().over(order)).withColumn("_upto", F.sum("_n").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    over = F.col("_upto") > budget
    run = run.withColumn("_over", F.sum(over.cast("int")).over(order)).withColumn("_left", budget - (F.col("_upto") - F.col("_n")) - F.col("_p") - 10)
    kept = run.filter((F.col("_over") == 0) | ((F.col("_over") == 1) & over & (F.col("_left") > 100)))
    return kept.select(id_col, "rank", F.when(over, F.col("_left") + F.col("_p") + 4).otherwise(F.col("_n")).alias("chars"), (~over).alias("whole"))
