"""Queries over training samples, measures by name, and similarity by choice."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import vectors
from heddle.functions.measures import Measures, Summed
from heddle.operators import datasets
from heddle.plans.registry import query
from heddle.sources.tables import table

_OUTCOME = "CASE WHEN quality = 1 AND toxic = 0 THEN 'success' WHEN quality = 1 OR toxic = 0 THEN 'partial' ELSE 'failure' END"
_I = datasets.INSTRUCTIONS
_SAMPLES = f"""
    raw AS (
        SELECT doc_id AS id, CASE WHEN outcome = 'failure' THEN 'negative' ELSE 'positive' END AS kind, '{_I["decision_reflection"]}' AS instruction, substr(text, 1, 120) AS input, 'The outcome was a ' || outcome AS output,
               'decision_reflection' AS source, CASE outcome WHEN 'success' THEN 0.9 WHEN 'partial' THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence
        FROM (SELECT doc_id, text, {_OUTCOME} AS outcome FROM documents JOIN labels USING (doc_id))
        UNION ALL
        SELECT (1::BIGINT << {datasets.KEY_BITS}) + conv_id, 'positive', '{_I["debate_synthesis"]}', arg_min(text, turn) FILTER (role = 'user'), arg_max(text, turn) FILTER (role = 'assistant'), 'debate_synthesis', any_value(conv_id * 37 % 100) / 100
        FROM conversations GROUP BY conv_id HAVING any_value(conv_id * 37 % 100) / 100 >= 0.6
        UNION ALL
        SELECT (2::BIGINT << {datasets.KEY_BITS}) + doc_id, 'positive', '{_I["peer_review"]}', substr(text, 1, 120), 'Accepted in ' || coalesce(lang, '-'), 'peer_review', 0.8 FROM documents JOIN labels USING (doc_id) WHERE quality = 1
        UNION ALL
        SELECT (3::BIGINT << {datasets.KEY_BITS}) + 2 * page_id + k, CASE k WHEN 0 THEN 'positive' ELSE 'negative' END, '{_I["red_team"]}', url, CASE k WHEN 0 THEN substr(html, 1, 80) ELSE url END, 'red_team', CASE k WHEN 0 THEN page_id * 37 % 100 / 100 ELSE 1 - page_id * 37 % 100 / 100 END
        FROM pages, (SELECT unnest([0, 1]) AS k) WHERE page_id * 37 % 100 / 100 > 0.7
        UNION ALL
        SELECT (4::BIGINT << {datasets.KEY_BITS}) + event_id, 'positive', '{_I["experience_reflection"]}', event_type || ' of ' || user_id, 'worth ' || event_id % 9, 'experience_reflection', CASE WHEN event_id % 3 = 0 THEN 0.7 ELSE event_id % 10 / 10 END
        FROM events WHERE event_id % 4 > 0),
    samples AS (SELECT * FROM raw WHERE confidence >= 0.6)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of the given tables: labelled documents as decisions and reviews, conversations as debates, pages as challenges, events as stored states."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    known = docs.join(labels, "doc_id")
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "success").when((F.col("quality") == 1) | (F.col("toxic") == 0), "partial").otherwise("failure")
    head = F.substring("text", 1, 120)
    made = known.select(F.col("doc_id").alias("key"), head.alias("content"), outcome.alias("outcome"), F.concat(F.lit("The outcome was a "), outcome).alias("reflection"))
    share = lambda c: F.pmod(F.col(c) * 37, F.lit(100)) / 100
    said = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("query"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("verdict"))
    judged = known.select(F.col("doc_id").alias("key"), head.alias("content"), F.concat(F.lit("Accepted in "), F.coalesce("lang", F.lit("-"))).alias("feedback"), (F.col("quality") == 1).alias("accepted"))
    attacks = table(spark, d, "pages").select(F.col("page_id").alias("key"), F.col("url").alias("attack"), F.substring("html", 1, 80).alias("defense"), share("page_id").alias("resilience"))
    e = table(spark, d, "events")
    state = F.to_json(F.struct(F.concat(F.lit("worth "), (F.col("event_id") % 9).cast("string")).alias("insight"), F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")).alias("context"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10) / 10).alias("utility")))
    states = e.select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 4 == 0, "no json").otherwise(state).alias("data"))
    return datasets.collected([datasets.decisions(made), datasets.debates(said.select(F.col("conv_id").alias("key"), "query", "verdict", share("conv_id").alias("convergence"))), datasets.reviews(judged), datasets.red_teams(attacks), datasets.experiences(states)])


@query(f"WITH {_SAMPLES} SELECT * FROM samples")
def export_samples(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d)


@query(f"WITH {_SAMPLES} SELECT source, kind, count(*) AS n, round(avg(confidence), 6) AS confidence FROM samples GROUP BY ALL")
def export_sources(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).groupBy("source", "kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query()
def export_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Samples that are left when near repeats are removed in order."""
    return datasets.distinct(_samples(spark, d)).select("id", "kind", "source", "confidence")


@query("SELECT event_type, round(stddev_pop(value), 6) AS std_dev, round(stddev_pop(value), 6) AS unknown_falls_back, round(avg(abs(value)), 6) AS mean_size FROM events GROUP BY event_type")
def registered_measures(spark: SparkSession, d: str) -> DataFrame:
    """A built-in measure, an unknown one (the deviation stands in), and one that is added here, of events by type."""
    measures = Measures(spark)
    measures.register("mean_size", Summed(lambda v: np.array([len(v), np.abs(v).sum()]), lambda t: t[1] / t[0]))
    rows = table(spark, d, "events").select("event_type", "value")
    out = None
    for name, to in (("std_dev", "std_dev"), ("no_such_measure", "unknown_falls_back"), ("mean_size", "mean_size")):
        one = measures.apply(rows, "event_type", "value", name).select("event_type", F.round("measure", 6).alias(to))
        out = one if out is None else out.join(one, "event_type")
    return out


@query("""
    WITH p AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT id, round(list_cosine_similarity(x, y), 6) AS cosine, round(1 / (1 + list_distance(x, y)), 6) AS euclidean, round(list_dot_product(x, y), 6) AS dot, round(greatest(0, least(1, list_cosine_similarity(x, y))), 6) AS clamped FROM p""")
def similarity_choices(spark: SparkSession, d: str) -> DataFrame:
    """Each vector against the next one, by every similarity that can be chosen."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = v.withColumnRenamed("embedding", "x").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    of = lambda kind: F.round(vectors.similarity("x", "y", kind), 6)
    return both.select(F.col("vec_id").alias("id"), of("cosine").alias("cosine"), of("euclidean").alias("euclidean"), of("dotProduct").alias("dot"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), of("cosine"))).alias("clamped"))
