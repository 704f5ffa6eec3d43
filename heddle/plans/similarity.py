"""Queries on similar units. The vectors' similarities reach 0.52 only, so thresholds are stated here, lower than the operators' usual ones."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.functions.vectors import nearest
from heddle.operators import pairs, similar, vector_index
from heddle.plans.registry import query
from heddle.plans.units import UNITS
from heddle.sources.kept import kept
from heddle.sources.tables import memory_units, table

LEAST = 0.25
_COSINE = "coalesce(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), 0)"
_PAIRS = f"p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"
_CLUSTERS = f"""
    {_PAIRS}, e AS (SELECT a AS x, b AS y FROM p WHERE score > {LEAST} UNION ALL SELECT b, a FROM p WHERE score > {LEAST}),
    reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
    c AS (SELECT x AS id, min(y) AS cluster FROM reach GROUP BY x)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query(f"WITH {_PAIRS} SELECT a, b, score FROM p WHERE score >= {LEAST}")
def vector_pairs_ge(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pairs(_vectors(spark, d), LEAST)


@query(f"WITH {_PAIRS} SELECT a, b, score, row_number() OVER (ORDER BY score DESC, a, b)::INTEGER AS rank FROM p WHERE score >= {LEAST} QUALIFY rank <= 20")
def contradiction_candidates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.contradictions(pairs.pairs(_vectors(spark, d), LEAST))


@query(f"""
    WITH {UNITS}, {_PAIRS}, s AS (SELECT a, b, score, coalesce(list_has_any(x.entities, y.entities), false) AS shared FROM p LEFT JOIN u x ON x.id = a LEFT JOIN u y ON y.id = b WHERE score > {LEAST})
    SELECT a AS src, b AS dst, CASE WHEN shared THEN 'CAUSAL' ELSE 'TEMPORAL_FOLLOW' END AS type, score AS weight FROM s
    UNION ALL SELECT b, a, CASE WHEN shared THEN 'INVOLVES' ELSE 'TEMPORAL_FOLLOW' END, score FROM s""")
def relation_binding(spark: SparkSession, d: str) -> DataFrame:
    named = _vectors(spark, d).select("vec_id", "embedding").join(memory_units(spark, d).select(F.col("id").alias("vec_id"), "entities"), "vec_id", "left")
    return pairs.relations(similar.sharing(named, LEAST, "entities"))


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT id, cluster FROM c")
def synthesis_components(spark: SparkSession, d: str) -> DataFrame:
    return pairs.clusters(_vectors(spark, d), LEAST)


@query(f"""
    WITH RECURSIVE {_CLUSTERS}, k AS (SELECT id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY id) AS k, count(*) OVER (PARTITION BY cluster) AS n FROM c),
    s AS (SELECT cluster, n, pow(0.5, CASE WHEN k = 1 THEN n - 1 ELSE n - k + 1 END) AS w, unnest(embedding) AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS place FROM k JOIN embeddings ON vec_id = id)
    SELECT cluster, place, max(n) AS members, round(sum(w * x::DOUBLE), 6) AS value FROM s GROUP BY cluster, place""")
def synthesis_pairwise_merge(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return pairs.merged(pairs.clusters(v, LEAST), v)


@query(f"""
    WITH RECURSIVE {UNITS}, {_CLUSTERS} SELECT cluster, max(coalesce(confidence, 0.7)) AS confidence, count(*) AS members FROM c LEFT JOIN u ON u.id = c.id GROUP BY cluster""")
def synthesis_confidence(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.clusters(_vectors(spark, d), LEAST).join(memory_units(spark, d).select("id", "confidence"), "id", "left")
    return found.groupBy("cluster").agg(F.max(F.coalesce("confidence", F.lit(0.7))).alias("confidence"), F.count("*").alias("members"))


@query(f"WITH {_PAIRS} SELECT a AS target, b AS source, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INTEGER AS rank FROM p WHERE score >= {LEAST} QUALIFY rank <= 5")
def consolidation_queue_topk(spark: SparkSession, d: str) -> DataFrame:
    return pairs.update_queues(similar.best_later(_vectors(spark, d), LEAST, 5))


@query(f"""
    WITH {UNITS}, {_PAIRS}, q AS (SELECT a AS target, b AS source FROM p WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
    SELECT u.id, coalesce(n.id, u.id) AS content_of, coalesce(n.ts, u.ts) AS ts, n.id IS NOT NULL AS updated FROM u LEFT JOIN q ON q.target = u.id LEFT JOIN u n ON n.id = q.source""")
def consolidated_units(spark: SparkSession, d: str) -> DataFrame:
    """Units whose content and time are those of the best newer source, all from the snapshot before any update."""
    best = pairs.update_queues(similar.best_later(_vectors(spark, d), LEAST, 1), 1).select(F.col("target").alias("id"), "source")
    units = memory_units(spark, d).select("id", "ts")
    newer = units.select(F.col("id").alias("source"), F.col("ts").alias("_ts"))
    out = units.join(best, "id", "left").join(newer, "source", "left")
    known = F.col("_ts").isNotNull()
    return out.select("id", F.when(known, F.col("source")).otherwise(F.col("id")).alias("content_of"), F.coalesce("_ts", "ts").alias("ts"), known.alias("updated"))


@query(f"""
    WITH RECURSIVE {_PAIRS}, o AS MATERIALIZED (SELECT a, b, a * 37 % 100 >= b * 37 % 100 AS stays, row_number() OVER (ORDER BY a, b) AS k FROM p WHERE score >= {LEAST}),
    g(k, gone, keep, remove) AS (
        SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
        UNION ALL
        SELECT o.k, CASE WHEN fine THEN list_append(gone, CASE WHEN stays THEN b ELSE a END) ELSE gone END, CASE WHEN fine THEN CASE WHEN stays THEN a ELSE b END END, CASE WHEN fine THEN CASE WHEN stays THEN b ELSE a END END
        FROM (SELECT o.*, g.gone, NOT list_contains(gone, a) AND NOT list_contains(gone, b) AS fine FROM g JOIN o ON o.k = g.k + 1) o)
    SELECT keep, remove FROM g WHERE keep IS NOT NULL""")
def crystallizer_merges(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).withColumn("confidence", F.pmod(F.col("vec_id") * 37, F.lit(100)) / 100)
    return pairs.crystallised(v, LEAST)


@query(f"""
    WITH RECURSIVE {_PAIRS}, n AS (SELECT b AS id, list(a) AS earlier FROM p WHERE score >= {LEAST} GROUP BY b),
    o AS MATERIALIZED (SELECT vec_id AS id, coalesce(earlier, []) AS earlier, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings LEFT JOIN n ON id = vec_id),
    g(k, id, taken, accepted) AS (
        SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[], false
        UNION ALL SELECT o.k, o.id, CASE WHEN list_has_any(earlier, taken) THEN taken ELSE list_append(taken, o.id) END, NOT list_has_any(earlier, taken) FROM g JOIN o ON o.k = g.k + 1)
    SELECT id, accepted FROM g WHERE k > 0""")
def novelty_greedy(spark: SparkSession, d: str) -> DataFrame:
    return pairs.novel(_vectors(spark, d), LEAST)


@query("""
    WITH s AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM s GROUP BY ALL),
    c AS (SELECT label, list(x ORDER BY i) AS centroid FROM m GROUP BY label)
    SELECT label, vec_id AS id, coalesce(round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6), 0) AS score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank
    FROM embeddings JOIN c USING (label) QUALIFY rank <= 5""")
def centroid_seeds(spark: SparkSession, d: str) -> DataFrame:
    return pairs.seeds(_vectors(spark, d), "label")


@query(f"""
    WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS sim, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS exact FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT query_id, id, round(exact * 0.5, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INTEGER AS rank FROM n WHERE sim >= {LEAST} QUALIFY rank <= 10""")
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """The channel of hybrid retrieval: the ten nearest above the floor, at half weight."""
    v = _vectors(spark, d)
    return nearest(v.filter("vec_id % 50 = 0"), v, 10, least=LEAST, weight=0.5)


@query()
def vector_index_search(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest by inverted lists, recall measured by test; `vector_topk` is the exact way."""
    v = _vectors(spark, d)
    path = kept(spark, d, "vectors", ["embeddings"], lambda at: vector_index.build(v, at))
    return vector_index.search(spark, path, v.filter("vec_id % 50 = 0"), 10)


@query(f"""
    WITH n AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND b.label = 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM n WHERE score >= 0.1 QUALIFY rank <= 3)
    SELECT query_id, count(*) AS skills, string_agg('- skill ' || id, chr(10) ORDER BY rank) AS block FROM r GROUP BY query_id""")
def skill_inject(spark: SparkSession, d: str) -> DataFrame:
    """The three skills (units of one label) nearest to each question, as one block of text."""
    v = _vectors(spark, d)
    best = nearest(v.filter("vec_id % 50 = 0"), v.filter("label = 3"), 3, least=0.1)
    line = F.struct("rank", F.concat(F.lit("- skill "), F.col("id").cast("string")).alias("x"))
    return best.groupBy("query_id").agg(F.count("*").alias("skills"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda r: r["x"]), "\n").alias("block"))


@query("""
    WITH a AS (SELECT unnest([0, 1, 2]) AS axis, unnest([0.5, 0.3, 0.02]) AS variance),
    n AS (SELECT axis, variance, sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[axis + 1:axis + 21]])) AS norm FROM embeddings, a)
    SELECT axis::INTEGER AS axis, round(least(1.0, stddev_pop(norm) / max(variance)), 6) AS coverage, coverage < 0.3 AS gap FROM n GROUP BY axis""")
def skill_gap_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pairs.slice_coverage(_vectors(spark, d), [(0, 0.5), (1, 0.3), (2, 0.02)])


@query()
def trace_clusters(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, cluster: k-means (k-means|| seeding, five clusters) over all vectors, which MLlib keeps distributed."""
    rows = _vectors(spark, d).select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=5, seed=7, maxIter=50).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query()
def skill_basis(spark: SparkSession, d: str) -> DataFrame:
    """axis, variance (the axis's share of all variance), vec_id, weight, rank: the five vectors that lie farthest along each of three principal axes."""
    rows = _vectors(spark, d).select("vec_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = PCA(k=3, inputCol="features", outputCol="p").fit(rows)
    shares = F.array(*[F.lit(float(x)) for x in model.explainedVariance.toArray()])
    along = model.transform(rows).select("vec_id", F.posexplode(vector_to_array("p")).alias("axis", "weight"))
    order = W.Window.partitionBy("axis").orderBy(F.desc(F.abs(F.col("weight"))), "vec_id")
    return along.withColumn("rank", F.row_number().over(order)).filter("rank <= 5").withColumns({"weight": F.round(F.abs(F.col("weight")), 6), "variance": F.round(F.get(shares, F.col("axis")), 6)})
