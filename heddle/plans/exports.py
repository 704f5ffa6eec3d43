"""Queries over upserts, keys, citations, entities by name and dataset exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import service, sinks
from heddle.plans.registry import query
from heddle.plans.units import UNITS
from heddle.sources.tables import memory_units, table


@query("""
    WITH n AS (SELECT doc_id AS id, 'patched ' || doc_id AS text, 2 AS v FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT -doc_id - 1, 'new', 2 FROM documents WHERE doc_id % 100 = 0),
    a AS (SELECT doc_id AS id, substr(coalesce(text, ''), 1, 50) AS text, 1 AS v FROM documents UNION ALL SELECT * FROM n)
    SELECT id, arg_max(text, v) AS text, max(v)::INTEGER AS v FROM a GROUP BY id""")
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after a batch that changes one in ten and adds one in a hundred."""
    docs = table(spark, d, "documents")
    old = docs.select(F.col("doc_id").alias("id"), F.substring(F.coalesce("text", F.lit("")), 1, 50).alias("text"), F.lit(1).alias("v"))
    changed = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("patched "), F.col("doc_id").cast("string")).alias("text"), F.lit(2).alias("v"))
    added = docs.filter("doc_id % 100 = 0").select((-F.col("doc_id") - 1).alias("id"), F.lit("new").alias("text"), F.lit(2).alias("v"))
    return sinks.upserted(old, changed.union(added), "id", "v")


@query(f"WITH {UNITS} SELECT id AS src, id + 1 AS dst, kind AS type, CASE WHEN id % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS weight, coalesce(confidence, 0.8) AS confidence FROM u")
def memory_upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations of stored units, whose confidence is 0.8 if they state none."""
    to = F.array(F.struct((F.col("id") + 1).alias("target"), F.col("kind").alias("type"), F.when(F.col("id") % 3 == 0, 0.9).alias("weight")))
    units = memory_units(spark, d).withColumn("relations", to)
    return sinks.memory_edges(units).join(units.select(F.col("id").alias("src"), F.coalesce("confidence", F.lit(0.8)).alias("confidence")), "src")


@query(f"WITH {UNITS} SELECT id, kind FROM u ORDER BY ts DESC, id LIMIT 50")
def latest_units(spark: SparkSession, d: str) -> DataFrame:
    """The last fifty units, which persisting takes."""
    return memory_units(spark, d).orderBy(F.desc("ts"), "id").limit(50).select("id", "kind")


@query()
def chunk_keys(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", sinks.content_key(text).alias("key"))


@query("SELECT doc_id, substr(sha256(trim(lower(coalesce(source, '')))), 1, 16) AS topic FROM documents")
def topic_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sinks.topic_key(F.coalesce("source", F.lit(""))).alias("topic"))


@query("SELECT page_id, url, split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1) AS title FROM pages")
def citation_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", sinks.host(F.col("url")).alias("title"))


@query("""
    WITH s AS (SELECT page_id % 40 AS answer, split_part(split_part(url, '?', 1), '//', 2) AS url, min(page_id) AS place FROM pages GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY place, url) AS r FROM s QUALIFY r <= 6)
    SELECT answer, 'Sources: ' || string_agg('[' || r || '] ' || url, ' ' ORDER BY r) AS block FROM r GROUP BY answer""")
def citation_block(spark: SparkSession, d: str) -> DataFrame:
    """Pages as the sources of answers: the first six distinct addresses of each."""
    pages = table(spark, d, "pages").select((F.col("page_id") % 40).alias("answer"), F.split(F.split("url", r"\?")[0], "//")[1].alias("url"), F.col("page_id").alias("place"))
    return sinks.cited(pages, "answer", "url")


@query("""
    WITH e AS (SELECT n_nationkey AS id, n_name AS name, 0 AS new FROM nation UNION ALL SELECT n_nationkey + 100, lower(n_name), 1 FROM nation UNION ALL SELECT r_regionkey + 200, r_name, 1 FROM region)
    SELECT id, name FROM e QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY new, id) = 1""")
def entity_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Entities by name whatever its case, those already in the graph first."""
    nation = table(spark, d, "nation")
    known = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(0).alias("new"))
    new = nation.select((F.col("n_nationkey") + 100).alias("id"), F.lower("n_name").alias("name"), F.lit(1).alias("new"))
    more = table(spark, d, "region").select((F.col("r_regionkey") + 200).alias("id"), F.col("r_name").alias("name"), F.lit(1).alias("new"))
    return sinks.case_folded(known.union(new).union(more), "name", ["new", "id"]).select("id", "name")


@query("""
    WITH c AS (SELECT p_brand AS name, 'Brand#' || (replace(p_brand, 'Brand#', '')::INT % 7) AS canonical, p_partkey AS id FROM part)
    SELECT canonical, min(id) AS id, count(DISTINCT name) AS names FROM c GROUP BY canonical""")
def entity_canonical_groups(spark: SparkSession, d: str) -> DataFrame:
    """Names of a group under its canonical one, the first entity staying."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("id"))
    group = part.select("name").distinct().select(F.col("name").alias("_name"), F.concat(F.lit("Brand#"), (F.regexp_extract("name", r"\d+", 0).cast("int") % 7).cast("string")).alias("canonical"))
    return part.join(group, F.col("name") == F.col("_name")).groupBy("canonical").agg(F.min("id").alias("id"), F.countDistinct("name").alias("names"))


@query("""
    WITH e AS (SELECT unnest(['the', 'una', 'eine', 'aux']) AS name), c AS (SELECT name, doc_id, substr(text, 1, 300) AS context FROM e JOIN documents ON contains(lower(coalesce(text, '')), name))
    SELECT name, doc_id, context, row_number() OVER (PARTITION BY name ORDER BY doc_id)::INTEGER AS place FROM c QUALIFY place <= 5""")
def entity_profile_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents that hold an entity's name: a few names, kept in each task, against all rows."""
    from pyspark.sql import window as W

    names = F.explode(F.filter(F.array(*map(F.lit, ("the", "una", "eine", "aux"))), lambda n: F.lower(F.coalesce("text", F.lit(""))).contains(n)))
    found = table(spark, d, "documents").select(names.alias("name"), "doc_id", F.substring("text", 1, 300).alias("context"))
    order = W.Window.partitionBy("name").orderBy("doc_id")
    return found.withColumn("place", F.row_number().over(order)).filter("place <= 5")


@query("""
    WITH d AS (SELECT event_id AS id, user_id FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS id, event_id - 1 AS pending, value FROM events)
    SELECT d.id, user_id, r.id AS reflection, round(value, 2) AS value FROM d JOIN r ON r.pending = d.id""")
def improved_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with the reflection that follows from them: two joins by key."""
    events = table(spark, d, "events")
    decided = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id")
    reflected = events.select((F.col("event_id") - 1).alias("id"), F.col("event_id").alias("reflection"), F.round("value", 2).alias("value"))
    return decided.join(reflected, "id")


@query("SELECT (SELECT count(*) FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user') AS sft, (SELECT count(*) FROM documents b JOIN labels l USING (doc_id) WHERE quality = 0 AND EXISTS (SELECT 1 FROM documents g JOIN labels k USING (doc_id) WHERE k.quality = 1 AND g.source IS NOT DISTINCT FROM b.source)) AS dpo, 'sft.jsonl,dpo.jsonl' AS files, 0.6::DOUBLE AS min_confidence")
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.manifest(service.exchanges(table(spark, d, "conversations")), service.preference_pairs(table(spark, d, "documents"), table(spark, d, "labels")), 0.6)
