"""Queries over memory units, conversations and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import recall
from heddle.plans.registry import query
from heddle.sources.tables import memory_units, table, vertices

NOW = "2024-01-01 16:00:00"
WORDS = "an"
SPACE = "[ \\t\\r\\n\\f]"
_PHRASES = "array_to_string(list_sort(list_distinct((regexp_extract_all(coalesce(text, ''), '\\b[A-Z][a-z]+(?:[ \\t\\r\\n\\f]+[A-Z][a-z]+)*\\b'))[1:5])), ',')"
UNITS = f"""
    u AS (
        SELECT doc_id AS id, text AS content, CASE doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'event' WHEN 2 THEN 'summary' ELSE 'relation' END AS kind,
               CASE WHEN doc_id % 7 <> 0 THEN (doc_id * 37 % 100) / 100 END AS confidence, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts,
               list_distinct((regexp_extract_all(coalesce(text, ''), '\\b[A-Z][a-z]+(?:[ \\t\\r\\n\\f]+[A-Z][a-z]+)*\\b'))[1:5]) AS entities, source
        FROM documents)"""
_QUESTIONS = "q AS (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations WHERE role = 'user')"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"))


@query(f"WITH {UNITS} SELECT id, kind, confidence, ts FROM u WHERE id = 7")
def memory_by_id(spark: SparkSession, d: str) -> DataFrame:
    return memory_units(spark, d).filter("id = 7").select("id", "kind", "confidence", "ts").limit(1)


@query(f"WITH {UNITS} SELECT id, kind, source, substr(content, 1, 200) AS preview FROM u WHERE contains(lower(coalesce(content, '')), '{WORDS}') ORDER BY ts DESC, id LIMIT 20 OFFSET 20")
def memory_search_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the newest units with the words, with a preview of each."""
    found = recall.search(memory_units(spark, d), WORDS)
    return found.orderBy(F.desc("ts"), "id").offset(20).limit(20).select("id", "kind", "source", F.substring("content", 1, 200).alias("preview"))


@query(f"WITH {UNITS} SELECT count(*) AS total FROM u WHERE contains(lower(coalesce(content, '')), '{WORDS}')")
def memory_search_count(spark: SparkSession, d: str) -> DataFrame:
    return recall.search(memory_units(spark, d), WORDS).agg(F.count("*").alias("total"))


@query(f"""
    WITH {UNITS}, r AS (SELECT doc_id AS src, unnest([doc_id + 3, doc_id + 9]) AS dst, unnest(['follows', 'explains']) AS type FROM documents WHERE doc_id % 5 = 0)
    SELECT id, coalesce(string_agg(dst::VARCHAR, ',' ORDER BY dst, type), '') AS targets, coalesce(string_agg(type, ',' ORDER BY dst, type), '') AS kinds FROM u LEFT JOIN r ON src = id GROUP BY id""")
def memory_with_relations(spark: SparkSession, d: str) -> DataFrame:
    """Every unit with its relations; each fifth document has two."""
    to = F.explode(F.array(F.struct((F.col("doc_id") + 3).alias("dst"), F.lit("follows").alias("type")), F.struct((F.col("doc_id") + 9).alias("dst"), F.lit("explains").alias("type"))))
    relations = table(spark, d, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("src"), to.alias("r")).select("src", "r.dst", "r.type")
    return recall.related(memory_units(spark, d), relations)


@query(f"WITH {UNITS} SELECT id, CASE WHEN id % 50 = 0 THEN 'summary' ELSE kind END AS kind, CASE WHEN id % 100 = 0 THEN 0.9 ELSE confidence END AS confidence, source FROM u")
def memory_patch(spark: SparkSession, d: str) -> DataFrame:
    """Patches of some units; a null of a patch leaves the unit's own value."""
    rows = memory_units(spark, d).select("id", "kind", "confidence", "source")
    patch = rows.filter("id % 50 = 0").select("id", F.lit("summary").alias("kind"), F.when(F.col("id") % 100 == 0, 0.9).alias("confidence"))
    return recall.patched(rows, patch, "id")


@query(f"WITH {UNITS}, x AS (SELECT id, CASE WHEN id % 10 = 3 THEN ts + INTERVAL 1 HOUR END AS deleted_at, kind FROM u) SELECT kind, count(*) FILTER (deleted_at IS NULL) AS live, count(deleted_at) AS deleted FROM x GROUP BY kind")
def memory_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    marked = memory_units(spark, d).withColumn("deleted_at", F.when(F.col("id") % 10 == 3, F.col("ts") + F.expr("INTERVAL 1 HOUR")))
    return marked.groupBy("kind").agg(F.count_if(F.col("deleted_at").isNull()).alias("live"), F.count("deleted_at").alias("deleted"))


@query(f"""
    WITH {UNITS}, f AS (
        SELECT id, coalesce(confidence, 0.5) AS confidence FROM u
        WHERE kind IN ('fact', 'event') AND coalesce(confidence, 0.5) >= 0.3 AND list_has_any(list_transform(entities, lambda e: lower(e)), ['the', 'la', 'en', 'el']) AND ts <= TIMESTAMP '{NOW}' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)
    SELECT id, confidence, round(confidence * 0.2, 6) AS score, row_number() OVER (ORDER BY confidence DESC, id)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def symbolic_search(spark: SparkSession, d: str) -> DataFrame:
    return recall.symbolic(memory_units(spark, d), NOW, "recent", ["The", "La", "En", "El"], 0.3, ["fact", "event"])


@query(f"WITH {UNITS} SELECT kind, count(*) AS n, min(id) AS first, max(id) AS last FROM u WHERE ts BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 12:00:00' GROUP BY kind")
def memory_time_range(spark: SparkSession, d: str) -> DataFrame:
    found = memory_units(spark, d).filter(F.col("ts").between(F.lit("2024-01-01 01:00:00").cast("timestamp_ntz"), F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query(f"SELECT doc_id AS id, {_PHRASES} AS entities FROM documents")
def entity_phrases(spark: SparkSession, d: str) -> DataFrame:
    return memory_units(spark, d).select("id", F.array_join(F.array_sort("entities"), ",").alias("entities"))


@query("SELECT doc_id AS id, substr(coalesce(text, ''), 1, 500) AS fact, 'fact' AS kind FROM documents WHERE length(coalesce(text, '')) > 0")
def fact_fallback(spark: SparkSession, d: str) -> DataFrame:
    """One fact a document, its first 500 characters: what extraction falls back to."""
    return table(spark, d, "documents").filter(F.length(F.coalesce("text", F.lit(""))) > 0).select(F.col("doc_id").alias("id"), F.substring("text", 1, 500).alias("fact"), F.lit("fact").alias("kind"))


@query("SELECT conv_id, turn FROM conversations WHERE len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[.!?]+') IF length(trim(x)) > 15]) >= 2")
def density_gate(spark: SparkSession, d: str) -> DataFrame:
    return recall.dense(table(spark, d, "conversations"), "text").select("conv_id", "turn")


@query("SELECT page_id, nullif(regexp_extract(coalesce(url, '') || ' 2024-03-05T10:11 ' || page_id, '\\d{4}-\\d{2}-\\d{2}(?:T\\d{2}:\\d{2}(?::\\d{2})?)?'), '') AS dated FROM pages")
def dated_pages(spark: SparkSession, d: str) -> DataFrame:
    stamped = F.concat(F.coalesce("url", F.lit("")), F.lit(" 2024-03-05T10:11 "), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", recall.dated(stamped).alias("dated"))


@query(rf"""
    WITH {_QUESTIONS}
    SELECT conv_id, turn, CASE WHEN regexp_matches(q, '{recall.MANY_HOPS}') OR len(regexp_extract_all(q, '\b[A-Z][a-z]+\b')) > 1 THEN 15
           WHEN len(regexp_split_to_array(q, '{SPACE}+')) > 10 THEN 8 WHEN len(regexp_split_to_array(q, '{SPACE}+')) > 5 THEN 5 ELSE 3 END::INTEGER AS depth,
           array_to_string([w FOR w IN regexp_split_to_array(regexp_replace(lower(q), '[^a-z0-9 \t\r\n\f]', '', 'g'), '{SPACE}+') IF length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in recall.STOP_WORDS)})], ' ') AS keywords
    FROM q""")
def intent_plan(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d)
    return q.select("conv_id", "turn", recall.depth(F.col("q")).cast("int").alias("depth"), recall.keywords(F.col("q")).alias("keywords"))


@query(rf"""
    WITH {_QUESTIONS}, m AS (SELECT conv_id, turn, regexp_matches(lower(q), '{recall.LOW}') AS lo, regexp_matches(lower(q), '{recall.HIGH}') AS hi FROM q)
    SELECT conv_id, turn, CASE WHEN lo AND NOT hi THEN 'low' WHEN hi AND NOT lo THEN 'high' ELSE 'hybrid' END AS level FROM m""")
def dual_level_route(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("conv_id", "turn", recall.level(F.col("q")).alias("level"))


@query(rf"WITH {_QUESTIONS} SELECT conv_id, turn, length(q) < 20 OR (regexp_matches(q, '{recall.VAGUE}') AND NOT regexp_matches(q, '{recall.EXACT}')) AS fuzzy FROM q")
def fuzzy_questions(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("conv_id", "turn", recall.fuzzy(F.col("q")).alias("fuzzy"))


@query(rf"""
    WITH {_QUESTIONS}, t AS (SELECT conv_id * 1000 + turn AS id, q FROM q)
    SELECT id, 'hyde' AS technique, 'Hypothetical document: ' || q || ' explained in detail with examples.' AS query FROM t
    UNION ALL SELECT id, 'multi_query', q || ' pros and cons' FROM t UNION ALL SELECT id, 'multi_query', q || ' implementation details' FROM t
    UNION ALL SELECT id, 'step_back', 'What is the broader context of: ' || q FROM t UNION ALL SELECT id, 'query_rewriting', 'Detailed explanation of: ' || q FROM t
    UNION ALL SELECT id, 'intent_clarification', 'The user wants to know: ' || q FROM t""")
def query_translations(spark: SparkSession, d: str) -> DataFrame:
    return recall.translations(_questions(spark, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "q"), "id", "q")


@query("SELECT count(*) FILTER (source IS NULL) AS orphans, count(*) AS total FROM (SELECT CASE WHEN doc_id % 13 <> 0 THEN source END AS source FROM documents)")
def orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a source, where each thirteenth has lost its own."""
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 13 != 0, F.col("source")).alias("source"))
    return docs.agg(F.count_if(F.col("source").isNull()).alias("orphans"), F.count("*").alias("total"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 13 <> 0 THEN source END, 'default') AS source FROM documents")
def orphan_backfill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 13 != 0, F.col("source")), F.lit("default")).alias("source"))


_V = "v AS (SELECT 'Nation:' || n_nationkey AS id, 'Nation' AS label, n_name AS name FROM nation UNION ALL SELECT 'Supplier:' || s_suppkey, 'Supplier', s_name FROM supplier UNION ALL SELECT 'Part:' || p_partkey, 'Part', p_name FROM part)"


@query(f"WITH {_V} SELECT id, label, name FROM v WHERE contains(lower(name), '1') AND label IN ('Nation', 'Supplier') ORDER BY name, id LIMIT 50")
def entity_list(spark: SparkSession, d: str) -> DataFrame:
    """Entities of two labels whose name holds a text that is taken literally."""
    return recall.matching(vertices(spark, d), "1", ["name"], ["Nation", "Supplier"]).orderBy("name", "id").limit(50)


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY p_type")
def entity_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT 'Part:' || p_partkey AS id, p_name AS name FROM part ORDER BY p_name, p_partkey LIMIT 100")
def nodes_by_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").orderBy("p_name", "p_partkey").limit(100).select(F.concat(F.lit("Part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))


@query("SELECT user_id, event_type, (props->>'$.k')::BIGINT AS k, coalesce(TRY_CAST(props->>'$.missing' AS DOUBLE), 0) AS score FROM events WHERE event_type LIKE 'c%'")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """Values by path out of the events' JSON, 0 where the path leads nowhere; types by prefix."""
    events = table(spark, d, "events").filter(F.col("event_type").startswith("c"))
    at = lambda path: F.get_json_object("props", path)
    return events.select("user_id", "event_type", at("$.k").cast("long").alias("k"), F.coalesce(at("$.missing").cast("double"), F.lit(0.0)).alias("score"))


@query("SELECT page_id, url, regexp_matches(url, 'example\\.com/(en|de)/') AS safe FROM pages")
def safelisted_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url", F.col("url").rlike(r"example\.com/(en|de)/").alias("safe"))


def _compressed_sql(share: float, least: int) -> str:
    return rf"""
    WITH s AS (
        SELECT doc_id AS id, coalesce(text, '') AS t,
               [x FOR x IN [regexp_replace(y, '^{SPACE}+|{SPACE}+$', '', 'g') FOR y IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?]){SPACE}+', '\1' || chr(10), 'g'), '[\n\r]+')] IF length(x) >= {least}] AS s
        FROM documents),
    e AS (SELECT id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
    k AS (SELECT id, x, i, CASE WHEN regexp_matches(x, '{recall.FILLER}') THEN 0 ELSE len([w FOR w IN regexp_split_to_array(x, '{SPACE}+') IF length(w) > 2]) END AS score FROM e),
    r AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY score DESC, i) AS r FROM k),
    top AS (SELECT DISTINCT r.id, r.x FROM r JOIN s ON r.id = s.id WHERE r.r <= ceil(len(s.s) * {share}::DOUBLE)),
    kept AS (SELECT k.id, count(*) AS n, string_agg(k.x, ' ' ORDER BY k.i) AS text FROM k JOIN top ON k.id = top.id AND k.x = top.x GROUP BY k.id)
    SELECT s.id, len(s.s)::INTEGER AS sentences, (CASE WHEN len(s.s) <= 2 THEN len(s.s) ELSE kept.n END)::INTEGER AS kept, md5(CASE WHEN len(s.s) <= 2 THEN s.t ELSE kept.text END) AS text
    FROM s LEFT JOIN kept ON s.id = kept.id"""


@query(_compressed_sql(0.5, 10))
def precompress_top(spark: SparkSession, d: str) -> DataFrame:
    return recall.compressed(memory_units(spark, d))


@query(f"""
    WITH s AS (
        SELECT doc_id AS id, [x FOR x IN [regexp_replace(y, '^{SPACE}+|{SPACE}+$', '', 'g') FOR y IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?]){SPACE}+', '\\1' || chr(10), 'g'), '[\\n\\r]+')] IF length(x) >= 10] AS s
        FROM documents),
    e AS (SELECT id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s),
    k AS (SELECT id, x, i, CASE WHEN regexp_matches(x, '{recall.FILLER}') THEN 0 ELSE len([w FOR w IN regexp_split_to_array(x, '{SPACE}+') IF length(w) > 2]) END AS score FROM e),
    t AS (SELECT id, list_sort(list(score))[least(floor(count(*) * 0.7), count(*) - 1)::INTEGER + 1] AS least FROM k GROUP BY id)
    SELECT id, count(*) AS sentences, count(*) FILTER (score >= least) AS kept, md5(string_agg(x, ' ' ORDER BY i) FILTER (score >= least)) AS text FROM k JOIN t USING (id) GROUP BY id""")
def precompress_percentile(spark: SparkSession, d: str) -> DataFrame:
    """The sentences that score in the upper three tenths of their unit."""
    found = recall.above_percentile(recall.scored_sentences(memory_units(spark, d)), 0.3)
    return found.withColumn("text", F.md5(F.col("text").cast("binary")))


@query("""
    WITH m AS (SELECT doc_id, length(coalesce(text, '')) / 5000 AS size, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) / greatest(1, length(coalesce(text, ''))) AS capitals, (lang = 'de')::INT AS german FROM documents)
    SELECT doc_id, CASE WHEN capitals >= 0.2 THEN 'shouted' WHEN size > 0.9 THEN 'long' WHEN german > 0.5 THEN 'german' WHEN size <= 0.02 THEN 'short' ELSE 'other' END AS route FROM m""")
def routed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents sent on by conditions on their metrics; the first that holds decides."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    metrics = {"size": size / 5000, "capitals": F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.lit(1), size), "german": (F.col("lang") == "de").cast("int")}
    routes = {"capitals>=0.2": "shouted", "size > 0.9": "long", "german": "german", "size<=0.02": "short", "no_metric > 0": "never", "default": "other"}
    return table(spark, d, "documents").select("doc_id", recall.routed(metrics, routes).alias("route"))
