"""Named queries of the engine, each with the SQL that DuckDB checks it against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.vectors import cosine, nearest
from heddle.operators import graph, index, memory, retrieval, service
from heddle.plans import buffers, chunks, datasets, exports, groups, panels, similarity, units, written  # noqa: F401  their queries register themselves
from heddle.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from heddle.sources.adjacency import Adjacency
from heddle.sources.kept import kept
from heddle.sources.tables import EDGES, VERTICES, edges, memory_units, table, vertices
from heddle.streaming import metrics

#: Words that the keyword queries look for, and the vertex that the graph queries start from.
WORDS = ["the", "und", "que"]
START = "Nation:7"
BUDGET, TOP = 4_000, 50
BUCKETS = [1.0, 5.0, 10.0, 50.0, 100.0]

_COSINE = "coalesce(round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6), 0)"
_TERMS = "[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+') IF length(x) >= 3]"
_HITS = " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in WORDS)
_BM25 = f"""
    t AS (SELECT doc_id, {_TERMS} AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, {", ".join(f"len([x FOR x IN w IF x = '{w}']) AS f{i}" for i, w in enumerate(WORDS))} FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(WORDS)))} FROM c),
    bm25 AS (
        SELECT doc_id, round({" + ".join(f"ln(1 + (docs - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))" for i in range(len(WORDS)))}, 6) AS score
        FROM c, s WHERE {" OR ".join(f"f{i} > 0" for i in range(len(WORDS)))})"""
_VERTICES = " UNION ALL ".join(f"SELECT '{label}:' || {key} AS id, '{label}' AS label, {name} AS name FROM {t}" for label, t, key, name in VERTICES)
_EDGES = " UNION ".join(f"SELECT '{a}:' || {ak} AS src, '{b}:' || {bk} AS dst, '{kind}' AS type FROM {t} WHERE {ak} IS NOT NULL AND {bk} IS NOT NULL" for kind, t, a, ak, b, bk in EDGES)
_GRAPH = f"v AS ({_VERTICES}), e AS ({_EDGES}), b AS (SELECT src AS id, dst AS other, type, 'out' AS direction FROM e UNION ALL SELECT dst, src, type, 'in' FROM e)"
_NEAREST = f"""
    near AS (
        SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE.format(a="a.embedding", b="b.embedding")} AS score
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


@query(f"WITH {_NEAREST} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM near QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of every vector whose identifier is divisible by 50."""
    v = table(spark, d, "embeddings")
    return nearest(v.filter("vec_id % 50 = 0"), v, 10)


@query(f"WITH {_NEAREST} SELECT query_id, max(score) AS score, max(score) < 0.4 AS novel FROM near GROUP BY query_id")
def novelty_vs_existing(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return memory.novelty(v.filter("vec_id % 50 = 0"), v, 0.4)


@query(f"SELECT doc_id, ({_HITS}) / 3.0::DOUBLE AS score FROM documents WHERE ({_HITS}) > 0")
def keyword_contains(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.contains(table(spark, d, "documents"), WORDS).select("doc_id", "score")


def _terms(spark: SparkSession, d: str) -> str:
    return kept(spark, d, "terms", ["documents"], lambda at: index.build(table(spark, d, "documents"), at))


def prepare(spark: SparkSession, d: str) -> None:
    """Build the stores that queries share, where they are not there yet; else the first query that needs one does."""
    _terms(spark, d)
    Adjacency(spark, d)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, score by the term index of the documents."""
    return index.bm25(spark, _terms(spark, d), WORDS)


@query(f"WITH {_BM25} SELECT doc_id, score FROM bm25")
def keyword_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


_HYBRID = f"""
    WITH {_BM25},
    q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    every AS (
        SELECT doc_id AS id, {_COSINE.format(a="embedding", b="q")} AS score, 'vector' AS source, 0 AS ord FROM q, embeddings JOIN documents ON vec_id = doc_id
        UNION ALL SELECT doc_id, round(score / 10, 6), 'keyword', 1 FROM bm25),
    best AS (SELECT id, score, source FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1),
    head AS (
        SELECT id, score, best.source AS source, ceil(length(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM best JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT {TOP}),
    sums AS (SELECT id, source, score, tokens, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank, (sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM head)
    SELECT * FROM sums WHERE running <= {BUDGET}"""


@query(_HYBRID)
def hybrid_union_rank(spark: SparkSession, d: str) -> DataFrame:
    """Vector and keyword channels for one question, the best score of each document, cut at a token budget."""
    docs, v = table(spark, d, "documents"), table(spark, d, "embeddings")
    ask = v.filter("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    near = v.join(F.broadcast(ask)).select(F.col("vec_id").alias("id"), F.round(cosine("embedding", "_q"), 6).alias("score"), F.lit("vector").alias("source"))
    near = near.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    words = _scored(spark, d).select(F.col("doc_id").alias("id"), F.round(F.col("score") / 10, 6).alias("score"), F.lit("keyword").alias("source"))
    best = retrieval.best_of([near, words])
    head = best.orderBy(F.desc("score"), "id").limit(TOP)
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(head), "id")
    return retrieval.within_budget(texts, BUDGET, top=TOP).select("id", "source", "score", "tokens", "rank", "running")


_FUSED = f"""
    WITH q AS (SELECT vec_id AS ask, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), docs AS (SELECT * FROM documents WHERE doc_id IS NOT NULL),
    t AS (SELECT doc_id, {_TERMS} AS w FROM docs), size AS (SELECT doc_id, len(w) AS n FROM t), total AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t),
    tf AS (SELECT doc_id, term, count(*) AS f FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
    asked AS (SELECT ask, term, d FROM (SELECT DISTINCT ask, unnest({_TERMS.replace("coalesce(text, '')", "substr(coalesce(text, ''), 1, 80)")}) AS term FROM q JOIN docs ON doc_id = ask) JOIN df USING (term)
              QUALIFY row_number() OVER (PARTITION BY ask ORDER BY d, term) <= 3),
    words AS (SELECT ask, doc_id AS id, round(round(sum(ln(1 + (docs - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))), 6) * 0.02, 6) AS score
              FROM asked JOIN tf USING (term) JOIN size USING (doc_id), total WHERE doc_id <> ask GROUP BY ask, doc_id),
    near AS (SELECT ask, vec_id AS id, {_COSINE.format(a="q", b="embedding")} AS sim, list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[]) AS exact FROM q JOIN embeddings ON vec_id <> ask),
    vector AS (SELECT ask, id, round(exact * 0.5, 6) AS score FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY ask ORDER BY sim DESC, id) <= 16)),
    graph AS (SELECT ask, id, round((sim * 0.6 + CASE id - ask WHEN 3 THEN 0.9 ELSE 0.5 END) * 0.3, 6) AS score FROM near WHERE id - ask IN (3, 9)),
    every AS (
        SELECT * FROM (SELECT ask, id, score, 'vector' AS source, 0 AS place, row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS r FROM vector) WHERE r <= 16
        UNION ALL SELECT * FROM (SELECT ask, id, score, 'graph', 1, row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS r FROM graph) WHERE r <= 8
        UNION ALL SELECT * FROM (SELECT ask, id, score, 'keyword', 2, row_number() OVER (PARTITION BY ask ORDER BY score DESC, id) AS r FROM words) WHERE r <= 8),
    once AS (SELECT ask, id, arg_min(score, place) AS score, arg_min(source, place) AS source FROM every GROUP BY ask, id),
    sized AS (SELECT ask, id, once.source AS source, score, ceil(length(coalesce(text, '')) / 4)::BIGINT AS tokens FROM once JOIN docs ON doc_id = id),
    sums AS (SELECT *, row_number() OVER w::INTEGER AS rank, (sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM sized WINDOW w AS (PARTITION BY ask ORDER BY score DESC, id))
    SELECT ask, id, source, score, tokens, rank, running FROM sums WHERE running <= {BUDGET}""".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER")


@query(_FUSED)
def fused_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """For every question (a vector in fifty, with the head of its document) the vector, graph and keyword channels by weight, up to a token budget.

    The graph channel has what the question's unit follows or explains; keywords are its rarest terms, looked up in the term index.
    """
    v, docs = table(spark, d, "embeddings"), table(spark, d, "documents").filter("doc_id is not null")
    asks = v.filter("vec_id % 50 = 0")
    near = nearest(asks, v, 16, weight=0.5).select(F.col("query_id").alias("ask"), "id", "score")
    to = F.explode(F.array(F.struct((F.col("vec_id") + 3).alias("id"), F.lit(0.9).alias("w")), F.struct((F.col("vec_id") + 9).alias("id"), F.lit(0.5).alias("w"))))
    around = asks.select(F.col("vec_id").alias("ask"), F.col("embedding").alias("_q"), to.alias("r")).select("ask", "_q", "r.id", "r.w").join(v.withColumnRenamed("vec_id", "id"), "id")
    related = around.select("ask", "id", F.round((F.round(cosine("_q", "embedding"), 6) * 0.6 + F.col("w")) * 0.3, 6).alias("score"))
    path = _terms(spark, d)
    questions = docs.join(asks.select(F.col("vec_id").alias("ask")), F.col("doc_id") == F.col("ask")).select("ask", F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("text"))
    words = index.bm25_each(spark, path, index.asked_terms(spark, path, questions)).filter("id <> ask").withColumn("score", F.round(F.col("score") * 0.02, 6))
    found = retrieval.first_of_each({"vector": near, "graph": related, "keyword": words}, {"vector": 16, "graph": 8, "keyword": 8})
    texts = found.join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return retrieval.each_within_budget(texts, BUDGET).select("ask", "id", "source", "score", "tokens", "rank", "running")


@query(r"""
    WITH k AS (SELECT doc_id, substring(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\r\n]+', ' ', 'g'), ' '), 1, 200) AS key FROM documents)
    SELECT min(doc_id) AS doc_id, count(*) AS members, length(key)::INTEGER AS width FROM k GROUP BY key""")
def evidence_distinct(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.evidence(table(spark, d, "documents"))


@query("SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1")
def url_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each address."""
    return retrieval.first_by(table(spark, d, "pages").select("page_id", "url"), F.col("url"), ["page_id"])


@query("SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/]+)', 1) ORDER BY page_id) = 1")
def host_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each host."""
    return retrieval.first_by(table(spark, d, "pages").select("page_id", "url"), F.regexp_extract("url", r"^https?://([^/]+)", 1), ["page_id"])


@query("""
    WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
    w AS (SELECT conv_id, turn, unnest(range(greatest(0, floor((i - 5) / 3.0)::INT + 1), floor(i / 3.0)::INT + 1)) AS "window" FROM n)
    SELECT conv_id, "window"::INTEGER AS "window", min(turn) AS first, max(turn) AS last, count(*) AS n FROM w GROUP BY ALL""")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    return memory.sliding_windows(table(spark, d, "conversations"), "conv_id", "turn")


_MARKED = f"""
    s AS (SELECT label, vec_id, {_COSINE.format(a="embedding", b="p")} AS x, p FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)),
    y AS (SELECT label, vec_id, CASE WHEN p IS NOT NULL THEN x END AS similarity FROM s),
    z AS (SELECT *, coalesce(similarity < 0, false) AS low, coalesce(similarity < lag(similarity) OVER w AND similarity < lead(similarity) OVER w, false) AS least_ FROM y WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    marked AS (SELECT label, vec_id, similarity, CASE WHEN bool_or(low AND least_) OVER (PARTITION BY label) THEN low AND least_ ELSE low END AS boundary FROM z)"""


@query(f"WITH {_MARKED} SELECT * FROM marked")
def topic_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return memory.boundaries(table(spark, d, "embeddings"), "label", "vec_id")


@query(f"""
    WITH {_MARKED},
    r AS (SELECT label, vec_id, sum(boundary::INT) OVER (PARTITION BY label ORDER BY vec_id) AS s FROM marked),
    g AS (SELECT label, s, min(vec_id) AS first, max(vec_id) AS last, count(*) AS n FROM r GROUP BY ALL),
    o AS (SELECT *, (n >= 2 OR row_number() OVER (PARTITION BY label ORDER BY s) = 1)::INT AS opens FROM g),
    k AS (SELECT *, sum(opens) OVER (PARTITION BY label ORDER BY s) - 1 AS segment FROM o)
    SELECT label, segment::BIGINT AS segment, min(first) AS first, max(last) AS last, sum(n)::BIGINT AS n FROM k GROUP BY label, segment""")
def topic_segments(spark: SparkSession, d: str) -> DataFrame:
    return memory.segments(memory.boundaries(table(spark, d, "embeddings"), "label", "vec_id"), "label", "vec_id")


@query(f"""
    WITH {_MARKED},
    u AS (SELECT doc_id AS id, text AS content, (regexp_extract_all(coalesce(text, ''), '\\b[A-Z][a-z]+(?:[ \\t\\r\\n\\f]+[A-Z][a-z]+)*\\b'))[1:5] AS entities FROM documents),
    r AS (SELECT label, vec_id, sum(boundary::INT) OVER (PARTITION BY label ORDER BY vec_id) AS s FROM marked),
    g AS (SELECT label, s, count(*) AS n FROM r GROUP BY ALL),
    o AS (SELECT *, (n >= 2 OR row_number() OVER (PARTITION BY label ORDER BY s) = 1)::INT AS opens FROM g),
    k AS (SELECT *, sum(opens) OVER (PARTITION BY label ORDER BY s) - 1 AS segment FROM o),
    m AS (SELECT r.label, segment, vec_id, content, entities FROM r JOIN k ON r.label = k.label AND r.s = k.s LEFT JOIN u ON u.id = vec_id),
    x AS (SELECT label, segment, vec_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM m),
    c AS (SELECT label, segment, e, count(DISTINCT vec_id) AS n, min(vec_id * 100 + i) AS first FROM x GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY label, segment ORDER BY n DESC, first) AS rank FROM c QUALIFY rank <= 2),
    l AS (SELECT label, segment, string_agg(e, ' & ' ORDER BY rank) AS named FROM t GROUP BY ALL),
    f AS (SELECT label, segment, array_to_string(([w FOR w IN regexp_split_to_array(coalesce(arg_min(coalesce(content, ''), vec_id), ''), '[ \\t\\r\\n\\f]+') IF length(w) > 3])[1:3], ' ') AS words FROM m GROUP BY label, segment)
    SELECT f.label AS label, f.segment::BIGINT AS segment, coalesce(named, nullif(words, ''), 'topic-' || (f.segment + 1)) AS topic FROM f LEFT JOIN l ON l.label = f.label AND l.segment = f.segment""")
def topic_labels(spark: SparkSession, d: str) -> DataFrame:
    """What each segment is about: the two entities that its units name most."""
    v = table(spark, d, "embeddings")
    found = memory.segmented(memory.boundaries(v, "label", "vec_id"), "label", "vec_id")
    named = found.join(memory_units(spark, d).select(F.col("id").alias("vec_id"), "content", "entities"), "vec_id", "left")
    named = named.withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))
    return memory.segment_labels(named.withColumnRenamed("label", "of"), "of", "vec_id").select(F.col("of").alias("label"), "segment", F.col("label").alias("topic"))


@query(r"""
    WITH l AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 \t\r\n\f]', '', 'g'), '[ \t\r\n\f]+') IF length(x) >= 4] AS w FROM documents),
    t AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM l), c AS (SELECT doc_id, term, count(*) AS n, min(i) AS first FROM t GROUP BY doc_id, term)
    SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INTEGER AS rank FROM c QUALIFY rank <= 10""")
def structured_index_tf(spark: SparkSession, d: str) -> DataFrame:
    return memory.term_index(table(spark, d, "documents"))


@query(f"WITH {_GRAPH} SELECT other, label, name, type, direction FROM b JOIN v ON v.id = b.other WHERE b.id = '{START}'")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    store = Adjacency(spark, d)
    near = store.ends().filter(F.col("id") == START)
    return near.join(store.vertices().withColumnRenamed("id", "other"), "other").select("other", "label", "name", "type", "direction")


@query(f"WITH {_GRAPH}, h1 AS (SELECT '{START}' AS id, 0 AS hops UNION SELECT other, 1 FROM b WHERE id = '{START}'), h2 AS (SELECT * FROM h1 UNION SELECT b.other, 2 FROM b JOIN h1 USING (id) WHERE hops = 1) SELECT id, min(hops)::INTEGER AS hops FROM h2 GROUP BY id")
def graph_subgraph_khop(spark: SparkSession, d: str) -> DataFrame:
    """All vertices within two hops."""
    return graph.within(Adjacency(spark, d).ends(), START, 2)


@query(f"""
    WITH {_GRAPH}, h1 AS (SELECT '{START}' AS id, 0 AS hops UNION SELECT other, 1 FROM b WHERE id = '{START}'), h2 AS (SELECT * FROM h1 UNION SELECT b.other, 2 FROM b JOIN h1 USING (id) WHERE hops = 1),
    n AS (SELECT id, min(hops)::INTEGER AS hops FROM h2 GROUP BY id ORDER BY min(hops), id LIMIT 500)
    SELECT src, dst, type, x.hops AS src_hops, y.hops AS dst_hops FROM e JOIN n x ON x.id = src JOIN n y ON y.id = dst""")
def graph_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The edges between those vertices, with both ends' hops."""
    return graph.subgraph(Adjacency(spark, d).ends(), START, 2)


@query(f"WITH {_GRAPH}, h AS (SELECT '{START}' AS id UNION SELECT other FROM b WHERE id = '{START}') SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h)")
def graph_induced_edges(spark: SparkSession, d: str) -> DataFrame:
    store = Adjacency(spark, d)
    return graph.induced(store.edges(), graph.within(store.ends(), START, 1))


@query(f"WITH {_GRAPH} SELECT label, count(*) AS n FROM v GROUP BY label")
def graph_stats_labels(spark: SparkSession, d: str) -> DataFrame:
    return Adjacency(spark, d).labels()


@query(f"WITH {_GRAPH} SELECT type, count(*) AS n FROM e GROUP BY type")
def graph_stats_edge_types(spark: SparkSession, d: str) -> DataFrame:
    return Adjacency(spark, d).types()


@query(f"WITH {_GRAPH} SELECT id, sum((direction = 'out')::INT)::BIGINT AS outgoing, sum((direction = 'in')::INT)::BIGINT AS incoming FROM b GROUP BY id")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(Adjacency(spark, d).ends())


@query(f"""
    WITH {_GRAPH}, m AS (SELECT DISTINCT dst AS community, src, name FROM e JOIN v ON v.id = src WHERE type = 'LIVES_IN'),
    r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY name, src) AS r FROM m)
    SELECT community, count(*) AS members, string_agg(name, ', ' ORDER BY name) FILTER (r <= 5) AS top FROM r GROUP BY community""")
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    store = Adjacency(spark, d)
    return graph.communities(store.ends(), store.vertices(), "LIVES_IN")


@query(f"WITH {_GRAPH} SELECT count(*) AS total FROM v")
def graph_total(spark: SparkSession, d: str) -> DataFrame:
    return Adjacency(spark, d).labels().agg(F.sum("n").alias("total"))


_SMALL = f"s AS (SELECT src || '>' || dst || '>' || type AS eid, src, dst, type FROM e WHERE type IN ('IN_REGION', 'BASED_IN')), w AS (SELECT eid, src AS id, dst AS other, type FROM s UNION ALL SELECT eid, dst, src, type FROM s)"


@query(f"""
    WITH RECURSIVE {_GRAPH}, {_SMALL}, r(start, id, hops, types, used) AS (
        SELECT id, id, 0, []::VARCHAR[], []::VARCHAR[] FROM v WHERE label = 'Region' AND contains(lower(name), 'a')
        UNION ALL SELECT r.start, w.other, hops + 1, list_append(types, type), list_append(used, eid) FROM r JOIN w ON w.id = r.id WHERE hops < 2 AND NOT list_contains(used, eid))
    SELECT start, id, hops::INTEGER AS hops, array_to_string(types, ' > ') AS types FROM r WHERE hops > 0""")
def graph_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of up to two edges, none used twice, from the regions whose name holds a letter, with the types along them."""
    near = edges(spark, d).filter(F.col("type").isin("IN_REGION", "BASED_IN"))
    starts = vertices(spark, d).filter((F.col("label") == "Region") & F.lower("name").contains("a")).select("id")
    return graph.paths(near, starts, 2)


@query(f"""
    WITH {_GRAPH}, k AS (SELECT id FROM v WHERE label IN ('Nation', 'Region', 'Supplier') AND (contains(lower(name), '1') OR contains(lower(id), 'region')))
    SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def graph_filtered_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the vertices that a view's filter of labels and words leaves."""
    kept = vertices(spark, d).filter(F.col("label").isin("Nation", "Region", "Supplier") & (F.lower("name").contains("1") | F.lower("id").contains("region")))
    return graph.induced(edges(spark, d), kept.select("id"))


@query(f"""
    WITH {_GRAPH}, m AS (SELECT n_name AS member, n_regionkey AS community FROM nation UNION ALL SELECT 'Supplier:' || s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT DISTINCT id, community::INTEGER AS community FROM v JOIN m ON id = member OR name = member""")
def community_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Vertices with the community of a member list that names some by id and some by name."""
    named = table(spark, d, "nation").select(F.col("n_name").alias("member"), F.col("n_regionkey").alias("community"))
    keyed = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("Supplier:"), F.col("s_suppkey").cast("string")).alias("member"), F.col("s_nationkey").alias("community"))
    return graph.by_id_or_name(vertices(spark, d), named.union(keyed))


@query(f"""
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    c AS (SELECT doc_id AS id, {_COSINE.format(a="embedding", b="q")} AS sim, CASE WHEN doc_id % 2 = 0 THEN 0.8 END AS weight FROM q, embeddings JOIN documents ON vec_id = doc_id WHERE contains(lower(coalesce(text, '')), 'an') AND source IS NOT NULL)
    SELECT id, round((sim * 0.6 + coalesce(weight, 0.4)) * 0.3, 6) AS score FROM c ORDER BY sim * 0.6 + coalesce(weight, 0.4) DESC, id LIMIT 8""")
def graph_entity_search(spark: SparkSession, d: str) -> DataFrame:
    """The graph channel of retrieval: chunks with the words and an edge (to their source), by similarity and the edge's weight."""
    v = table(spark, d, "embeddings")
    ask = v.filter("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    chunks_ = table(spark, d, "documents").filter(F.lower(F.coalesce("text", F.lit(""))).contains("an") & F.col("source").isNotNull()).select(F.col("doc_id").alias("id"))
    near = v.withColumnRenamed("vec_id", "id").join(F.broadcast(ask)).join(chunks_, "id").select("id", F.round(cosine("embedding", "_q"), 6).alias("sim"), F.when(F.col("id") % 2 == 0, 0.8).alias("weight"))
    score = F.col("sim") * 0.6 + F.coalesce("weight", F.lit(0.4))
    return near.orderBy(score.desc(), "id").limit(8).select("id", F.round(score * 0.3, 6).alias("score"))


@query(f"""
    WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    s AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM s GROUP BY ALL),
    c AS (SELECT label, {_COSINE.format(a="list(x ORDER BY i)", b="any_value(q)")} AS sim FROM m, q GROUP BY label), t AS (SELECT label, sim FROM c WHERE sim > 0.02 ORDER BY sim DESC, label LIMIT 5),
    n AS (SELECT vec_id AS id, label, {_COSINE.format(a="embedding", b="q")} AS near FROM embeddings JOIN t USING (label), q),
    k AS (SELECT id, label, near AS sim FROM n QUALIFY row_number() OVER (PARTITION BY label ORDER BY near DESC, id) <= ceil(8.0 / (SELECT count(*) FROM t)))
    SELECT 'community-' || label AS id, label, round(sim * 0.3, 6) AS score FROM t UNION ALL SELECT id::VARCHAR, label, round(sim * 0.3, 6) FROM k""")
def community_search(spark: SparkSession, d: str) -> DataFrame:
    """Communities (labels) whose centroid is near a question, the best five, and each one's best members."""
    v = table(spark, d, "embeddings")
    ask = v.filter("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    return retrieval.community_hits(v, ask, least=0.02)


@query(f"""
    WITH {_BM25}, q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    every AS (SELECT doc_id AS id, {_COSINE.format(a="embedding", b="q")} AS score, 'vector' AS source, 0 AS ord FROM q, embeddings JOIN documents ON vec_id = doc_id
              UNION ALL SELECT doc_id, round(score / 10, 6), 'keyword', 1 FROM bm25),
    best AS (SELECT id, score, source FROM every QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) = 1)
    SELECT id, score, source, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM best QUALIFY rank <= 30""")
def set_union_merge(spark: SparkSession, d: str) -> DataFrame:
    """The best thirty of the channels' union."""
    docs, v = table(spark, d, "documents"), table(spark, d, "embeddings")
    ask = v.filter("vec_id = 0").select(F.col("embedding").alias("_q")).limit(1)
    near = v.join(F.broadcast(ask)).select(F.col("vec_id").alias("id"), F.round(cosine("embedding", "_q"), 6).alias("score"), F.lit("vector").alias("source"))
    near = near.join(docs.select(F.col("doc_id").alias("id")), "id", "left_semi")
    words = _scored(spark, d).select(F.col("doc_id").alias("id"), F.round(F.col("score") / 10, 6).alias("score"), F.lit("keyword").alias("source"))
    return retrieval.head(retrieval.best_of([near, words]), 30)


@query(rf"""
    WITH {_GRAPH}, x AS (SELECT id, label, name FROM v WHERE label IN ('Region', 'Nation')),
    i AS (SELECT 'graph' AS source, '[' || label || '] ' || name || ': No description' AS content, 0.8 AS score, 0 AS ord, id::VARCHAR AS k FROM x WHERE contains(lower(name), '1') OR contains(lower(name), 'asia')
          UNION ALL SELECT 'graph', '[' || x2.label || '] ' || x2.name || ' (IN_REGION ' || x.name || '): No description', 0.6, 1, x2.id || x.id FROM x JOIN b ON b.id = x.id AND b.type = 'IN_REGION' JOIN x x2 ON x2.id = b.other WHERE contains(lower(x.name), '1') OR contains(lower(x.name), 'asia')
          UNION ALL SELECT 'text', substr(text, 1, 300), 0.5 - 0.02 * (row_number() OVER (ORDER BY doc_id) - 1), 2, doc_id::VARCHAR FROM (SELECT doc_id, text FROM documents WHERE contains(lower(coalesce(text, '')), 'la') ORDER BY doc_id LIMIT 8)),
    u AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY substr(trim(lower(content)), 1, 200) ORDER BY ord, k) = 1)
    SELECT source, content, round(score::DOUBLE, 6) AS score, row_number() OVER (ORDER BY u.score DESC, ord, k)::INTEGER AS rank FROM u QUALIFY rank <= 8""")
def evidence_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for a question: entities its terms name, what they are related to, and texts with the words, without repeats."""
    known = vertices(spark, d).filter(F.col("label").isin("Region", "Nation"))
    related = graph.both_ways(edges(spark, d).filter(F.col("type") == "IN_REGION"))
    return retrieval.gathered(known, related, table(spark, d, "documents"), ["1", "asia"], "la")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def timeline_day(spark: SparkSession, d: str) -> DataFrame:
    return service.timeline(table(spark, d, "events"))


@query("SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def conversation_last_message(spark: SparkSession, d: str) -> DataFrame:
    return service.last_messages(table(spark, d, "conversations"))


@query("SELECT -c.conv_id - 1 AS conv_id, turn, role, text FROM conversations c JOIN (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS until FROM conversations GROUP BY conv_id) f ON f.conv_id = c.conv_id WHERE turn <= until")
def conversation_fork(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation forked at its first answer."""
    messages = table(spark, d, "conversations")
    return service.fork(messages, messages.filter("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("until")))


@query("SELECT source, count(*) AS documents, count(DISTINCT lang) AS languages, sum(length(coalesce(text, '')))::BIGINT AS chars FROM documents GROUP BY source")
def workspace_stats(spark: SparkSession, d: str) -> DataFrame:
    return service.workspace(table(spark, d, "documents"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20")
def memory_list_page(spark: SparkSession, d: str) -> DataFrame:
    return service.page(table(spark, d, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 20, 20)


@query(" UNION ALL ".join(f"SELECT event_type, '{e}' AS le, sum((value <= {e})::INT)::BIGINT AS n FROM events GROUP BY event_type" for e in BUCKETS) + " UNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY event_type")
def metrics_histogram(spark: SparkSession, d: str) -> DataFrame:
    return service.histogram(table(spark, d, "events"), BUCKETS)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return service.percentiles(table(spark, d, "events"))


@query("""
    WITH p AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1),
    r AS (SELECT day, price / lag(price) OVER (ORDER BY day) - 1 AS r FROM p QUALIFY r IS NOT NULL),
    c AS (SELECT day, r, sum(r) OVER (ORDER BY day) AS c FROM r), k AS (SELECT *, greatest(0, max(c) OVER (ORDER BY day)) AS peak FROM c)
    SELECT count(*) AS n, round(avg(r), 4) AS mean, round(stddev_pop(r), 4) AS deviation, round(avg(r) / stddev_pop(r), 4) AS sharpe, round(avg((r > 0)::INT), 4) AS win_rate, round(max(peak - c), 4) AS drawdown FROM k""")
def market_metrics(spark: SparkSession, d: str) -> DataFrame:
    return service.market_metrics(service.returns(table(spark, d, "orders")))


@query("""
    WITH s AS (SELECT event_type, list_sort(list(value) FILTER (value IS NOT NULL)) AS v, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type)
    SELECT event_type, n, mean, deviation, CASE WHEN n < 4 THEN deviation ELSE round(v[floor(n * 0.75)::INT + 1] - v[floor(n * 0.25)::INT + 1], 6) END AS iqr FROM s""")
def delphi_convergence(spark: SparkSession, d: str) -> DataFrame:
    return service.convergence(table(spark, d, "events"), "event_type", "value")


@query("SELECT source, CASE WHEN quality = 1 AND toxic = 0 THEN 'success' WHEN quality = 1 OR toxic = 0 THEN 'partial' ELSE 'failure' END AS outcome, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return service.outcomes(table(spark, d, "documents"), table(spark, d, "labels"))


@query("SELECT u.conv_id, u.turn, u.text AS instruction, a.text AS output FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")
def sft_export(spark: SparkSession, d: str) -> DataFrame:
    return service.exchanges(table(spark, d, "conversations"))


@query("""
    WITH b AS (SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id)), p AS (SELECT source, min(doc_id) AS chosen FROM b WHERE quality = 1 GROUP BY source)
    SELECT b.source, chosen, doc_id AS rejected FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source WHERE quality = 0""")
def dpo_pairs(spark: SparkSession, d: str) -> DataFrame:
    return service.preference_pairs(table(spark, d, "documents"), table(spark, d, "labels"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.roll_up(table(spark, d, "events"))
