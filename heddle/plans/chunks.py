"""Queries over blocks, chunks and placed elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import chunks, spectral
from heddle.plans.registry import query
from heddle.sources.tables import table


@query()
def parent_child_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = chunks.parent_child(table(spark, d, "documents"))
    return made.select("doc_id", "parent", "child", "start", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    """Documents as markdown: their source as a heading, their lines as paragraphs."""
    text = F.concat(F.lit("# "), F.coalesce("source", F.lit("none")), F.lit("\n\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n")))
    return chunks.markdown(table(spark, d, "documents").select("doc_id", text.alias("text")))


@query()
def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).select("doc_id", "place", "kind", "x", "y", F.array_join("headings", " > ").alias("headings"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def block_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _markdown(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


_ITEMS = "i AS (SELECT user_id AS page, (event_id % 7) * 60.0::DOUBLE AS x, round(hour(ts) * 10 + (event_id % 5) * 0.7, 6)::DOUBLE AS y, event_id::VARCHAR AS text FROM events)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("page"), ((F.col("event_id") % 7) * 60.0).alias("x"), F.round(F.hour("ts") * 10 + (F.col("event_id") % 5) * 0.7, 6).alias("y"), F.col("event_id").cast("string").alias("text"))


@query(f"""
    WITH RECURSIVE {_ITEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, text) AS k FROM i),
    f AS (SELECT page, k, x, y, text, y AS first, 0 AS line FROM o WHERE k = 1
          UNION ALL SELECT o.page, o.k, o.x, o.y, o.text, CASE WHEN round(f.first - o.y, 6) > 2 THEN o.y ELSE f.first END, f.line + (round(f.first - o.y, 6) > 2)::INT FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1)
    SELECT page, line, min(x) AS x, max(y) AS y, string_agg(text, ' ' ORDER BY x, text) AS text FROM f GROUP BY page, line""")
def item_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of placed items; events stand in for the text items of pages."""
    return chunks.lines(_items(spark, d))


@query(f"WITH {_ITEMS}, p AS (SELECT page, max(y) AS height FROM i GROUP BY page) SELECT page, round(coalesce(sum(height + 50) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 6) AS top FROM p")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    return chunks.page_offsets(_items(spark, d).groupBy("page").agg(F.max("y").alias("height")))


@query(f"WITH {_ITEMS} SELECT page, text, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, text)::INTEGER AS place FROM i")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import window as W

    order = W.Window.partitionBy("page").orderBy(F.desc("y"), "x", "text")
    return _items(spark, d).select("page", "text", F.row_number().over(order).alias("place"))


@query("""
    WITH e AS (SELECT c_custkey AS id, c_nationkey AS page, c_acctbal AS x, (c_custkey * 37 % 5000)::DOUBLE AS y FROM customer)
    SELECT a.id AS a, b.id AS b, round(1 / (1 + sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS weight FROM e a JOIN e b ON a.page = b.page AND a.id < b.id WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 500""")
def spatial_near_edges(spark: SparkSession, d: str) -> DataFrame:
    """Elements of a page closer than 500 units; customers of a nation stand in for a page's elements."""
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 37 % 5000).cast("double").alias("y"))
    return chunks.near_elements(e)


@query()
def spectral_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of all documents in chunks of like placement and meaning."""
    elements = _markdown(spark, d)
    made = spectral.assembled(spectral.chunked(elements), elements)
    return made.select("doc_id", "chunk", "elements", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))
