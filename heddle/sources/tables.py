"""Readers of the canonical tables, and the views built on them: graph vertices and edges, memory units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label, table, key and name columns of the vertices.
VERTICES = (("Region", "region", "r_regionkey", "r_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Customer", "customer", "c_custkey", "c_name"), ("Supplier", "supplier", "s_suppkey", "s_name"), ("Part", "part", "p_partkey", "p_name"))
#: Type, table, source label and key, target label and key of the edges.
EDGES = (
    ("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"),
    ("LIVES_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"),
    ("BASED_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
    ("SUPPLIED_BY", "lineitem", "Part", "l_partkey", "Supplier", "l_suppkey"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(label: str, column: str):
    return F.concat(F.lit(f"{label}:"), F.col(column).cast("string"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, name."""
    return reduce(DataFrame.union, [table(spark, sf_dir, t).select(_key(label, key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name")) for label, t, key, name in VERTICES])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, type: foreign keys as typed edges, each once."""
    made = []
    for kind, t, source, source_key, target, target_key in EDGES:
        keys = table(spark, sf_dir, t).select(source_key, target_key).dropna()
        keys = keys.distinct() if t == "lineitem" else keys  # as numbers, before they are texts
        made.append(keys.select(_key(source, source_key).alias("src"), _key(target, target_key).alias("dst"), F.lit(kind).alias("type")))
    return reduce(DataFrame.union, made)


#: Kinds of memory units, by identifier.
KINDS = ("fact", "event", "summary", "relation")
#: Runs of capitalised words; word ends are those of ASCII words.
PHRASE = r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:[ \t\r\n\f]+[A-Z][a-z]+)*(?![A-Za-z0-9_])"


def phrases(text, most: int = 5):
    """The first `most` capitalised phrases of a text, each once; none for null."""
    return F.array_distinct(F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHRASE), F.lit(0)), 1, most))


def memory_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, content, kind, confidence (null for each seventh), ts, entities, source of the documents as memory units."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.alias("id"),
        F.col("text").alias("content"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.pmod(n, F.lit(4)) + 1).cast("int")).alias("kind"),
        F.when(F.pmod(n, F.lit(7)) != 0, F.pmod(n * 37, F.lit(100)) / 100).alias("confidence"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(int(doc_id div 1440), 0, int(doc_id % 1440), 0)").alias("ts"),
        phrases(F.col("text")).alias("entities"),
        "source",
    )
