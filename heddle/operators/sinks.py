"""Keyed upserts, content keys, citations, and dataset export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(existing: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """existing with the rows of new: the row with the latest stamp of each key stays, a new one on ties. Rows combine before they move."""
    every = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*existing.columns)
    return every.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(stamp, "_new")).alias("_row")).select("_row.*")


def memory_edges(units: DataFrame) -> DataFrame:
    """src, dst, type, weight of the relations (target, type, weight) of units, weight 0.5 if none is given."""
    return units.select(F.col("id").alias("src"), F.explode("relations").alias("r")).select("src", F.col("r.target").alias("dst"), "r.type", F.coalesce("r.weight", F.lit(0.5)).alias("weight"))


def content_key(text: Column, first: int = 500) -> Column:
    """A 32-bit rolling hash of a text's first UTF-16 units, in base 36: a key for chunks that have none.

    The text's first characters are encoded once; two hex pairs are a unit.
    """
    units = F.hex(F.encode(F.substring(text, 1, first), "UTF-16BE"))
    n = F.least(F.length(units) / 4, F.lit(first)).cast("int")
    codes = F.transform(F.slice(F.regexp_extract_all(units, F.lit("(....)"), F.lit(1)), F.lit(1), n), lambda x: F.conv(x, 16, 10).cast("long"))
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda t, c: (t * 33 + c).bitwiseAND(0xFFFFFFFF))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def topic_key(text: Column) -> Column:
    """16 hex digits of the lower-cased, trimmed text's SHA-256."""
    return F.substring(F.sha2(F.trim(F.lower(text)), 256), 1, 16)


def host(url: Column) -> Column:
    """The host of an address without www, or the text itself if it is none."""
    return F.when(url.rlike(r"^https?://"), F.split(F.regexp_replace(url, r"^https?://(www\.)?", ""), "/")[0]).otherwise(url)


def cited(answers: DataFrame, key: str, url: str, most: int = 6) -> DataFrame:
    """key, block: the first sources of an answer, each once and numbered. An answer has few sources."""
    urls = answers.groupBy(key, url).agg(F.min("place").alias("place")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", url))).alias("s"))
    numbered = F.transform(F.slice("s", 1, most), lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r[url]))
    return urls.select(key, F.concat(F.lit("Sources: "), F.array_join(numbered, " ")).alias("block"))


def case_folded(names: DataFrame, name: str, order: list) -> DataFrame:
    """The first row of each name whatever its case."""
    whole = F.struct(*names.columns)
    return names.groupBy(F.lower(F.col(name)).alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def manifest(sft: DataFrame, dpo: DataFrame, least: float) -> DataFrame:
    """One row on an export: how many samples of each kind, its files, and its filter."""
    counts = sft.agg(F.count("*").alias("sft")).crossJoin(dpo.agg(F.count("*").alias("dpo")))
    return counts.select("sft", "dpo", F.lit("sft.jsonl,dpo.jsonl").alias("files"), F.lit(least).alias("min_confidence"))


def export(sft: DataFrame, dpo: DataFrame, path: str, least: float = 0.6) -> None:
    """Write samples as JSON lines and their manifest under a path; a folder a kind, so no task gathers them."""
    for name, rows in (("sft", sft), ("dpo", dpo), ("manifest", manifest(sft, dpo, least))):
        rows.write.mode("overwrite").json(f"{path}/{name}.jsonl")
