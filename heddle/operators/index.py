"""Inverted term index: postings in order of term and document, so that a query reads its own terms' row groups only.

Files are ranges of (term, document): a term that is in every document is spread over as many files as its postings fill, and a
filter on terms skips all others by the files' statistics. With the postings go each term's document count and the table's
totals, so that scores read no text.

Terms are lower-case runs of letters of three characters or more. Documents without terms count in the totals only. Identifiers
must be unique; a null one cannot be found and is left out of the postings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.functions.text import terms, together
from heddle.sources.kept import drop, part

POSTINGS, TERMS, TOTALS = "term string, id long, times int, length int", "term string, documents long", "documents long, mean double"
#: Postings of a file, about, and of a row group's worth of skipping.
FILE_ROWS = 4_000_000
#: Okapi BM25 constants.
K1, B = 1.2, 0.75


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, id, times, length of each document's terms, counted where its text lies; a null term counts the document."""
    worded = together(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")), "id").select("id", terms(F.col("_text")).alias("_t"))
    each = worded.select("id", F.size("_t").alias("length"), F.explode(F.concat("_t", F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("id", "length", "term").agg(F.count("*").cast("int").alias("times")).select("term", "id", "times", "length")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the index of docs below a path."""
    spark = docs.sparkSession
    # Counts are written as they come, so that the totals and the sample for the ranges read them, not the texts.
    counted(docs, id_col, text_col).write.parquet(f"{path}/unordered")
    every = part(spark, path, "unordered", POSTINGS)
    unnamed = docs.filter(F.col(id_col).isNull()).select(F.lit(1).alias("times"), F.size(terms(F.col(text_col))).alias("length"))
    sizes = every.filter("term is null").select("times", "length").union(unnamed)
    sizes.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("documents"), (F.sum(F.col("times") * F.col("length")) / F.sum("times")).alias("mean")).write.parquet(f"{path}/totals")
    found = every.filter("term is not null")
    ranges = max(8, -(-found.count() // FILE_ROWS))
    ordered = found.repartitionByRange(ranges, "term", "id").sortWithinPartitions("term", "id")
    ordered.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    drop(spark, f"{path}/unordered")
    held = part(spark, path, "postings", POSTINGS).groupBy("term").agg(F.count("*").alias("documents"))
    held.repartitionByRange(max(1, ranges // 8), "term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """term, id, times, length of the words' postings."""
    return part(spark, path, "postings", POSTINGS).filter(F.col("term").isin(words))


def bm25(spark: SparkSession, path: str, words: list[str], id_col: str = "doc_id") -> DataFrame:
    """id_col, score of the documents with any of the words; words that are no term of their own are in no document."""
    low = [w.lower() for w in words]
    counts = {r["term"]: r["documents"] for r in part(spark, path, "terms", TERMS).filter(F.col("term").isin(low)).collect()}  # a row a word
    total = part(spark, path, "totals", TOTALS).first()
    found = postings(spark, path, low).groupBy("id").agg(F.first("length").alias("n"), *[F.sum(F.when(F.col("term") == w, F.col("times")).otherwise(0)).alias(f"f{i}") for i, w in enumerate(low)])

    def share(i: int, w: str):
        f, d = F.col(f"f{i}"), F.lit(float(counts.get(w, 0)))
        idf = F.log(1 + (F.lit(float(total["documents"])) - d + 0.5) / (d + 0.5))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(total["mean"] or 1.0)))

    return found.select(F.col("id").alias(id_col), F.round(reduce(lambda a, b: a + b, [share(i, w) for i, w in enumerate(low)]), 6).alias("score"))


def containing(spark: SparkSession, path: str, asked: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ask, id: the documents that hold each asked string (ask, head), found by its rarest whole word.

    A word with other characters on both sides inside the string is a word of every text that holds it. Strings without one
    (of one or two words) are compared with all texts.
    """
    words = F.regexp_extract_all(F.lower("head"), F.lit(r"(?<=\P{L})\p{L}{3,}(?=\P{L})"), F.lit(0))
    worded = asked.select("ask", "head", F.explode_outer(F.array_distinct(words)).alias("term"))
    rare = worded.join(part(spark, path, "terms", TERMS), "term", "left").groupBy("ask", "head").agg(F.min_by("term", F.struct(F.coalesce("documents", F.lit(0)), "term")).alias("term"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    near = rare.filter("term is not null").join(part(spark, path, "postings", POSTINGS).select("term", "id"), "term").join(texts, "id")
    every = rare.filter("term is null").join(texts, F.col("_text").contains(F.col("head")))
    return near.filter(F.col("_text").contains(F.col("head"))).select("ask", "id").union(every.select("ask", "id"))


def asked_terms(spark: SparkSession, path: str, questions: DataFrame, most: int = 3) -> DataFrame:
    """ask, term, documents: the rarest `most` terms of each question (ask, text); rare terms decide a score, and have short postings."""
    worded = questions.select("ask", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    known = worded.join(part(spark, path, "terms", TERMS), "term")
    order = F.row_number().over(W.Window.partitionBy("ask").orderBy("documents", "term"))
    return known.withColumn("_r", order).filter(F.col("_r") <= most).drop("_r")


def bm25_each(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """ask, id, score of the documents with any term of each question (ask, term, documents)."""
    total = part(spark, path, "totals", TOTALS).first()
    d, f = F.col("documents"), F.col("times")
    idf = F.log(1 + (F.lit(float(total["documents"])) - d + 0.5) / (d + 0.5))
    share = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.lit(total["mean"] or 1.0)))
    return asked.join(part(spark, path, "postings", POSTINGS), "term").groupBy("ask", "id").agg(F.round(F.sum(share), 6).alias("score"))
