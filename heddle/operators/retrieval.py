"""Retrieval: keyword scores, channel union, ranking under a token budget, evidence without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.functions.text import estimated_tokens, terms
from heddle.functions.vectors import cosine
from heddle.operators.pairs import centroids

#: Okapi BM25 constants.
K1, B = 1.2, 0.75


def contains(docs: DataFrame, words: list[str], text_col: str = "text") -> DataFrame:
    """docs in which any of the words occurs, whatever its case, with score: the share of the words found."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    hits = reduce(lambda a, b: a + b, [low.contains(w.lower()).cast("int") for w in words])
    return docs.withColumn("score", hits / len(words)).filter("score > 0")


def bm25(docs: DataFrame, words: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score of the documents with any of the words. One pass counts, one pass scores; totals are one row."""
    low = [w.lower() for w in words]

    def times(word: str) -> Column:
        return F.size(F.filter("_t", lambda x: x == word))

    counted = docs.select(id_col, terms(F.col(text_col)).alias("_t")).select(id_col, F.size("_t").alias("_n"), *[times(w).alias(f"_f{i}") for i, w in enumerate(low)])
    totals = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_mean"), *[F.sum((F.col(f"_f{i}") > 0).cast("int")).alias(f"_d{i}") for i in range(len(low))])
    rows = counted.filter(reduce(lambda a, b: a | b, [F.col(f"_f{i}") > 0 for i in range(len(low))])).join(F.broadcast(totals))

    def part(i: int) -> Column:
        f, d = F.col(f"_f{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - d + 0.5) / (d + 0.5))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_mean")))

    return rows.select(id_col, F.round(reduce(lambda a, b: a + b, [part(i) for i in range(len(low))]), 6).alias("score"))


def best_of(channels: list[DataFrame], key: str = "id") -> DataFrame:
    """Union of candidate channels (key, score, source), the best score of each key; ties go to the earlier channel."""
    every = reduce(DataFrame.unionByName, [c.select(key, "score", "source", F.lit(i).alias("ord")) for i, c in enumerate(channels)])
    return every.groupBy(key).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "source")).alias("m")).select(key, F.col("m.score").alias("score"), F.col("m.source").alias("source"))


def within_budget(ranked: DataFrame, budget: int, text_col: str = "text", key: str = "id", top: int = 100) -> DataFrame:
    """The best `top` candidates up to the first that overflows the budget, with rank and running tokens."""
    order = W.Window.orderBy(F.desc("score"), key)
    head = ranked.orderBy(F.desc("score"), key).limit(top).withColumn("tokens", estimated_tokens(F.col(text_col)))
    return head.withColumn("rank", F.row_number().over(order)).withColumn("running", F.sum("tokens").over(order.rowsBetween(W.Window.unboundedPreceding, 0))).filter(F.col("running") <= budget)


def first_by(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """One row of each key: the first in order. Rows combine before they move, so a frequent key is no burden."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key.alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """One document of those whose normalised first `width` characters agree: the smallest identifier."""
    norm = F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[ \t\r\n]+", " ")), 1, width)
    return docs.groupBy(norm.alias("_key")).agg(F.min(id_col).alias(id_col), F.count("*").alias("members")).select(id_col, "members", F.length("_key").alias("width"))


def first_of_each(channels: dict[str, DataFrame], tops: dict[str, int]) -> DataFrame:
    """ask, id, score, source: the best of each channel (ask, id, score) for each question, an item of several channels from the first of them."""

    def cut(name: str, rows: DataFrame, place: int) -> DataFrame:
        order = F.row_number().over(W.Window.partitionBy("ask").orderBy(F.desc("score"), "id"))
        return rows.withColumn("_r", order).filter(F.col("_r") <= tops[name]).select("ask", "id", "score", F.lit(name).alias("source"), F.lit(place).alias("_place"))

    every = reduce(DataFrame.unionByName, [cut(name, rows, k) for k, (name, rows) in enumerate(channels.items())])
    return every.groupBy("ask", "id").agg(F.min_by(F.struct("score", "source"), "_place").alias("_m")).select("ask", "id", "_m.score", "_m.source")


def each_within_budget(ranked: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """ranked (ask, id, score, text) of each question up to the first item that overflows its budget, with rank and running tokens; a question has few items."""
    order = W.Window.partitionBy("ask").orderBy(F.desc("score"), "id")
    placed = ranked.withColumn("tokens", estimated_tokens(F.col(text_col))).withColumns({"rank": F.row_number().over(order), "running": F.sum("tokens").over(order.rowsBetween(W.Window.unboundedPreceding, 0))})
    return placed.filter(F.col("running") <= budget)


def head(ranked: DataFrame, top: int, key: str = "id") -> DataFrame:
    """The best `top` rows by score, with their rank."""
    best = ranked.orderBy(F.desc("score"), key).limit(top)
    return best.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("score"), key)))  # at most `top` rows


def community_hits(units: DataFrame, ask: DataFrame, key: str = "label", id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.3, most: int = 5, top: int = 8, weight: float = 0.3) -> DataFrame:
    """id, key, score: the communities whose centroid is more similar than `least` to the question (one row, _q), and the best of each one's members."""
    near = centroids(units, key, vector_col).join(F.broadcast(ask)).select(key, F.round(cosine("centroid", "_q"), 6).alias("sim"))
    chosen = near.filter(F.col("sim") > least).orderBy(F.desc("sim"), key).limit(most)
    each = F.ceil(F.lit(float(top)) / F.count("*").over(W.Window.partitionBy(F.lit(1))))  # at most `most` rows
    sized = chosen.withColumn("each", each)
    inside = units.join(F.broadcast(sized.select(F.col(key).alias("_key"), "each")), F.col(key) == F.col("_key")).join(F.broadcast(ask)).select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("_id"), key, F.round(cosine(vector_col, "_q"), 6).alias("sim"), "each")
    order = W.Window.partitionBy(key).orderBy(F.desc("sim"), "_id")
    members = inside.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= F.col("each"))
    out = sized.select(F.concat(F.lit("community-"), F.col(key).cast("string")).alias("id"), key, "sim").union(members.select("id", key, "sim"))
    return out.select("id", key, F.round(F.col("sim") * weight, 6).alias("score"))


def gathered(entities: DataFrame, near: DataFrame, docs: DataFrame, terms_: list[str], words: str, most: int = 8) -> DataFrame:
    """source, content, score, rank: entities (id, label, name) whose name holds a term, those near them (id, other, type), and texts with the words.

    Items with the same first 200 characters, lower-cased and trimmed, count once.
    """
    hit = reduce(lambda a, b: a | b, [F.lower("name").contains(t) for t in terms_])
    found = entities.filter(hit)
    said = lambda label, name, more: F.concat(F.lit("["), label, F.lit("] "), name, more, F.lit(": No description"))
    one = found.select(F.lit("graph").alias("source"), said(F.col("label"), F.col("name"), F.lit("")).alias("content"), F.lit(0.8).alias("score"), F.lit(0).alias("ord"), F.col("id").alias("k"))
    other = entities.select(F.col("id").alias("other"), F.col("label").alias("_label"), F.col("name").alias("_name"))
    around = found.join(near, "id").join(other, "other")
    two = around.select(F.lit("graph"), said(F.col("_label"), F.col("_name"), F.concat(F.lit(" ("), F.col("type"), F.lit(" "), F.col("name"), F.lit(")"))), F.lit(0.6), F.lit(1), F.concat("other", "id"))
    texts = docs.filter(F.lower(F.coalesce("text", F.lit(""))).contains(words)).orderBy("doc_id").limit(most)
    place = F.row_number().over(W.Window.orderBy("doc_id")) - 1  # at most `most` rows
    three = texts.select(F.lit("text"), F.substring("text", 1, 300), 0.5 - place * 0.02, F.lit(2), F.col("doc_id").cast("string"))
    items = first_by(one.union(two).union(three), F.substring(F.trim(F.lower("content")), 1, 200), ["ord", "k"])
    best = items.orderBy(F.desc("score"), "ord", "k").limit(most)
    return best.select("source", "content", F.round("score", 6).alias("score"), F.row_number().over(W.Window.orderBy(F.desc("score"), "ord", "k")).alias("rank"))
