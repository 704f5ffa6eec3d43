"""Memory consolidation: sliding windows, topic boundaries and segments, term index, novelty, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.functions.text import together
from heddle.functions.vectors import cosine, nearest
from heddle.sources.scratch import discard, stored


def sliding_windows(rows: DataFrame, key: str, order: str, size: int = 5, overlap: int = 2) -> DataFrame:
    """key, window, first, last, n: count-based windows of each key; the ragged tail stays, a tail inside a window does not start another one.

    Rows are numbered within their key, then each row names the windows it is in: no rows are gathered.
    """
    step = max(1, size - overlap)
    at = rows.withColumn("_i", F.row_number().over(W.Window.partitionBy(key).orderBy(order)) - 1)
    low = F.greatest(F.lit(0), F.floor((F.col("_i") - size) / step).cast("int") + 1)
    placed = at.withColumn("window", F.explode(F.sequence(low, F.floor(F.col("_i") / step).cast("int"))))
    return placed.groupBy(key, "window").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


#: Consecutive order values that one window takes.
STRETCH = 100_000


def _stretched(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH))


def beside(rows: DataFrame, key: str, order: str, value: str, before: str = "_before", after: str = "_after") -> DataFrame:
    """rows with before and after: value of the row before and after in the key's order, null at its ends.

    Windows are by key and stretch of the order, so a key of any share is spread; a stretch's ends look at the stretches beside
    it, whose first and last values come from one row a stretch.
    """
    placed = _stretched(rows, key, order)
    line = W.Window.partitionBy(key).orderBy("_stretch")
    ends = placed.groupBy(key, "_stretch").agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    ends = ends.select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), F.lag("_last").over(line).alias("_low"), F.lead("_first").over(line).alias("_high"))
    inner = W.Window.partitionBy(key, "_stretch").orderBy(order)
    # A null value beside is told from an end by a mark of its own.
    local = placed.withColumns({"_l": F.lag(F.struct(value)).over(inner), "_r": F.lead(F.struct(value)).over(inner)})
    both = local.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")))
    pick = lambda near, end: F.when(F.col(near).isNull(), F.col(end)).otherwise(F.col(f"{near}.{value}"))
    return both.withColumns({before: pick("_l", "_low"), after: pick("_r", "_high")}).drop("_key", "_at", "_low", "_high", "_l", "_r", "_stretch")


def running(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """rows with out: the total of value up to the row in the key's order, by stretches as in `beside`."""
    placed = _stretched(rows, key, order)
    line = W.Window.partitionBy(key).orderBy("_stretch").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = placed.groupBy(key, "_stretch").agg(F.sum(value).alias("_sum")).select(F.col(key).alias("_key"), F.col("_stretch").alias("_at"), F.coalesce(F.sum("_sum").over(line), F.lit(0)).alias("_before"))
    inner = W.Window.partitionBy(key, "_stretch").orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    both = placed.withColumn("_local", F.sum(value).over(inner)).join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_stretch") == F.col("_at")))
    return both.withColumn(out, F.col("_local") + F.col("_before")).drop("_key", "_at", "_before", "_local", "_stretch")


def boundaries(units: DataFrame, key: str, order: str, vector_col: str = "embedding", threshold: float = 0.0) -> DataFrame:
    """key, order, similarity to the unit before, boundary.

    Interior local minima that also lie below the threshold are boundaries; a key without such minima falls back to all
    units below the threshold. The order is a number.
    """
    near = beside(units.select(key, order, vector_col), key, order, vector_col)
    # Stored, for what follows looks at it several times: narrow rows without the vectors.
    sim = stored(near.select(key, order, F.when(F.col("_before").isNotNull(), F.round(cosine(vector_col, "_before"), 6)).alias("similarity")), "topic-similarity")
    at = F.col("similarity")
    marks = beside(sim, key, order, "similarity").select(key, order, "similarity", F.coalesce(at < threshold, F.lit(False)).alias("_low"), F.coalesce((at < F.col("_before")) & (at < F.col("_after")), F.lit(False)).alias("_min"))
    marks = stored(marks, "topic-marks")
    discard(sim)
    any_ = marks.groupBy(F.col(key).alias("_key")).agg(F.max(F.col("_low") & F.col("_min")).alias("_any"))
    both = marks.join(any_, F.col(key).eqNullSafe(F.col("_key")))
    return both.select(key, order, "similarity", F.when(F.col("_any"), F.col("_low") & F.col("_min")).otherwise(F.col("_low")).alias("boundary"))


def segmented(marked: DataFrame, key: str, order: str, least: int = 2) -> DataFrame:
    """key, order, segment of the units between boundaries; segments under `least` units join the one before, the first stays."""
    marked = stored(running(marked.withColumn("_b", F.col("boundary").cast("int")), key, order, "_b", "_s").select(key, order, "_s"), "topic-runs")
    raw = stored(marked.groupBy(key, "_s").agg(F.count("*").alias("n")), "topic-segments")
    first = raw.groupBy(F.col(key).alias("_key")).agg(F.min("_s").alias("_least"))
    opens = ((F.col("_s") == F.col("_least")) | (F.col("n") >= least)).cast("int")
    numbered = running(raw.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("_open", opens).drop("_key", "_least"), key, "_s", "_open", "_number")
    numbered = numbered.select(F.col(key).alias("_key"), F.col("_s").alias("_run"), (F.col("_number") - 1).alias("segment"))
    return marked.join(numbered, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_run"))).select(key, order, "segment")


def segments(marked: DataFrame, key: str, order: str, least: int = 2) -> DataFrame:
    """key, segment, first, last, n of the segments of `segmented`."""
    return segmented(marked, key, order, least).groupBy(key, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def segment_labels(units: DataFrame, key: str, order: str, top: int = 2) -> DataFrame:
    """key, segment, label of units (key, order, segment, entities, content): the entities named most often, the earlier named of equals first.

    Without entities the first unit's first three words of over three characters, and without those the segment's number.
    """
    named = units.select(key, "segment", order, F.posexplode("entities").alias("_place", "_entity"))
    counts = named.groupBy(key, "segment", "_entity").agg(F.count("*").alias("_n"), F.min(F.struct(order, "_place")).alias("_first"))
    rank = F.row_number().over(W.Window.partitionBy(key, "segment").orderBy(F.desc("_n"), "_first"))
    best = counts.withColumn("_rank", rank).filter(F.col("_rank") <= top).groupBy(key, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_entity"))), lambda r: r["_entity"]), " & ").alias("_named"))
    best = best.select(F.col(key).alias("_key"), F.col("segment").alias("_segment"), "_named")
    words = F.slice(F.filter(F.split(F.coalesce("content", F.lit("")), r"[ \t\r\n\f]+"), lambda w: F.length(w) > 3), 1, 3)
    first = units.withColumn("_words", F.array_join(words, " ")).groupBy(key, "segment").agg(F.min_by("_words", order).alias("_words"))
    both = first.join(best, F.col(key).eqNullSafe(F.col("_key")) & (F.col("segment") == F.col("_segment")), "left")
    number = F.concat(F.lit("topic-"), (F.col("segment") + 1).cast("string"))
    return both.select(key, "segment", F.coalesce("_named", F.when(F.col("_words") != "", F.col("_words")), number).alias("label"))


def term_index(docs: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", least: int = 4) -> DataFrame:
    """id_col, term, n, rank: the most frequent words (a-z, 0-9) of each document of `least` characters or more, ties in order of their first place."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text_col, F.lit(""))), r"[^a-z0-9 \t\r\n\f]", ""), r"[ \t\r\n\f]+")
    placed = together(docs.select(id_col, text_col), id_col).select(id_col, F.posexplode(words).alias("place", "term")).filter(F.length("term") >= least)
    counts = placed.groupBy(id_col, "term").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(W.Window.partitionBy(id_col).orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top).drop("first")


def novelty(new: DataFrame, known: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, score, novel: the most similar known unit's score, and whether it stays under the threshold."""
    near = nearest(new, known, 1, id_col, vector_col).select("query_id", "score")
    every = new.select(F.col(id_col).cast("long").alias("_id"))
    return every.join(near, every["_id"] == near["query_id"], "left").select(F.col("_id").alias("query_id"), "score", (F.coalesce("score", F.lit(-1.0)) < threshold).alias("novel"))
