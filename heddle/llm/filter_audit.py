"""Filter interaction audit: every order of five filters replayed over the documents' flags.

Each document carries one flag per filter (its failure). The flags meet the 120 orders of the filters, a broadcast table of
fixed size, and each meeting opens into five steps. The first failing step of an order removes the document: before it the
document is kept, at it removed, after it a failure is redundant. Sums per part, order and step are combined on the map
side, so the shuffle carries at most (parts x 600) rows from each task, however many rows one part holds.

Null text is empty: it fails A (and E where an empty text has a smaller identifier). Texts are identical when their length
and SHA-256 are. A null identifier is never smaller than another, so a row without one does not fail E and gives no other
row away; rows that share an identifier do not fail E by each other. Rows that repeat count as documents of their own, very
long texts as a whole. Labels that repeat count once: a document is good or toxic if any of its labels says so. A null
language is the part ''. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.llm.common import BLANKS, discard, stored, text_or_empty

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: A: words at least; B: distinct words, percent of words at least; C: capitals, percent of code points at most.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: D: a text with one of these fails.
SYMBOLS = r"[#$%&*|]"
#: Documents that one task replays, about.
TASK_ROWS = 200_000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_flags(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.split(text, BLANKS)
    # Blanks at either end leave one empty word there; an empty text is one empty word.
    first, last = (words[0] == "").cast("int"), ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("int")
    n = F.size(words) - first - last
    distinct = F.size(F.array_distinct(words)) - F.greatest(first, last)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS))
    return sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, mask (bits of A to D), digest, size: one pass over the texts, after which only these move."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_flags(text).alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).alias("size"))


def flags(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask (a bit for each filter that the document fails), good, toxic: a row for each of the described documents."""
    # Copies are counted with map-side combining; only texts that occur more than once go on to the join.
    first = rows.groupBy("digest", "size").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("digest", "size", "least")
    rows_ = rows.join(first, ["digest", "size"], "left").select("id", "part", (F.col("mask") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)).alias("mask"))
    said = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    return rows_.join(said, "id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def orders(spark) -> DataFrame:
    """number, filter_order, bits: the filters' bits in the order they are applied in."""
    made = [(k, "".join(x), [1 << FILTERS.index(f) for f in x]) for k, x in enumerate(itertools.permutations(FILTERS))]
    return spark.createDataFrame(made, "number int, filter_order string, bits array<int>")


def replay(flagged: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step, from rows (part, mask, good, toxic)."""
    every = orders(flagged.sparkSession)
    # The first failing step is that of the least position whose bit is in the mask; 6 where none fails.
    first = F.coalesce(*[F.when(F.col("mask").bitwiseAND(F.col("bits")[i]) != 0, i + 1) for i in range(5)], F.lit(6))
    met = flagged.crossJoin(F.broadcast(every.select("number", "bits"))).select("part", "number", "mask", "good", "toxic", first.alias("first"), F.posexplode("bits").alias("at", "bit"))
    step, fails = F.col("at") + 1, F.col("mask").bitwiseAND(F.col("bit")) != 0
    removed = step == F.col("first")
    each = {
        "kept": step < F.col("first"),
        "removed": removed,
        "redundant": fails & (step > F.col("first")),
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": removed & (F.col("good") == 1),
        "toxic_lost": removed & (F.col("toxic") == 1),
    }
    sums = met.groupBy("part", "number", step.alias("step"), "bit").agg(*[F.sum(each[c].cast("long")).alias(c) for c in COUNTS])
    shapley = F.sum("removed").over(W.Window.partitionBy("part", "bit")).alias("shapley")
    return sums.join(F.broadcast(every), "number").select("part", "filter_order", "step", *COUNTS, shapley)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    rows = stored(described(docs, id_col, text_col, part_col), "audit-flags")
    # A narrow row becomes 600: rows are dealt out by their number, not by their bytes.
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    out = stored(replay(flags(rows, labels, id_col).repartition(tasks)), "audit-counts")
    discard(rows)
    return out
