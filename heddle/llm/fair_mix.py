"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that only the identifier and the seed decide; the queue is
served twice at most. A document's virtual finish time is the words of its queue up to its end, divided by the source's
target. Documents are sorted by finish time in ranges over all sources, and the running total of their words is truncated
at the budget, which is the sum of the targets. A document that ends after time 1, when a queue without pauses has met its
target, is served in packets of PACKET words that have finish times of their own: so a source ends within a packet of its
target, however long its documents are. Order and budget alone decide: no source is cut by itself.

A source of any share is totalled in buckets of its shuffled order, never in one window. Null text has no words, a null
source is a source like any other (last in order), repeated identifiers are separate entries, ties go by source and place
in the queue, texts of any length are counted whole, and documents without words are never taken. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.llm.common import ROW, WORD, bucketed_total, keyed, joined_small, stored, text_or_empty

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Times that a document may be used.
EPOCHS = 2
#: Words of a packet.
PACKET = 256
#: Documents that one window totals, about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, cap: int = EPOCHS) -> DataFrame:
    """source, source_size, target: share of all words by weight, none above cap times its source.

    Sources that reach their cap first are those with the least cap by weight, so in that order the first source whose
    cap holds more than its share of what is left gives the share by weight of all that follow.
    """
    whole = W.Window.orderBy(F.lit(1)).rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("turn", F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())))  # a row per source
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("turn") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("top", F.col("source_size") * cap).withColumn("ratio", F.col("top") / F.col("weight"))
    up = W.Window.orderBy("ratio", "turn")
    per = (
        per.withColumn("left", F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("top").over(up.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(up.rowsBetween(0, W.Window.unboundedFollowing)))
        .withColumn("fair", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "turn", "level"))).over(whole))
    )
    return per.select("source", "source_size", F.when(F.col("fair").isNull(), F.col("top").cast("double")).otherwise(F.least(F.col("top").cast("double"), F.col("fair.level") * F.col("weight"))).alias("target"))


def queue(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 0, row_col: str | None = None, **rule) -> DataFrame:
    """Every document with its place in its source's queue: doc, source, size, source_size, target, upto (words to its end).

    With row_col, also row: the rows' keys, which order rows of one identifier and size.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    dealt = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(str(seed))))
    sized = stored(docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), dealt.alias("deal"), *row), "mix-sizes")
    buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    share = F.conv(F.substring("deal", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    placed = bucketed_total(sized.withColumn("bucket", F.floor(share * buckets)), ["source"], "bucket", ["deal", F.col("doc").asc_nulls_last(), "size", *["row" for _ in row]], "size", "upto")
    goal = targets(sized, **rule).withColumnRenamed("source", "_source")
    return joined_small(placed, goal, F.col("source").eqNullSafe(F.col("_source"))).select("doc", "source", "size", "source_size", "target", "upto", *["row" for _ in row])


def mix(queued: DataFrame) -> DataFrame:
    """The mix in its order, a row for each document and epoch that is taken, or for each packet of it: doc, source, upto, epoch, size, words, finish, running.

    words is cut in the packet at the budget's end; running is the total of words up to the packet's end.
    """
    ranges = max(16, -(-queued.count() // BUCKET_ROWS))
    # A row per source; the sum is a half or whole number of words up to rounding.
    budget = queued.select("source", "target").distinct().agg(F.floor(F.sum("target") + 0.001).alias("budget"))
    entry = queued.filter("size > 0").withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS))))).withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("upto") - F.col("size"))
    over = F.col("begin") + F.col("size") <= F.col("target")
    entry = entry.withColumn("over", over).withColumn("packet", F.explode(F.when(over, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long")))))
    entry = entry.withColumn("words", F.when(F.col("over"), F.col("size")).otherwise(F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("packet"))))
    finish = F.col("finish")
    entry = entry.withColumn("finish", (F.col("begin") + F.col("packet") + F.col("words")) / F.col("target"))
    # Ranges of even width up to time 2; those of the few later entries widen, so that a source with a small target adds few ranges.
    entry = entry.withColumn("range", F.floor(F.when(finish <= 2, finish).otherwise(2 + F.log(finish / 2)) * ranges)).withColumn("all", F.lit(1))
    total = bucketed_total(entry, ["all"], "range", ["finish", F.col("source").asc_nulls_last(), "upto", "epoch", "packet"], "words", "running")
    total = total.join(F.broadcast(budget)).filter("running - words < budget").withColumn("words", F.least("words", F.col("budget") - F.col("running") + F.col("words")))
    return total.select("doc", "source", "upto", "epoch", "size", "words", "finish", "running", *[c for c in queued.columns if c == "row"])


def taken(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document: id_col, size, source_size, target, taken (words of it that the mix takes, repeats counted)."""
    queued = stored(queue(docs, id_col, **how), "mix-queue")
    got = mix(queued).groupBy(F.col("source").alias("_source"), F.col("upto").alias("_upto")).agg(F.sum("words").alias("words"))
    both = queued.join(got, F.col("source").eqNullSafe(F.col("_source")) & (F.col("upto") == F.col("_upto")) & (F.col("size") > 0), "left")
    return both.select(F.col("doc").alias(id_col), "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents of the mix, in their own columns: a row for each time one is taken, cut after the words taken where truncated.

    Each row is an entry of its own, also where its identifier is null or repeats.
    """
    rows = keyed(docs, "mix-rows")
    entries = mix(stored(queue(rows, id_col, text_col=text_col, row_col=ROW, **how), "mix-queue"))
    entries = entries.groupBy(F.col("row").alias(ROW), "epoch").agg(F.first("size").alias("_size"), F.sum("words").alias("_words")).drop("epoch")
    head = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("_words").cast("int")), "")
    cut = F.when(F.col("_words") < F.col("_size"), head).otherwise(F.col(text_col))
    return rows.join(entries, ROW).withColumn(text_col, cut).select(docs.columns)
