"""Sequential folds without gathering a key: where a running value restarts once it has grown by a reach.

Rows of a key are in order of a value that never falls (a running total, a coordinate). The first row starts a group, and each
later group starts at the first row whose value has left the group's first value by the reach. Every row's next start is found by
sorting rows and what they look for inside buckets of the value as wide as the reach; then the starts are those that are reached
from the first row, found by doubling: round i knows the first 2^i starts of every key, and jumps of as many starts. So a key
of any length is spread over tasks, and takes as many rounds as its number of starts has binary digits.

`order` must be unique within a key; a null key is a key like others. Rows without a value are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.sources.scratch import discard, stored

#: Buckets of a stretch, over which groups are numbered.
STRETCH = 1_000


def _nexts(rows: DataFrame, reach: float, strict: bool) -> DataFrame:
    """key, order, next: for each row the first one of its key whose value is `reach` or more (strict: over it) beyond its own, null if none."""
    bucket = lambda v: F.floor(v / reach).alias("bucket")
    value = F.col("value")
    asked = rows.select("key", bucket(value + reach), (value + reach).alias("value"), F.lit(None).alias("there"), "order")
    there = rows.select("key", bucket(value), "value", F.col("order").alias("there"), F.lit(None).alias("order"))
    every = there.unionByName(asked)
    # From the largest value down: the last row seen is the nearest one that follows; of rows of one value, the first in order.
    tie = F.col("there").isNull()
    line = W.Window.partitionBy("key", "bucket").orderBy(F.desc("value"), tie.desc() if strict else tie.asc(), F.desc("there")).rowsBetween(W.Window.unboundedPreceding, 0)
    near = every.withColumn("near", F.last("there", ignorenulls=True).over(line)).filter("order is not null").select("key", "bucket", "order", "near")
    firsts = every.groupBy("key", "bucket").agg(F.min(F.when(F.col("there").isNotNull(), F.struct("value", "there"))).alias("first"))
    after = W.Window.partitionBy("key").orderBy(F.desc("bucket")).rowsBetween(W.Window.unboundedPreceding, -1)
    later = firsts.select(F.col("key").alias("_key"), F.col("bucket").alias("_bucket"), F.last("first", ignorenulls=True).over(after)["there"].alias("later"))
    found = near.join(later, F.col("key").eqNullSafe(F.col("_key")) & (F.col("bucket") == F.col("_bucket")))
    return found.select("key", "order", F.coalesce("near", "later").alias("next"))


def _reached(nexts: DataFrame, heads: DataFrame) -> DataFrame:
    """key, order: the rows reached from the heads (key, order), heads included; stored."""
    jumps = stored(nexts.filter("next is not null"), "fold-jumps")
    parts = [stored(heads.select("key", "order"), "fold-starts")]
    while True:
        found = parts[0]
        for p in parts[1:]:
            found = found.union(p)
        step = jumps.select(F.col("key").alias("_key"), F.col("order").alias("_order"), "next")
        new = stored(found.join(step, F.col("key").eqNullSafe(F.col("_key")) & (F.col("order") == F.col("_order"))).select("key", F.col("next").alias("order")), "fold-starts")
        if new.isEmpty():
            out = stored(found, "fold-found")
            discard(jumps, new, *parts)
            return out
        parts.append(new)
        both = jumps.withColumnRenamed("next", "_mid").join(step, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_mid") == F.col("_order")))
        twice = stored(both.select("key", "order", "next"), "fold-jumps")
        discard(jumps)
        jumps = twice


def grouped(rows: DataFrame, key: str, order: str, value: str, reach: float, strict: bool = False) -> DataFrame:
    """rows with `group`: the number, from 0, of the group that each is in."""
    own = rows.withColumns({"_key": F.col(key), "_order": F.col(order), "_value": F.col(value).cast("double")}).filter("_value is not null")
    thin = stored(own.select(F.col("_key").alias("key"), F.col("_order").alias("order"), F.col("_value").alias("value")), "fold-rows")
    heads = thin.groupBy("key").agg(F.min(F.struct("value", "order"))["order"].alias("order"))
    starts = _reached(_nexts(thin, reach, strict), heads)
    # Groups are numbered by stretches of the value: rows within one, and what came before it from a row a stretch.
    stretch = F.floor(F.col("value") / (reach * STRETCH)).alias("stretch")
    mark = starts.select(F.col("key").alias("_key"), F.col("order").alias("_order"), F.lit(1).alias("mark"))
    marked = thin.join(mark, F.col("key").eqNullSafe(F.col("_key")) & (F.col("order") == F.col("_order")), "left").select("key", "order", "value", stretch, F.coalesce("mark", F.lit(0)).alias("mark"))
    sums = marked.groupBy("key", "stretch").agg(F.sum("mark").alias("n"))
    before = W.Window.partitionBy("key").orderBy("stretch").rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(F.col("key").alias("_key"), F.col("stretch").alias("_stretch"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inner = W.Window.partitionBy("key", "stretch").orderBy("value", "order").rowsBetween(W.Window.unboundedPreceding, 0)
    local = marked.withColumn("local", F.sum("mark").over(inner)).join(sums, F.col("key").eqNullSafe(F.col("_key")) & (F.col("stretch") == F.col("_stretch")))
    numbered = local.select(F.col("key").alias("_k"), F.col("order").alias("_o"), (F.col("local") + F.col("before") - 1).alias("group"))
    return own.join(numbered, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_order") == F.col("_o"))).drop("_key", "_order", "_value", "_k", "_o")
