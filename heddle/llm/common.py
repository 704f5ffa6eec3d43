"""Shared pieces of the training-data operators: scratch tables, word patterns, id splits, bucketed totals."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: White space and words of the contracts, as Java patterns.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one only where none is set on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Where `stored` notes its tables, innermost last.
_NOTED: list[list[DataFrame]] = []


@contextlib.contextmanager
def noted(tables: list[DataFrame]) -> Iterator[None]:
    """Tables that are stored meanwhile are added to `tables`, for whoever knows when they have been read."""
    _NOTED.append(tables)
    try:
        yield
    finally:
        _NOTED.pop()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/heddle/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for tables in _NOTED[-1:]:
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more, so a long job does not fill the shared folder; what is gone already may be named again."""
    for t in tables:
        session = t.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


#: Name of the key that `keyed` gives each row.
ROW = "_heddle_row"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """The rows, stored with a key of their own in ROW: identifiers may be null or repeat."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def row_id(id_col: str) -> Column:
    """An identifier of a keyed row that orders by id_col, nulls last, and then by row."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("doc"), F.col(ROW).alias("row"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bucketed_total(df: DataFrame, keys: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Running total of value (own row included) by keys in the order (bucket, order).

    A key may hold any share of the rows: rows are windowed by (keys, bucket) only, and each bucket starts from the sum
    of the buckets before it, which comes from one row per (keys, bucket).
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = W.Window.partitionBy(*keys).orderBy(bucket).rowsBetween(W.Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    on = F.col(bucket) == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inner = W.Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, 0)
    local = df.withColumn("_local", F.sum(value).over(inner))
    return local.join(sums, on).withColumn(out, F.col("_local") + F.col("_before")).drop("_local", "_before", "_b", *[f"_k{i}" for i in range(len(keys))])


#: Rows up to which a table of group statistics is broadcast.
BROADCAST_ROWS = 50_000


def joined_small(df: DataFrame, small: DataFrame, on: Column, how: str = "inner") -> DataFrame:
    """Join group statistics to rows: broadcast once counted and under BROADCAST_ROWS, else a shuffled join that AQE splits where skewed."""
    small = stored(small, "groups")
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)
