"""Exact deduplication by content sort.

Normalised bytes are range-partitioned by sampled splitters and sorted outside memory, so equal texts stand next to each
other; each row is compared in full with its neighbour. The identifier is the last part of the sort key, so a group of
copies of any size is split over as many partitions as its rows need, and the pieces are joined again at the partition
borders, of which there are two a partition. The sampled splitters are whole rows of the sort key's short columns: a prefix
of the bytes, two hashes of them, and the identifier. The bytes themselves come last in the order of a partition, so long
texts never travel to the driver as splitters.

Null or missing text counts as empty; a null identifier sorts last, so it is kept only if the whole group has none.
Repeated rows are rows like any other: one of them stays. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.llm.common import BLANKS, ROW, keyed, row_id, stored, text_or_empty

#: Bytes of a text that take part in a splitter.
PREFIX = 32
#: Rows that a task gathers before it hands them on.
ROWS_OUT = 20_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the runs of equal neighbours of one sorted partition; the first and the last run also carry their bytes."""
    part, run = TaskContext.get().partitionId(), 0
    held: bytes | None = None
    ids: list = []
    kind = None
    names = ["id", "sha", "head", "lead", "local", "part", "run", "border"]
    out: dict[str, list] = {n: [] for n in names}

    def close(last: bool) -> None:
        n = len(ids)
        out["id"] += ids
        out["sha"] += [hashlib.sha256(held).hexdigest()] * n
        out["head"] += [ids[0]] * n
        out["lead"] += [True] + [False] * (n - 1)
        out["local"] += [n] * n
        out["part"] += [part] * n
        out["run"] += [run] * n
        out["border"] += [held if run == 0 or last else None] + [None] * (n - 1)

    def batch() -> pa.RecordBatch:
        types = [kind, pa.string(), kind, pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        made = pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types, strict=True)], names)
        for n in names:
            out[n] = []
        return made

    for b in batches:
        kind = b.schema.field(0).type
        for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if body == held:
                ids.append(i)
                continue
            if held is not None:
                close(False)
                run += 1
                if len(out["id"]) >= ROWS_OUT:
                    yield batch()
            held, ids = body, [i]
    if held is not None:
        close(True)
        yield batch()


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256."""
    keyed = docs.select(F.col(id_col).alias("id"), F.encode(F.regexp_replace(text_or_empty(text_col), BLANKS, " "), "UTF-8").alias("body"))
    keyed = keyed.select("*", F.substring("body", 1, PREFIX).alias("prefix"), F.xxhash64("body").alias("h1"), F.xxhash64("body", F.lit(1)).alias("h2"))
    last = F.col("id").asc_nulls_last()
    kind = keyed.schema["id"].dataType.simpleString()
    shape = f"id {kind}, sha string, head {kind}, lead boolean, local long, part int, run long, border binary"
    rows = stored(keyed.repartitionByRange("prefix", "h1", "h2", last).sortWithinPartitions("prefix", "h1", "h2", "body", last).select("id", "body").mapInArrow(_runs, shape), "content-sort")

    border = rows.filter(F.col("border").isNotNull())
    thin = border.select("part", "run", "sha", "head", "local")
    in_order = W.Window.orderBy("part", "run")  # two rows a partition
    thin = thin.withColumn("p0", F.lag("part").over(in_order)).withColumn("r0", F.lag("run").over(in_order)).withColumn("s0", F.lag("sha").over(in_order))
    body = border.select("part", "run", "border")
    equal = (
        thin.filter("sha = s0")
        .join(body, ["part", "run"])
        .join(body.select(F.col("part").alias("p0"), F.col("run").alias("r0"), F.col("border").alias("border0")), ["p0", "r0"])
        .filter("border = border0")
        .select("part", "run", F.lit(True).alias("same"))
    )
    chain = thin.join(equal, ["part", "run"], "left").withColumn("chain", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(in_order))
    whole = chain.groupBy("chain").agg(F.min(F.struct("part", "run", "head")).alias("first"), F.sum("local").alias("size"))
    mended = chain.join(whole, "chain").select("part", "run", F.col("first.head").alias("g_head"), F.col("size").alias("g_size"), ((F.col("part") == F.col("first.part")) & (F.col("run") == F.col("first.run"))).alias("g_first"))
    out = rows.drop("border").join(mended, ["part", "run"], "left")
    in_border = F.col("g_size").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(in_border, F.col("g_head")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("g_size", "local").alias("group_size"),
        (F.col("lead") & F.coalesce("g_first", F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, in the documents' own columns: that of the least identifier, nulls last."""
    rows = keyed(docs, "content-rows")
    keep = content_sort(rows.select(row_id(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").filter("kept").select(F.col("id.row").alias(ROW))
    return rows.join(keep, ROW, "left_semi").select(docs.columns)
