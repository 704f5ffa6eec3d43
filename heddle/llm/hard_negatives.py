"""Hard negatives by distributed radix selection over integer scores.

Anchors are a stated query set; they meet all rows in blocks. An anchor's positives are its first rows of the same label.
Each (anchor, positive) opens a window of scores below the positive's. Its first negatives are not found by ordering rows:
blocks report how many rows each digit of the window's offset has, from the highest score down, the sums locate the bucket
with the k-th row, and the next round divides that bucket by the next digit. Only windows whose bucket is still crowded go on,
and at the end blocks hand over the rows at or above the located bucket alone.

A block reports no bucket beyond the one in which its own rows reach k (the table's reach it no later), and of rows of one
score only its first k by identifier, so neither a block nor a window can flood a task, whatever copies there are.

Rows with a null identifier, label or vector or with a null or non-finite component take no part. Rows that share an
identifier count once: the one with the least label, then the least vector. Ties of scores go by identifier. Vectors of
another length than the anchor's are never compared with it; empty vectors score 0. Anchors without positives or negatives
have no rows in the result, and an empty table gives none. Scores must fit in 64 bits: a table whose components could pass
that is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.llm.common import discard, stored

#: Rows of a block of the table, and of a block of anchors: a task holds two blocks and their scores.
BLOCK, ANCHORS = 8_192, 512
#: Bits of a digit: a window's histogram has 2 ** DIGIT buckets at most.
DIGIT = 8
#: Rows up to the bucket of the k-th one that are handed over without another round.
FEW = 64


def prepared(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, label, v: the rows that take part, once for each identifier, components as whole numbers floor(256 x)."""
    x = F.col(vector_col)
    # NaN orders above all numbers, so that one comparison covers it and infinity.
    fine = x.isNotNull() & label.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.filter(fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(256 * c.cast("double"))).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _blocks(rows: DataFrame, size: int, n: int, columns: list[str]) -> DataFrame:
    """rows: rows of one vector length packed into blocks of about `size` by a hash of their identifier, a partition for each."""
    count = max(1, -(-n // size))
    placed = rows.withColumns({"_width": F.size("v"), "_block": F.pmod(F.xxhash64("id"), F.lit(count))})
    return placed.repartition(count, "_width", "_block").groupBy("_width", "_block").agg(F.collect_list(F.struct(*columns)).alias("rows")).select("rows")


class _Block:
    """The rows of a block as arrays, ordered by identifier."""

    def __init__(self, rows: pa.Scalar, exact: bool):
        at = rows.values
        ids = at.field("id").to_numpy(zero_copy_only=False)
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        self.labels = at.field("label").to_numpy(zero_copy_only=False)[self.order]
        v = at.field("v").flatten().to_numpy(zero_copy_only=False)
        self.v = v.reshape(len(ids), len(v) // len(ids))[self.order].astype(np.float64 if exact else np.int64)
        self.at = at

    def windows(self) -> dict[str, np.ndarray]:
        """The anchors' windows as arrays, `of` the anchor's place in the block."""
        lists = self.at.field("windows")
        flat = lists.flatten()
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        return {"of": np.repeat(place, np.diff(lists.offsets.to_numpy()))} | {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _scores(a: _Block, c: _Block) -> np.ndarray:
    """Inner products; whole numbers below 2 ** 52 are exact as doubles, larger ones are multiplied as integers."""
    return (a.v @ c.v.T).astype(np.int64)


def _met(anchors: DataFrame, blocks: DataFrame, kernel, shape: str, exact: bool) -> DataFrame:
    """kernel's arrays for every meeting of a block of anchors with a block of rows."""
    names = [x.split()[0] for x in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, c = _Block(b.column(0)[i], exact), _Block(b.column(1)[i], exact)
                if a.v.shape[1] == c.v.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in kernel(a, c)], names)

    return anchors.select(F.col("rows").alias("a")).crossJoin(blocks.select(F.col("rows").alias("c"))).mapInArrow(run, shape)


def _nearest_alike(k: int):
    def kernel(a: _Block, c: _Block) -> list[np.ndarray]:
        score, out = _scores(a, c), []
        for i in range(len(a.ids)):
            alike = np.flatnonzero((c.labels == a.labels[i]) & (c.ids != a.ids[i]))
            s = score[i, alike]
            if len(alike) > k:
                # All rows that reach the k-th score, in the order of identifiers; the first k of them by score.
                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                alike, s = alike[keep], s[keep]
            order = np.argsort(-s, kind="stable")[:k]
            out.append((np.full(len(order), a.ids[i]), c.ids[alike[order]], s[order]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return kernel


def _inside(a: _Block, c: _Block):
    """For each rank of windows: the windows, and place and offset of the rows inside them that may still matter."""
    score, w = _scores(a, c), a.windows()
    score = np.where(a.labels[:, None] != c.labels[None, :], score, np.iinfo(np.int64).min // 2)
    for rank in np.unique(w["prank"]):
        at = np.flatnonzero(w["prank"] == rank)
        top, end, start = w["top"][at], w["end"][at], w["start"][at]
        s = score[w["of"][at]]
        i, j = np.nonzero((s <= (top - start)[:, None]) & (s >= (top - end)[:, None]))
        yield {k: v[at] for k, v in w.items()}, i, j, top[i] - s[i, j]


def _histogram(k: int, shift: int):
    """window, bucket, n: rows by digit, up to the bucket where the block's own rows reach what the window still lacks."""

    def kernel(a: _Block, c: _Block) -> list[np.ndarray]:
        out = [(np.empty(0, np.int64),) * 3]
        for w, i, _, offset in _inside(a, c):
            digit = (offset - w["start"][i]) >> shift
            code, n = np.unique(i * (1 << DIGIT) + digit, return_counts=True)
            i, digit = code >> DIGIT, code & ((1 << DIGIT) - 1)
            first = np.searchsorted(i, i)
            before = np.cumsum(n) - n
            keep = before - before[first] < k - w["have"][i]
            out.append((w["window"][i[keep]], digit[keep], n[keep]))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return kernel


def _gathered(k: int):
    """window, id, score: the block's first k rows of each window, of those above the located bucket or in it."""

    def kernel(a: _Block, c: _Block) -> list[np.ndarray]:
        out = [(np.empty(0, np.int64),) * 3]
        for w, i, j, offset in _inside(a, c):
            order = np.lexsort((j, offset, i))
            i, j, offset = i[order], j[order], offset[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, offset = i[keep], j[keep], offset[keep]
            out.append((w["window"][i], c.ids[j], w["top"][i] - offset))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    return kernel


def _opened(anchors: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """Blocks of the anchors that have windows, each with its own."""
    each = windows.groupBy("anchor").agg(F.collect_list(F.struct("window", "prank", "top", "start", "end", "have")).alias("windows"))
    return _blocks(anchors.join(each, F.col("id") == F.col("anchor")), ANCHORS, n, ["id", "label", "v", "windows"])


def _located(windows: DataFrame, counts: DataFrame, k: int, shift: int) -> DataFrame:
    """The windows after a round: start and end of the bucket that has the k-th row, rows before it, rows up to its end.

    A window with fewer than k rows keeps its end; a window without rows goes.
    """
    upto = F.sum("n").over(W.Window.partitionBy("window").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0))
    sums = counts.groupBy("window", "bucket").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    # The first bucket that reaches k; ranks are a window's buckets, 2 ** DIGIT at most.
    found = sums.join(windows, "window").withColumn("total", F.col("have") + F.col("upto"))
    reach = F.when(F.col("total") >= k, F.struct("bucket", (F.col("total") - F.col("n")).alias("before"), "total"))
    at = found.groupBy("window").agg(F.min(reach).alias("reach"), F.max("total").alias("all"))
    low = F.col("start") + F.shiftleft(F.col("reach.bucket").cast("long"), shift)
    high = F.least(F.col("end"), low + (1 << shift) - 1)
    hit = F.col("reach").isNotNull()
    return windows.join(at, "window").select(
        "window", "anchor", "positive", "positive_score", "prank", "top",
        F.when(hit, low).otherwise(F.col("start")).alias("start"), F.when(hit, high).otherwise(F.col("end")).alias("end"),
        F.when(hit, F.col("reach.before")).otherwise(F.col("have")).alias("have"), F.coalesce("reach.total", "all").alias("upto"),
    )


def mine(vectors: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, id_col: str = "vec_id", vector_col: str = "embedding", few: int = FEW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchor` picks anchors by the column id."""
    rows = stored(prepared(vectors, label, id_col, vector_col), "negatives-rows")
    size = rows.agg(F.count("*").alias("n"), F.sum(anchor.cast("long")).alias("a"), F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    largest = int(size["most"] or 0) ** 2 * max(1, size["width"] or 0)
    if largest >= 1 << 62:
        raise ValueError("scores would not fit in 64 bits")
    exact = largest < 1 << 52
    blocks = stored(_blocks(rows, BLOCK, size["n"], ["id", "label", "v"]), "negatives-blocks")
    n = size["a"] or 0
    asked = rows.filter(anchor)
    near = _met(_blocks(asked, ANCHORS, n, ["id", "label", "v"]), blocks, _nearest_alike(positives), "anchor long, positive long, positive_score long", exact)
    rank = F.row_number().over(W.Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive"))
    # Of 100 n: from half to 95 hundredths of the positive's score, as whole numbers; negative scores leave no window.
    top, low = F.expr("positive_score - (positive_score + 19) div 20"), F.expr("(positive_score + 1) div 2")
    # A window's number: places of an anchor's positives are below `positives`, so numbers are unique where identifiers are.
    found = near.withColumn("prank", rank).filter(F.col("prank") <= positives).filter("positive_score >= 0")
    windows = stored(found.select((F.monotonically_increasing_id()).alias("window"), "anchor", "positive", "positive_score", F.col("prank").cast("long").alias("prank"), top.alias("top"), F.lit(0).cast("long").alias("start"), (top - low).alias("end"), F.lit(0).cast("long").alias("have")).filter("end >= 0"), "negatives-windows")
    widest = windows.agg(F.max("end")).first()[0]
    settled, open_, made = [], windows, [windows]
    shift = max(0, int(widest or 0).bit_length() - DIGIT)
    while widest is not None:
        counts = _met(_opened(asked, open_, n), blocks, _histogram(negatives, shift), "window long, bucket long, n long", exact)
        after = stored(_located(open_, counts, negatives, shift), "negatives-round")
        made.append(after)
        crowded = F.col("upto") > few if shift else F.lit(False)
        settled.append(after.filter(~crowded))
        open_ = after.filter(crowded).drop("upto")
        # A bucket is divided by the next digit; a bucket of one score can't be.
        if not shift or open_.isEmpty():
            break
        shift = max(0, shift - DIGIT)
    last = windows.select("window", "anchor", "positive", "positive_score", "prank", "top", "start", "end").limit(0)
    for x in settled:
        last = last.unionByName(x.select(last.columns))
    # Rows before the located bucket belong to the window's first ones too.
    got = _met(_opened(asked, last.withColumn("start", F.lit(0).cast("long")).withColumn("have", F.lit(0).cast("long")), n), blocks, _gathered(negatives), "window long, negative long, negative_score long", exact)
    order = F.row_number().over(W.Window.partitionBy("window").orderBy(F.desc("negative_score"), "negative"))
    firsts = got.withColumn("rank", order).filter(F.col("rank") <= negatives)
    out = stored(firsts.join(windows.select("window", "anchor", "positive", "positive_score"), "window").select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("negative").alias("negative_id"), "positive_score", "negative_score"), "negatives-found")
    discard(rows, blocks, *made)
    return out
