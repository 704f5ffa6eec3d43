"""Vector expressions, and cosine search in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Vectors of one block, and questions whose products with a block a task holds at a time.
BLOCK, SLICE = 2_000, 200


def _real(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_real(a), _real(b), lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 for vectors of other lengths, empty ones and zero vectors."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def similarity(a, b, kind: str = "cosine") -> Column:
    """Similarity by choice, higher for more alike: cosine, dotProduct, or euclidean (1 / (1 + distance)); 0 for vectors of other lengths and empty ones, cosine for an unknown choice."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    if kind == "dotProduct":
        return F.when(fits, dot(a, b)).otherwise(0.0)
    if kind == "euclidean":
        square = F.aggregate(F.zip_with(_real(a), _real(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
        return F.when(fits, 1 / (1 + F.sqrt(square))).otherwise(0.0)
    return cosine(a, b)


def blocked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """block, rows: rows of one vector length packed into blocks of about BLOCK by a hash of the identifier."""
    n = max(1, -(-vectors.count() // BLOCK))
    rows = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), _real(F.col(vector_col)).alias("v"))
    return rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.size("v").alias("width")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))


def _unit(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.values.field("id").to_numpy(zero_copy_only=False)
    flat = rows.values.field("v").flatten().to_numpy(zero_copy_only=False)
    v = np.nan_to_num(flat.astype(float)).reshape(len(ids), len(flat) // len(ids))
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return ids, np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", least: float = -1.0, weight: float = 1.0) -> DataFrame:
    """query_id, id, score, rank: the k most similar corpus rows of each query row, itself left out; ties by identifier.

    A stated query set against all rows: blocks of queries meet blocks of the corpus, each meeting keeps k rows a query,
    and these are ranked at the end, by similarities of six digits. The score is `weight` times the similarity, rounded once.
    Vectors of different lengths have similarity 0; a null component counts as 0.
    """

    def best_of(qi: np.ndarray, q: np.ndarray, ci: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        exact = q @ c.T if q.shape[1] == c.shape[1] else np.zeros((len(q), len(c)))
        score = np.round(exact, 6) + 0.0
        score[qi[:, None] == ci[None, :]] = -2
        # What is under the k-th similarity of a row cannot be among its first k; ties are ordered by identifier.
        if len(ci) > k:
            limit = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        else:
            limit = np.full((len(qi), 1), -2.0)
        rows, at = np.nonzero((score >= limit) & (score >= least) & (score > -2))
        order = np.lexsort((ci[at], -score[rows, at], rows))
        rows, at = rows[order], at[order]
        first = np.searchsorted(rows, np.arange(len(qi)))
        keep = np.arange(len(rows)) - first[rows] < k
        rows, at = rows[keep], at[keep]
        return pa.RecordBatch.from_arrays([pa.array(qi[rows], pa.int64()), pa.array(ci[at], pa.int64()), pa.array(score[rows, at]), pa.array(np.round(weight * exact[rows, at], 6) + 0.0)], ["query_id", "id", "_sim", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (qi, q), (ci, c) = _unit(b.column(0)[i]), _unit(b.column(1)[i])
                # By slices of the questions, so that a task's products stay small.
                for j in range(0, len(qi), SLICE):
                    yield best_of(qi[j : j + SLICE], q[j : j + SLICE], ci, c)

    met = blocked(queries, id_col, vector_col).select(F.col("rows").alias("q")).crossJoin(blocked(corpus, id_col, vector_col).select(F.col("rows").alias("c")))
    found = met.mapInArrow(run, "query_id long, id long, _sim double, score double")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("_sim"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("_sim")
