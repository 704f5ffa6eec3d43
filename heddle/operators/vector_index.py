"""Inverted lists of vectors: every row lies in the list of its nearest centroid, and a search looks into the nearest lists only.

Centroids come from a bounded sample (SAMPLE rows, LISTS centroids at most), rows are assigned in one pass, and lists are written
as ranges of (list, identifier), so a list of any size is spread over files and read in blocks. How many lists a search probes is
measured when the index is built: the fewest that find TARGET of the exact neighbours of a bounded set of sampled rows. A query
whose lists hold too few rows is answered exactly, and so is every query with exact.

Vectors are compared by cosine to six digits, ties by identifier, as in `vectors.nearest`. Rows with a null, empty or zero
vector or a null or non-finite component, or with another length than most of the sample, are in no list; identifiers are
unique whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.functions.vectors import nearest
from heddle.operators.similar import usable
from heddle.sources.kept import part

#: Rows that centroids are learned from, centroids at most, rounds, rows whose neighbours decide the probes, and share of them sought.
SAMPLE, LISTS, ROUNDS, ASKED, TARGET = 50_000, 1_024, 12, 200, 0.95
#: Rows of a block that meets the queries of its list.
BLOCK = 4_000
#: Rows of a file, about.
FILE_ROWS = 1_000_000
ROWS, CENTROIDS, SETTINGS = "list int, id long, v array<double>", "list int, n long, c array<double>", "probes int, width int"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def learned(sample: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means from rows of the sample; a bounded sample is small enough for the driver."""
    dice = np.random.default_rng(seed)
    c = sample[dice.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([np.argmax(sample[i : i + 4_096] @ c.T, axis=1) for i in range(0, len(sample), 4_096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def _probes(sample: np.ndarray, c: np.ndarray, target: float, k: int = 10) -> int:
    """The fewest lists of which the nearest hold `target` of the k nearest other rows of some sampled ones."""
    asked = sample[:: max(1, len(sample) // ASKED)][:ASKED]
    score = asked @ sample.T
    score[score > 1 - 1e-9] = -2
    best = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    home = np.concatenate([np.argmax(sample[i : i + 4_096] @ c.T, axis=1) for i in range(0, len(sample), 4_096)])
    place = np.argsort(np.argsort(-(asked @ c.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, home[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1 if len(needed) else 1


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int = LISTS, target: float = TARGET) -> None:
    """Write the index of vectors below a path."""
    rows = usable(vectors, id_col, vector_col)
    n = rows.count()
    # A hash picks the sample, so the same table gives the same index.
    share = min(1.0, SAMPLE / max(1, n))
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("id", "v").limit(2 * SAMPLE).toPandas().sort_values("id")
    width = int(taken["v"].map(len).mode().max()) if len(taken) else 0
    sample = _unit(np.array([v for v in taken["v"] if len(v) == width])) if width else np.zeros((0, 1))
    spark = vectors.sparkSession
    c = learned(sample, min(lists, max(1, int(2 * np.sqrt(len(sample)))))) if len(sample) else np.zeros((1, max(1, width)))
    shared = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                home = np.argmax(_unit(_matrix(b.column(1))) @ shared.value.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(home), b.column(0), b.column(1)], ["list", "id", "v"])

    placed = rows.filter(F.size("v") == width).mapInArrow(run, ROWS)
    placed.repartitionByRange(max(8, -(-n // FILE_ROWS)), "list", "id").sortWithinPartitions("list", "id").write.option("parquet.block.size", 4 << 20).parquet(f"{path}/rows")
    sizes = {r["list"]: r["n"] for r in part(spark, path, "rows", ROWS).groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    spark.createDataFrame([(i, sizes.get(i, 0), x) for i, x in enumerate(c.tolist())], CENTROIDS).coalesce(1).write.parquet(f"{path}/centroids")
    probes = _probes(sample, c, target) if len(sample) > 1 else 1
    spark.createDataFrame([(probes, width)], SETTINGS).coalesce(1).write.parquet(f"{path}/settings")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None, exact: bool = False, least: float = -1.0) -> DataFrame:
    """query_id, id, score, rank: the k most similar indexed rows of each query row, itself left out.

    Queries go to blocks of the lists that they probe; a block of a list meets the queries of that list only.
    """
    held = part(spark, path, "rows", ROWS)
    asked = usable(queries, id_col, vector_col)
    if exact:
        return nearest(asked, held.select("id", "v"), k, "id", "v", least)
    rows = part(spark, path, "centroids", CENTROIDS).orderBy("list").collect()  # LISTS rows at most
    settings = part(spark, path, "settings", SETTINGS).first()
    c, sizes = np.array([r["c"] for r in rows]), np.array([r["n"] for r in rows])
    most = min(len(c), probes or settings["probes"])
    shared = spark.sparkContext.broadcast((c, sizes))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sizes = shared.value
        for b in batches:
            if b.num_rows:
                order = np.argsort(-(_unit(_matrix(b.column(1))) @ c.T), axis=1, kind="stable")
                # Lists are taken until they are enough in number and hold more than k rows: the last of them may be all.
                held = np.cumsum(sizes[order], axis=1)
                need = np.maximum(most, (held <= k).sum(axis=1) + 1)
                wanted = np.arange(len(c)) < need[:, None]
                at, which = np.nonzero(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(order[at, which], pa.int32()), b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["list", "id", "v"])

    probed = asked.filter(F.size("v") == settings["width"]).mapInArrow(probe, ROWS)
    cut = {int(i): int(-(-n // BLOCK)) for i, n in enumerate(sizes) if n > BLOCK}
    blocks = F.coalesce(F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])[F.col("list")], F.lit(1)) if cut else F.lit(1)
    own = held.groupBy("list", F.pmod(F.xxhash64("id"), blocks.cast("long")).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("c"))
    # Queries of a list in blocks too: a list may be probed by all of them.
    theirs = probed.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(max(1, asked.count() // BLOCK + 1))).alias("_part")).agg(F.collect_list(F.struct("id", "v")).alias("q"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (qi, q), (ci, x) = ((r.values.field("id").to_numpy(zero_copy_only=False), _unit(_matrix(r.values.field("v")))) for r in (b.column(0)[i], b.column(1)[i]))
                score = np.round(q @ x.T, 6) + 0.0
                score[qi[:, None] == ci[None, :]] = -2
                order = np.lexsort((np.broadcast_to(ci, score.shape), -score), axis=1)[:, :k]
                at = np.repeat(np.arange(len(qi)), order.shape[1])
                best = score[at, order.ravel()]
                keep = (best >= least) & (best > -2)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at][keep]), pa.array(ci[order.ravel()][keep]), pa.array(best[keep])], ["query_id", "id", "score"])

    found = own.join(theirs, "list").select("q", "c").mapInArrow(meet, "query_id long, id long, score double")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
