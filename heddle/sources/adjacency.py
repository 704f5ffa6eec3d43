"""Adjacency store of the property graph: every edge once from each of its ends, in order of the vertex.

Files are ranges of (vertex, other end), so a hub is spread over as many files as its edges fill, and a filter on a vertex skips
all others by the files' statistics. Beside it lie the vertices in order, with labels and names, and the counts by label and by type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.sources.kept import drop, kept, part
from heddle.sources.tables import EDGES, VERTICES, edges, vertices

ENDS, VERTEX, LABELS, TYPES = "id string, other string, type string, direction string", "id string, label string, name string", "label string, n long", "type string, n long"
#: Ends in a file, about.
FILE_ROWS = 4_000_000


def build(links: DataFrame, points: DataFrame, path: str) -> None:
    """Write the store of edges (src, dst, type), each once, and vertices (id, label, name) below a path."""
    spark = links.sparkSession
    points.write.parquet(f"{path}/read")
    held = spark.read.schema(VERTEX).parquet(f"{path}/read")
    n = held.count()
    held.repartitionByRange(max(1, -(-n // FILE_ROWS)), "id").sortWithinPartitions("id").write.parquet(f"{path}/vertices")
    held.groupBy("label").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/labels")
    # Edges are written as they come, counted, and put in order from both of their ends; on the way there a number stands for type and direction.
    links.select("src", "dst", "type").write.parquet(f"{path}/unordered")
    once = spark.read.schema("src string, dst string, type string").parquet(f"{path}/unordered")
    once.groupBy("type").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/types")
    types = sorted(r["type"] for r in part(spark, path, "types", TYPES).collect())  # a row a type
    place = F.array_position(F.array(*map(F.lit, types)), F.col("type")).cast("short") if types else F.lit(0).cast("short")
    both = once.select(F.col("src").alias("id"), F.col("dst").alias("other"), place.alias("_p")).union(once.select("dst", "src", -place))
    ordered = both.repartitionByRange(max(8, -(-2 * once.count() // FILE_ROWS)), "id", "other").sortWithinPartitions("id", F.abs("_p"), "other")
    kind = F.element_at(F.array(*map(F.lit, types or [""])), F.abs("_p").cast("int"))
    named = ordered.select("id", "other", kind.alias("type"), F.when(F.col("_p") > 0, "out").otherwise("in").alias("direction"))
    named.write.option("parquet.block.size", 8 << 20).parquet(f"{path}/ends")
    for name in ("read", "unordered"):
        drop(spark, f"{path}/{name}")



class Adjacency:
    """The kept store of a folder's tables; built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        tables = sorted({t for _, t, *_ in VERTICES} | {t for _, t, *_ in EDGES})
        self.spark, self.path = spark, kept(spark, sf_dir, "adjacency", tables, lambda at: build(edges(spark, sf_dir), vertices(spark, sf_dir), at))

    def ends(self) -> DataFrame:
        """id, other, type, direction: each edge from both of its ends."""
        return part(self.spark, self.path, "ends", ENDS)

    def edges(self) -> DataFrame:
        """src, dst, type."""
        return self.ends().filter("direction = 'out'").select(F.col("id").alias("src"), F.col("other").alias("dst"), "type")

    def vertices(self) -> DataFrame:
        return part(self.spark, self.path, "vertices", VERTEX)

    def labels(self) -> DataFrame:
        return part(self.spark, self.path, "labels", LABELS)

    def types(self) -> DataFrame:
        return part(self.spark, self.path, "types", TYPES)
