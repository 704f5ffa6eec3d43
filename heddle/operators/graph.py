"""Property-graph queries over vertices (id, label, name) and edges (src, dst, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.sources.scratch import stored

#: Identifiers up to which a set goes to the edges; more are joined by moving both.
FEW = 500_000


def both_ways(edges: DataFrame) -> DataFrame:
    """id, other, type, direction: each edge from both of its ends."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "type", F.lit("out").alias("direction"))
    return out.union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "type", F.lit("in").alias("direction")))


def paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """start, id, hops, types: every path of up to so many undirected edges, none of which it uses twice, from starts (id)."""
    eid = edges.withColumn("_e", F.concat_ws(">", "src", "dst", "type"))
    step = eid.select(F.col("src").alias("_at"), F.col("dst").alias("_to"), "type", "_e").union(eid.select("dst", "src", "type", "_e"))
    none = F.array().cast("array<string>")
    at = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops"), none.alias("_types"), none.alias("_used"))
    found = []
    for k in range(1, hops + 1):
        at = at.join(step, F.col("id") == F.col("_at")).filter(~F.array_contains("_used", F.col("_e")))
        at = at.select("start", F.col("_to").alias("id"), F.lit(k).alias("hops"), F.array_append("_types", F.col("type")).alias("_types"), F.array_append("_used", F.col("_e")).alias("_used"))
        found.append(at)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select("start", "id", "hops", F.array_join("_types", " > ").alias("types"))


def by_id_or_name(vertices: DataFrame, members: DataFrame) -> DataFrame:
    """id, community of the vertices that members (member, community) name by id or by name: two equi-joins, not one with OR."""
    by = lambda c: vertices.join(members, F.col(c) == F.col("member")).select("id", "community")
    return by("id").union(by("name")).distinct()


def _few(ids: DataFrame) -> DataFrame:
    """A stored set of identifiers, sent to where the edges lie if it is small."""
    return F.broadcast(ids) if ids.count() <= FEW else ids


def within(ends: DataFrame, start: str, hops: int, most: int | None = None) -> DataFrame:
    """id, hops: vertices within so many hops over ends (id, other), with the least number of hops; with most, the first so many by hops and id.

    The first hop is a filter by the start's key. Later ones start from the newly found vertices only, which are stored, so no
    round repeats the ones before it.
    """
    step = ends.select("id", F.col("other").alias("_to"))
    seen = ends.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("hops"))
    front = None
    for k in range(1, hops + 1):
        near = step.filter(F.col("id") == start) if front is None else step.join(_few(front.select("id")), "id", "left_semi")
        found = near.select(F.col("_to").alias("id")).distinct()
        found = found.filter(F.col("id") != start) if front is None else found.join(seen.select("id"), "id", "left_anti")
        front = found.withColumn("hops", F.lit(k))
        front = stored(front, "graph-front") if k < hops else front
        seen = seen.union(front)
    return seen if most is None else seen.orderBy("hops", "id").limit(most)


def subgraph(ends: DataFrame, start: str, hops: int, most: int = 500) -> DataFrame:
    """src, dst, type, src_hops, dst_hops: the edges between the first `most` vertices within so many hops."""
    near = stored(within(ends, start, hops, most), "graph-near")
    edges = ends.filter("direction = 'out'").select(F.col("id").alias("src"), F.col("other").alias("dst"), "type")
    for end in ("src", "dst"):
        edges = edges.join(_few(near.select(F.col("id").alias(end), F.col("hops").alias(f"{end}_hops"))), end)
    return edges.select("src", "dst", "type", "src_hops", "dst_hops")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in ids (id)."""
    ids = _few(stored(ids.select("id"), "graph-ids"))
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def degrees(ends: DataFrame) -> DataFrame:
    """id, outgoing, incoming over ends (id, direction)."""
    way = lambda d: F.sum((F.col("direction") == d).cast("long"))
    return ends.groupBy("id").agg(way("out").alias("outgoing"), way("in").alias("incoming"))


def communities(ends: DataFrame, vertices: DataFrame, kind: str, names: int = 5) -> DataFrame:
    """community, members, top: members of each target of `kind` edges, and the first names in order; over ends (id, other, type, direction) and vertices (id, name)."""
    members = ends.filter((F.col("type") == kind) & (F.col("direction") == "in")).select(F.col("id").alias("community"), F.col("other").alias("src"))
    members = members.join(vertices.select(F.col("id").alias("src"), "name"), "src").select("community", "src", "name")
    counts = members.groupBy("community").agg(F.count("*").alias("members"))
    order = W.Window.partitionBy("community").orderBy("name", "src")
    top = members.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= names).groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("top"))
    return counts.join(top, "community")
