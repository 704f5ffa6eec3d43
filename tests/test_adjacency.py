"""The adjacency store: what it holds, what a lookup reads of it, neighbourhoods with a limit."""

from pyspark.sql import functions as F

from heddle.operators import graph
from heddle.plans import catalog
from heddle.sources import adjacency
from heddle.sources.adjacency import ENDS
from heddle.sources.kept import part

LINKS = [("a", "b", "X"), ("a", "b", "Y"), ("b", "c", "X"), ("c", "d", "X"), ("e", "a", "X"), ("f", "f", "X"), ("d", "zz", "X")]
POINTS = [(x, "L" if x in "abc" else "M", f"name {x}") for x in "abcdef"]


def store(spark, path):
    adjacency.build(spark.createDataFrame(LINKS, "src string, dst string, type string"), spark.createDataFrame(POINTS, "id string, label string, name string"), str(path))
    return part(spark, str(path), "ends", ENDS)


def test_ends_are_kept_from_both_sides(spark, tmp_path):
    got = sorted(tuple(r)[:4] for r in store(spark, tmp_path / "g").collect())
    assert got == sorted([(a, b, t, "out") for a, b, t in LINKS] + [(b, a, t, "in") for a, b, t in LINKS])
    counts = {r["type"]: r["n"] for r in part(spark, str(tmp_path / "g"), "types", adjacency.TYPES).collect()}
    assert counts == {"X": 6, "Y": 1}
    assert {r["label"]: r["n"] for r in part(spark, str(tmp_path / "g"), "labels", adjacency.LABELS).collect()} == {"L": 3, "M": 3}


def test_a_vertex_is_found_by_the_files_order(spark, tmp_path):
    ends = store(spark, tmp_path / "g").filter(F.col("id") == "b")
    assert "EqualTo(id,b)" in ends._jdf.queryExecution().executedPlan().toString()
    files = spark.read.parquet(str(tmp_path / "g/ends")).withColumn("_f", F.input_file_name()).groupBy("_f").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()
    assert len(files) > 2 and all(x["b"] <= y["a"] for x, y in zip(files, files[1:], strict=False))


def test_neighbourhoods_by_hops(spark, tmp_path):
    ends = store(spark, tmp_path / "g")
    hops = lambda k, most=None: {r["id"]: r["hops"] for r in graph.within(ends, "a", k, most).collect()}
    assert hops(1) == {"a": 0, "b": 1, "e": 1}
    assert hops(3) == {"a": 0, "b": 1, "e": 1, "c": 2, "d": 3}
    assert hops(3, 3) == {"a": 0, "b": 1, "e": 1}
    got = {tuple(r) for r in graph.subgraph(ends, "a", 2, 4).collect()}
    assert got == {("a", "b", "X", 0, 1), ("a", "b", "Y", 0, 1), ("b", "c", "X", 1, 2), ("e", "a", "X", 1, 0)}


def test_no_nested_loops_over_the_edges(spark, tmp_path):
    ends = store(spark, tmp_path / "g")
    plan = graph.within(ends, "a", 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_all_vertices_within_two_hops(spark, tmp_path):
    """A nation of 700 customers has no limit on what is within two hops of it."""
    shapes = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(7, "N", 0), (8, "M", 0)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(k, f"c{k}", 7) for k in range(700)] + [(900, "far", 8)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "s", 7), (2, "t", 8)]),
        "part": ("p_partkey long, p_name string", [(1, "p"), (2, "q")]),
        "lineitem": ("l_partkey long, l_suppkey long", [(1, 1), (2, 2), (1, 1)]),
    }
    for name, (shape, rows) in shapes.items():
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {r["id"]: r["hops"] for r in catalog.QUERIES["graph_subgraph_khop"](spark, str(tmp_path)).collect()}
    want = {"Nation:7": 0, "Region:0": 1, "Supplier:1": 1, "Nation:8": 2, "Part:1": 2} | {f"Customer:{k}": 1 for k in range(700)}
    assert got == want


def test_edges_stay_where_they_lie(spark, tmp_path):
    """The store has no names to move, and a small set of vertices goes to the edges, whatever Spark estimates."""
    ends = store(spark, tmp_path / "g")
    assert ends.columns == ["id", "other", "type", "direction"]
    edges = ends.filter("direction = 'out'").select(F.col("id").alias("src"), F.col("other").alias("dst"), "type")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (graph.induced(edges, graph.within(ends, "a", 1)), graph.subgraph(ends, "a", 2, 4)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2
        got = {tuple(r) for r in graph.induced(edges, graph.within(ends, "a", 1)).select("src", "dst", "type").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {("a", "b", "X"), ("a", "b", "Y"), ("e", "a", "X")}
