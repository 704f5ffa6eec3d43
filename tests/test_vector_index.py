"""The vector index against exact search: recall, work, every row in a list, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from heddle.functions.vectors import nearest
from heddle.operators import vector_index
from heddle.sources.kept import part


def pairs(df):
    return {(r["query_id"], r["id"]) for r in df.collect()}


def test_recall_and_work_on_clustered_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 150)
    dice = np.random.default_rng(2)
    middles = dice.normal(size=(40, 16))
    rows = [(i, [float(x) for x in middles[i % 40] + 0.4 * dice.normal(size=16)]) for i in range(3_000)] + [(9_000 + i, [float(x) for x in middles[0]]) for i in range(400)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = str(tmp_path / "i")
    vector_index.build(v, path)
    asked = v.filter("vec_id % 50 = 0")
    want, got = pairs(nearest(asked, v, 10)), pairs(vector_index.search(spark, path, asked, 10))
    assert len(want & got) >= 0.9 * len(want)
    sizes = {r["list"]: r["n"] for r in part(spark, path, "centroids", vector_index.CENTROIDS).collect()}
    probes = part(spark, path, "settings", vector_index.SETTINGS).first()["probes"]
    assert sum(sizes.values()) == len(rows)
    assert sum(sorted(sizes.values(), reverse=True)[:probes]) < 0.5 * len(rows)
    assert pairs(vector_index.search(spark, path, asked, 10, exact=True)) == want
    assert pairs(vector_index.search(spark, path, asked, 10, probes=len(sizes))) == want


def test_recall_on_the_given_vectors(spark, tmp_path):
    """These have no clusters, so most lists must be probed; the measured number of probes still keeps the recall."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    path = str(tmp_path / "i")
    vector_index.build(v, path)
    asked = v.filter("vec_id % 50 = 0")
    want, got = pairs(nearest(asked, v, 10)), pairs(vector_index.search(spark, path, asked, 10))
    assert len(want & got) >= 0.9 * len(want)
    settings, lists = part(spark, path, "settings", vector_index.SETTINGS).first(), part(spark, path, "centroids", vector_index.CENTROIDS).count()
    assert settings["probes"] < lists


def test_few_and_odd_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, 2.0, 3.0]), (6, [-1.0, 0.5]), (None, [1.0, 1.0]), (7, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    path = str(tmp_path / "i")
    vector_index.build(v, path)
    got = vector_index.search(spark, path, v, 5, probes=1)
    assert pairs(got) == {(a, b) for a in (0, 1, 6) for b in (0, 1, 6) if a != b}
    vector_index.build(v.limit(0), str(tmp_path / "e"))
    assert vector_index.search(spark, str(tmp_path / "e"), v, 5).count() == 0


def test_a_list_is_found_by_the_files_order(spark, tmp_path):
    vector_index.build(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), str(tmp_path / "i"))
    files = spark.read.parquet(str(tmp_path / "i/rows")).withColumn("_f", F.input_file_name()).groupBy("_f").agg(F.min("list").alias("a"), F.max("list").alias("b")).orderBy("a").collect()
    assert len(files) > 2 and all(x["b"] <= y["a"] for x, y in zip(files, files[1:], strict=False))
