"""Training samples with their filter, order and formats; measures by name, over many tasks and from SQL."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.functions.measures import BUILT_IN, Gathered, Measures, Summed
from heddle.functions.vectors import similarity
from heddle.operators import datasets
from heddle.operators.spectral import term_vector

SAMPLE = "id long, kind string, instruction string, input string, output string, source string, confidence double"


def samples(spark):
    rows = [
        (1, "positive", "do", "alpha beta gamma", "one", "s", 0.9),
        (2, "positive", "do", "gamma beta alpha", "same words", "s", 0.9),
        (3, "negative", "do", "delta epsilon zeta", "bad", "s", 0.7),
        (4, "negative", "do", "eta theta", "alone", "t", 0.6),
        (5, "positive", "do", "iota kappa", "unsure", "u", 0.59),
        (6, "positive", "do", None, "no input", "u", 1.0),
        (0, "negative", "do", "lambda mu nu xi", "first", "s", 0.8),
    ]
    return spark.createDataFrame(rows, SAMPLE)


def test_formats_and_manifest(spark, tmp_path):
    datasets.write(samples(spark), str(tmp_path))
    read = lambda name: [json.loads(x) for p in sorted(Path(tmp_path / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(r["output"] for r in read("sft.jsonl")) == ["no input", "one"]
    assert sorted((r["chosen"], r["rejected"], r["prompt"]) for r in read("dpo.jsonl")) == [("one", "bad", "do\ndelta epsilon zeta"), ("one", "first", "do\nlambda mu nu xi")]
    (facts,) = read("manifest.json")
    assert facts["sft"] == 2 and facts["dpo"] == 2 and facts["min_confidence"] == 0.6 and facts["deduplication_threshold"] == 0.92
    assert facts["sources"] == {"s": 3, "t": 1, "u": 1}


def test_repeats_go_in_order(spark):
    rows = [(i, "positive", "x y", " ".join(f"w{(i * k) % 5}" for k in range(1, 5)), "o", "s", 1.0) for i in range(60)]
    got = {r["id"] for r in datasets.distinct(spark.createDataFrame(rows, SAMPLE)).collect()}
    kept = []
    for i, *_, text in [(r[0], f"{r[2]} {r[3]}") for r in rows]:
        v = term_vector(text)
        if not any(round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6) >= 0.92 for _, w in kept):
            kept.append((i, v))
    assert got == {i for i, _ in kept}


def test_sources(spark):
    states = spark.createDataFrame([(1, '{"insight": "a", "context": "b", "utility": 0.65}'), (2, '{"insight": "a", "context": "b"}'), (3, "broken"), (4, '{"insight": "", "context": "b"}'), (5, None)], "key long, data string")
    got = {r["id"] & ((1 << datasets.KEY_BITS) - 1): r["confidence"] for r in datasets.experiences(states).collect()}
    assert got == {1: 0.65, 2: 0.7}
    teams = spark.createDataFrame([(1, "a", "d", 0.8), (2, "a", "d", 0.7)], "key long, attack string, defense string, resilience double")
    assert sorted((r["kind"], r["output"], round(r["confidence"], 6)) for r in datasets.red_teams(teams).collect()) == [("negative", "a", 0.2), ("positive", "d", 0.8)]
    decided = spark.createDataFrame([(k, "c", o, "r") for k, o in enumerate(("success", "partial", "failure"))], "key long, content string, outcome string, reflection string")
    assert [(r["kind"], r["confidence"]) for r in datasets.collected([datasets.decisions(decided)]).orderBy("id").collect()] == [("positive", 0.9), ("positive", 0.7)]


@pytest.mark.parametrize("name", ["std_dev", "entropy", "interquartile_range", "unknown"])
def test_measures_over_many_tasks(spark, name):
    rows = spark.range(0, 4_000, 1, 16).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"), F.when(F.col("id") % 11 != 0, F.pmod(F.col("id") * 37, F.lit(101)) / 100).alias("v"))
    rows = rows.union(spark.createDataFrame([("none", None), ("none", None)], "k string, v double"))
    held = {}
    for r in rows.collect():
        held.setdefault(r["k"], []).extend([] if r["v"] is None else [r["v"]])
    want = {k: BUILT_IN.get(name, BUILT_IN["std_dev"]).of(np.array(v)) for k, v in held.items()}
    got = {r["k"]: r["measure"] for r in Measures(spark).apply(rows, "k", "v", name).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert got["none"] == 1.0
    assert Measures(spark).apply(rows.limit(0), "k", "v", name).count() == 0


def test_own_measures_in_sql(spark):
    m = Measures(spark)
    m.register("spread_of", Gathered(lambda v: v.max() - v.min()))
    m.register("mean_of", Summed(lambda v: np.array([len(v), v.sum()]), lambda t: t[1] / t[0]))
    spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None)], "k string, v double").createOrReplaceTempView("measured")
    got = {r["k"]: (r["s"], r["m"]) for r in spark.sql("SELECT k, spread_of(v) AS s, mean_of(v) AS m FROM measured GROUP BY k").collect()}
    assert got == {"a": (3.0, 2.5), "b": (1.0, 1.0)}


def test_similarities_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [3.0, 4.0])], "x array<double>, y array<double>")
    got = [tuple(round(v, 6) for v in r) for r in rows.select(*[similarity("x", "y", k) for k in ("cosine", "euclidean", "dotProduct", "other")]).collect()]
    assert got == [(1.0, 1.0, 5.0, 1.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0), (0.0, 0.166667, 0.0, 0.0)]
