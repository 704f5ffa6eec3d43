"""The nearest rows by slices of questions, with many ties."""

import numpy as np

from heddle.functions.vectors import SLICE, nearest


def test_ties_and_more_questions_than_a_slice(spark):
    dice = np.random.default_rng(8)
    v = [*dice.normal(size=(SLICE + 60, 6)).round(1), *[np.ones(6)] * 30]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    x = np.array(v)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    got = {}
    for r in nearest(rows, rows, 4, least=0.2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for q in range(len(v)):
        want = sorted((-s[q, i], i) for i in range(len(v)) if i != q and s[q, i] >= 0.2)[:4]
        assert got.get(q, []) == [i for _, i in want]
