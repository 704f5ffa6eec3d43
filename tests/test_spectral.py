"""Spectral chunking against a plain version: own eigenvectors, one element at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import spectral
from heddle.plans import chunks as plans


def jacobi(a):
    """Eigenvalues in ascending order, and their vectors, by plane rotations."""
    n = len(a)
    a, v = [list(r) for r in a], [[float(i == j) for j in range(n)] for i in range(n)]
    for _ in range(60 * n * n):
        p, q, most = 0, 0, 1e-13
        for i in range(n):
            for j in range(i + 1, n):
                if abs(a[i][j]) > most:
                    p, q, most = i, j, abs(a[i][j])
        if p == q:
            break
        t = 0.5 * math.atan2(2 * a[p][q], a[q][q] - a[p][p])
        c, s = math.cos(t), math.sin(t)
        for k in range(n):
            x, y = a[k][p], a[k][q]
            a[k][p], a[k][q] = c * x - s * y, s * x + c * y
        for k in range(n):
            x, y = a[p][k], a[q][k]
            a[p][k], a[q][k] = c * x - s * y, s * x + c * y
        for k in range(n):
            x, y = v[k][p], v[k][q]
            v[k][p], v[k][q] = c * x - s * y, s * x + c * y
    order = sorted(range(n), key=lambda i: a[i][i])
    return [a[i][i] for i in order], [[v[k][i] for i in order] for k in range(n)]


def plain_clusters(at, vectors, places, hint, alpha):
    n = len(at)
    if n == 1:
        return [at]
    w = [[0.0] * n for _ in at]
    for i in range(n):
        for j in range(n):
            if i != j:
                dot = sum(x * y for x, y in zip(vectors[at[i]], vectors[at[j]], strict=True))
                w[i][j] = alpha * max(0, min(1, dot)) + (1 - alpha) / (1 + math.dist(places[at[i]], places[at[j]]))
    d = [sum(r) for r in w]
    m = [[float(d[i] > 0) if i == j else (-w[i][j] / math.sqrt(d[i] * d[j]) if d[i] > 0 and d[j] > 0 else 0.0) for j in range(n)] for i in range(n)]
    values, basis = jacobi(m)
    gaps = [round(values[i] - values[i - 1], 9) for i in range(1, min(n - 1, 2 * hint) + 1)]
    k = gaps.index(max(gaps)) + 1
    rows = [r[:k] for r in basis]
    rows = [[x / (math.hypot(*r) or 1) for x in r] for r in rows]
    if k >= n:
        return [[a] for a in at]
    gap = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    centres = [rows[0]]
    while len(centres) < k:
        near = [round(min(gap(r, c) for c in centres), 9) for r in rows]
        centres.append(rows[near.index(max(near))])
    label = None
    for _ in range(100):
        new = []
        for r in rows:
            far = [round(gap(r, c), 9) for c in centres]
            new.append(far.index(min(far)))
        if new == label:
            break
        label = new
        for c in range(k):
            own = [r for r, x in zip(rows, label, strict=True) if x == c]
            if own:
                centres[c] = [sum(x) / len(own) for x in zip(*own, strict=True)]
    parts = [[a for a, x in zip(at, label, strict=True) if x == c] for c in range(k)]
    return sorted(p for p in parts if p)


def plain_chunks(vectors, places, tokens, most, alpha):
    size = [math.hypot(*v) for v in vectors]
    vectors = [[x / s if s > 1e-12 else 0.0 for x in v] for v, s in zip(vectors, size, strict=True)]
    low, high = [min(p[i] for p in places) for i in (0, 1)], [max(p[i] for p in places) for i in (0, 1)]
    places = [[(p[i] - low[i]) / ((high[i] - low[i]) or 1) for i in (0, 1)] for p in places]

    def fit(at):
        if sum(tokens[i] for i in at) <= most or len(at) == 1:
            return [at]
        parts = plain_clusters(at, vectors, places, 2, alpha)
        if len(parts) < 2:
            half = math.ceil(len(at) / 2)
            parts = [at[:half], at[half:]]
        return [x for p in parts for x in fit(p)]

    first = plain_clusters(list(range(len(places))), vectors, places, max(1, math.ceil(sum(tokens) / most)), alpha)
    return [x for p in first for x in fit(p)]


@pytest.mark.parametrize("alpha", [0.0, 0.5, 1.0])
def test_chunks_equal_a_plain_version(alpha):
    dice = random.Random(9)
    for _ in range(12):
        n = dice.randint(2, 16)
        vectors = [[dice.gauss(0, 1) for _ in range(4)] for _ in range(n)]
        places = [[dice.uniform(0, 9), dice.uniform(0, 50)] for _ in range(n)]
        tokens = [dice.randint(1, 300) for _ in range(n)]
        got = spectral.chunks_of(np.array(vectors), np.array(places), np.array(tokens), 500, alpha)
        assert [list(x) for x in got] == plain_chunks(vectors, places, tokens, 500, alpha)


def test_blocks_of_documents_equal_a_plain_version(spark):
    """On the blocks of some given documents, with term vectors."""
    blocks = plans._markdown(spark, "/root/testdata/sf0.001").filter("doc_id < 60")
    sizes = blocks.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n between 2 and 18").select("doc_id")
    blocks = blocks.join(sizes, "doc_id").cache()
    got = {}
    for r in spectral.chunked(blocks).collect():
        got.setdefault((r["doc_id"], r["chunk"]), []).append(r["place"])
    held = {}
    for r in blocks.orderBy("doc_id", "place").collect():
        held.setdefault(r["doc_id"], []).append(r)
    assert len(held) >= 10
    for i, rows in held.items():
        want = plain_chunks([list(spectral.term_vector(r["text"])) for r in rows], [[r["x"], r["y"]] for r in rows], [math.ceil(len(r["text"]) / 4) for r in rows], 500, 0.5)
        assert sorted(sorted(v) for (d, _), v in got.items() if d == i) == sorted(want)


def test_chunks_are_whole_ordered_and_within_the_limit(spark):
    dice = random.Random(1)
    rows = [(d, p, dice.choice([0.0, 2.0]), float(dice.randint(0, 400)), "word " * dice.randint(0, 200)) for d, n in ((1, 700), (2, 1), (3, 40)) for p in range(n)] + [(4, 0, None, None, None), (4, 1, 1.0, 1.0, "x" * 9000)]
    elements = spark.createDataFrame(rows, "doc_id long, place int, x double, y double, text string")
    found = spectral.chunked(elements, limit=100)
    got = found.collect()
    assert sorted((r["doc_id"], r["place"]) for r in got) == sorted(r[:2] for r in rows)
    y = {r[:2]: (r[3] or 0.0, r[2] or 0.0) for r in rows}
    held = {}
    for r in sorted(got, key=lambda r: r["order"]):
        held.setdefault((r["doc_id"], r["chunk"]), []).append(r)
    for (d, chunk), members in held.items():
        assert chunk == min(r["place"] for r in members) and len({r["place"] // 100 for r in members}) == 1
        assert sum(r["tokens"] for r in members) <= spectral.TOKENS or len(members) == 1
        assert [y[d, r["place"]] for r in members] == sorted(y[d, r["place"]] for r in members)
    texts = spectral.assembled(found, elements).collect()
    assert sum(r["elements"] for r in texts) == len(rows)
    assert spectral.chunked(elements.limit(0)).count() == 0


def test_given_vectors_decide(spark):
    """Elements of two meanings, mixed up on the page, are kept apart by meaning alone."""
    rows = [(1, p, 0.0, float(p), "w " * 100, [1.0, 0.02 * p] if p % 2 else [-0.02 * p, 1.0]) for p in range(12)]
    elements = spark.createDataFrame(rows, "doc_id long, place int, x double, y double, text string, vec array<float>")
    got = spectral.chunked(elements, vector_col="vec", alpha=1.0).collect()
    assert all(r["place"] % 2 == r["chunk"] % 2 for r in got)
