"""Kernel quality, filter audit and hard negatives against plain versions, with odd rows and crowded windows."""

import binascii
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.llm import filter_audit, hard_negatives, kernel_quality, queries

SMALL, BIG = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


# Hard negatives


def plain_negatives(rows, every=50, positives=5, negatives=3):
    """rows (id, label, vector); the contract, row by row."""
    once = {}
    for i, y, v in rows:
        if None in (i, y, v) or any(c is None or not math.isfinite(c) for c in v):
            continue
        own = (y, [math.floor(256 * float(c)) for c in v])
        once[i] = min(once.get(i, own), own)
    out = []
    for a, (y, v) in once.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), j, z) for j, (z, w) in once.items() if j != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            good = sorted((n, j) for n, j, z in scored if z != y and 50 * -s <= 100 * -n <= 95 * -s)
            out += [(a, p, k, j, -s, -n) for k, (n, j) in enumerate(good[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, few, **of):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id string, v string, rows string, _block int")
    return hard_negatives.mine(table, F.col("label"), F.col("id") % 50 == 0, few=few, **of)


@pytest.mark.parametrize("few", [0, 64])
def test_negatives_equal_a_plain_version(spark, few, monkeypatch):
    """Blocks of a few rows, many ties and large scores, so that windows are divided digit by digit."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 90)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    dice = random.Random(4)
    rows = [(i, dice.randint(0, 2), [float(np.float32(dice.choice([dice.gauss(0, 40), 3.0]))) for _ in range(3)], "x", None, "y", 1) for i in range(700)]
    rows += [(i, 1, [5.0, 5.0, 5.0], None, "z", "y", 2) for i in range(700, 1000)]
    got = mined(spark, rows, few)
    assert sorted(map(tuple, got.collect())) == plain_negatives([r[:3] for r in rows])


def test_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0, 2.0]), (0, None, [1.0, 1.0]), (50, 1, None), (100, 1, [1.0, None]), (150, 1, [nan, 1.0]), (200, 1, [inf, 1.0]), (250, 1, []), (251, 1, []), (252, 2, []), (300, 1, [-1.0, 0.0]), (301, 1, [1.0, 0.0])]
    fine = [(i, i % 3, [1.0 + i % 5, 2.0, 1.0]) for i in range(1000, 1110)] * 2 + [(1000, 5, [9.0, 9.0, 9.0]), (1050, 0, [0.0, 0.0, 0.0])]
    rows = [(*r, None, None, None, None) for r in odd + fine]
    got = sorted(map(tuple, mined(spark, rows, 64).collect()))
    assert got == plain_negatives([r[:3] for r in rows]) and got
    assert mined(spark, [], 64).count() == 0
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1e9] * 8, None, None, None, None)], 64)


def test_large_scores_are_multiplied_as_integers(spark):
    dice = random.Random(8)
    rows = [(i, i % 2, [float(np.float32(dice.uniform(0, 2e5))) for _ in range(2)], None, None, None, None) for i in range(120)]
    assert sorted(map(tuple, mined(spark, rows, 0).collect())) == plain_negatives([r[:3] for r in rows])


# Filter audit


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    texts = {}
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""] = min(i, texts.get(t or "", i))
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and texts[t] < i}
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((lang or "", order, step), [0] * 6)
                falls = bad[f] and not gone
                row[0] += not gone and not bad[f]
                row[1] += falls
                row[2] += bad[f] and gone
                row[3] += bad[f] and sum(bad.values()) == 1
                row[4] += falls and i in good
                row[5] += falls and i in toxic
                gone = gone or bad[f]
    sums = {}
    for (part, order, step), row in out.items():
        sums[part, order[step - 1]] = sums.get((part, order[step - 1]), 0) + row[1]
    return {k: (*row, sums[k[0], k[1][k[2] - 1]]) for k, row in out.items()}


def test_audit_of_odd_rows_equals_a_plain_version(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " ", "\t\n", "A", " b b b ", "a#", long, long, long + " ", " ".join("xy" for _ in range(300)), " ".join(f"ü{i}" for i in range(199)), " ".join(f"é{i}" for i in range(200)), "x y " * 100, "ABC " * 250]
    docs = [(None if k % 13 == 5 else k % 40, t, (None, "", "en", "de")[k % 4], "p", 3, "m") for k, t in enumerate(texts * 4)]
    labels = [(k, k % 2, (k % 3) // 2) for k in range(0, 40, 3)] + [(3, None, None), (3, 1, 1), (3, 0, 0), (None, 1, 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, part string, mask int, digest string")
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.COUNTS, "shapley")) for r in got.collect()}
    assert found == plain_audit([d[:3] for d in docs], labels)
    assert filter_audit.audit(table.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(table, none).agg(F.sum("good_lost")).first()[0] == 0


# Kernel quality


def learns(i):
    return i is not None and binascii.crc32(str(i).encode()) % 3 != 1


def calibrates(i):
    return binascii.crc32(str(i).encode()) // 3 % 4 == 0


def test_ridge_and_calibration_equal_a_plain_version(spark):
    """Statistics, normal equations, pooled shares and scores made once more, without Spark."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if r["quality"] in (0, 1) and learns(r["doc_id"])}
    fit = [i for i in labels if i in docs and not calibrates(i)]
    check = [i for i in labels if i in docs and calibrates(i)]
    x = {i: np.array(kernel_quality.statistics(t or "")) for i, t in docs.items()}
    base = np.array([x[i] for i in fit])
    fourier = kernel_quality.Fourier(base.mean(axis=0), base.std(axis=0))
    z, y = fourier(base), np.array([labels[i] for i in fit], float)
    held_back = np.diag([kernel_quality.RIDGE] * kernel_quality.FOURIER + [kernel_quality.RIDGE * 1e-6])
    w = np.linalg.lstsq(np.vstack([z, np.sqrt(held_back)]), np.concatenate([y, np.zeros(len(held_back))]), rcond=None)[0]
    raw = lambda i: float((fourier(x[i][None, :]) @ w)[0])
    # The least-squares rising curve, by the max-min formula.
    points = sorted((round(raw(i) * 10_000), labels[i]) for i in check)
    at = sorted({p for p, _ in points})
    mean = lambda a, b: np.mean([q for p, q in points if a <= p <= b])
    curve = [max(min(mean(a, b) for b in at if b >= p) for a in at if a <= p) for p in at]
    got = {r["doc_id"]: r for r in queries.op11_kernel_quality(spark, SMALL).collect()}
    assert set(got) == set(docs)
    for i in docs:
        want = np.interp(raw(i) * 10_000, at, curve)
        # A score may lie one step of the calibration aside.
        near = [np.interp(raw(i) * 10_000 + d, at, curve) for d in (-1.01, 1.01)]
        assert min(want, *near) - 1e-6 <= got[i]["score"] <= max(want, *near) + 1e-6
        assert got[i]["held_out"] == (not learns(i)) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_fourier_features_approximate_the_kernel():
    dice = np.random.default_rng(0)
    x = dice.normal(size=(40, 20))
    z = kernel_quality.Fourier(np.zeros(20), np.ones(20), size=20_000)(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2 / 20)
    assert np.abs(z @ z.T - exact).max() < 0.05


def test_pooling_equals_the_least_squares_rising_curve():
    dice = random.Random(2)
    for _ in range(200):
        counts = [(k, dice.randint(1, 5)) for k in range(dice.randint(1, 12))]
        counts = [(k, n, dice.randint(0, n)) for k, n in counts]
        mean = lambda a, b: sum(c[2] for c in counts[a : b + 1]) / sum(c[1] for c in counts[a : b + 1])  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(k, len(counts))) for a in range(k + 1)) for k in range(len(counts))]
        steps, got = kernel_quality.isotonic(counts)
        assert list(steps) == [c[0] for c in counts] and got == pytest.approx(want)


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "quality")
    rows = queries.op11_kernel_quality(spark, BIG).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    good, bad = ([r for r in rows if r["quality"] == y] for y in (1, 0))
    assert len(bad) >= 100
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert sum(r["predicted"] for r in bad) <= 0.1 * len(bad)
    above = sum((x["score"] > y["score"]) + 0.5 * (x["score"] == y["score"]) for x in good for y in bad)
    assert above >= 0.97 * len(good) * len(bad)


def test_quality_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (None, None), (4, "long text " * 30_000), (5, "퟿ é"), (6, " \n\n ")]
    docs = spark.createDataFrame([(i, t, "x", 1.0, "h") for i, t in rows], "doc_id long, text string, x string, y double, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = kernel_quality.scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1
    assert {r["score"] for r in kernel_quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert kernel_quality.scores(docs.limit(0), labels).count() == 0
    assert kernel_quality.clean(docs, labels).columns == docs.columns
