"""Operators without SQL: brute-force versions and small fixtures."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heddle.operators import chunks, memory, pairs, recall, service, sinks
from heddle.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}


def cosine(x, y):
    return round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 6)


def test_greedy_merges_equal_brute_force(spark, vectors):
    gone, want = set(), set()
    for a, b in itertools.combinations(sorted(vectors), 2):
        if cosine(vectors[a], vectors[b]) >= 0.25:
            keep, remove = (a, b) if a * 37 % 100 >= b * 37 % 100 else (b, a)
            if keep not in gone and remove not in gone:
                gone.add(remove)
                want.add((keep, remove))
    assert {(r["keep"], r["remove"]) for r in catalog.QUERIES["crystallizer_merges"](spark, DATA).collect()} == want


def test_greedy_novelty_equals_brute_force(spark, vectors):
    want, taken = {}, []
    for i in sorted(vectors):
        want[i] = all(cosine(vectors[i], vectors[j]) < 0.25 for j in taken)
        taken += [i] * want[i]
    assert {r["id"]: r["accepted"] for r in catalog.QUERIES["novelty_greedy"](spark, DATA).collect()} == want


def test_pairs_of_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r["a"], r["b"], r["score"]) for r in pairs.pairs(rows, 0.5).collect()) == [(0, 1, 1.0), (0, 100, 1.0), (1, 100, 1.0)]
    assert pairs.pairs(rows.limit(0), 0.5).count() == 0


def test_clusters_and_axes_of_vectors(spark):
    found = catalog.QUERIES["trace_clusters"](spark, DATA).collect()
    assert len(found) == 500 and len({r["cluster"] for r in found}) == 5
    data = np.array([r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()], float)
    _, axes = np.linalg.eigh(np.cov(data.T))
    for axis in range(3):
        along = np.abs(data @ axes[:, -1 - axis])
        got = {r["vec_id"]: r["weight"] for r in catalog.QUERIES["skill_basis"](spark, DATA).filter(F.col("axis") == axis).collect()}
        assert got == {int(i): pytest.approx(along[i], abs=1e-5) for i in np.argsort(-along)[:5]}


def test_markdown_blocks_and_headings():
    text = "---\na: 1\n---\n# One\n\ntext\nmore\n\n## Two\n\n- x\n  - y\n\n```py\n# no\n\ncode\n```\n> q\n\n# Three\n\n***\n\nlast\n\n~~~\nopen"
    got = [(k, d, h) for _, k, d, h, _ in chunks.blocks_of(text)]
    assert got == [
        ("thematic_break", 0.0, []),
        ("heading_1", 0.0, ["One"]),
        ("paragraph", 0.0, ["One"]),
        ("heading_2", 1.0, ["One", "Two"]),
        ("list_item", 2.0, ["One", "Two"]),
        ("code_block", 1.5, ["One", "Two"]),
        ("blockquote", 2.0, ["One", "Two"]),
        ("heading_1", 0.0, ["Three"]),
        ("thematic_break", 0.0, []),
        ("paragraph", 0.0, []),
        ("code_block", 0.5, []),
    ]
    assert list(chunks.blocks_of("")) == []


def test_chunks_cover_their_text_and_end_after_sentences(spark):
    text = "A short sentence here. " * 600
    parts = list(chunks.spans(text, 1000, 100))
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (a, b), (c, _) in itertools.pairwise(parts):
        assert a < c == b - 400 and text[:b].endswith(". ") and abs(b - a - 4000) <= 102
    assert list(chunks.spans("", 10, 1)) == [] and list(chunks.spans("abc", 10, 1)) == [(0, 3)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["child"] == -1) for r in chunks.parent_child(docs).collect())
    assert got[1, True] == len(parts) and got[1, False] > len(parts) and got[3, True] == got[3, False] == 1 and 2 not in {k for k, _ in got}


def test_content_keys(spark):
    def key(text):
        h = 5381
        for c in text[:500]:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        return np.base_repr(h, 36).lower()

    texts = ["", "a", "héllo wörld", "x" * 900]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sinks.content_key(F.col("t")).alias("k")).collect()
    assert {r["t"]: r["k"] for r in rows} == {t: key(t) for t in texts}


def test_upsert_takes_the_new_row_on_ties(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, x string, v int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 0)], "id long, x string, v int")
    assert sorted(map(tuple, sinks.upserted(old, new, "id", "v").collect())) == [(1, "c", 1), (2, "b", 5), (3, "e", 0)]


def test_export_writes_json_lines_and_a_manifest(spark, tmp_path):
    sft = spark.createDataFrame([(1, "q", "a")], "id long, instruction string, output string")
    sinks.export(sft, sft.limit(0), str(tmp_path))
    assert spark.read.json(str(tmp_path / "sft.jsonl")).count() == 1
    assert spark.read.json(str(tmp_path / "manifest.jsonl")).first()["sft"] == 1


def test_values_at_ranks(spark):
    dice = np.random.default_rng(3)
    data = [("a", float(x)) for x in dice.integers(0, 50, 3000)] + [("b", float(x)) for x in dice.normal(size=777)] + [(None, 1.0), ("c", None)]
    rows = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: (r["lo"], r["hi"]) for r in service.at_ranks(rows, "k", "v", {"lo": lambda n: F.ceil(n * 0.01), "hi": lambda n: F.ceil(n * 0.9)}).collect()}
    want = {}
    for k in ("a", "b", None):
        v = sorted(x for y, x in data if y == k and x is not None)
        want[k] = (v[-(-len(v) // 100) - 1], v[int(np.ceil(len(v) * 0.9)) - 1])
    assert got == want


def test_recall_heuristics_on_odd_rows(spark):
    units = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two!"), (4, "Hello there all. This is a longer sentence. Short one here. And the longest sentence of them all.")], "id long, content string")
    got = {r["id"]: (r["sentences"], r["kept"]) for r in recall.compressed(units, 0.5, 1).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (2, 2), 4: (4, 2)}


def test_neighbours_and_totals_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(memory, "STRETCH", 3)
    data = [("a", i, i * i % 7) for i in (0, 1, 2, 5, 6, 13, 14, 20)] + [(None, 4, 1), (None, 9, 2)]
    rows = spark.createDataFrame(data, "k string, i long, x long")
    out = memory.running(memory.beside(rows, "k", "i", "x", "p", "n"), "k", "i", "x", "t")
    got = {(r["k"], r["i"]): (r["p"], r["n"], r["t"]) for r in out.collect()}
    want = {}
    for k in ("a", None):
        part = [(i, x) for y, i, x in data if y == k]
        for j, (i, _) in enumerate(part):
            want[k, i] = (part[j - 1][1] if j else None, part[j + 1][1] if j + 1 < len(part) else None, sum(x for _, x in part[: j + 1]))
    assert got == want
