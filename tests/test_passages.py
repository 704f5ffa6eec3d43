"""Documents that hold given strings, against a plain search, and without a join of texts."""

import numpy as np
import pytest

from heddle.operators import index, passages
from heddle.plans import catalog


def planted():
    """Texts with shared, overlapping, non-ASCII and repeated strings; some begin alike for 30 bytes and differ later."""
    dice = np.random.default_rng(4)
    word = lambda: "".join(dice.choice(list("abé"), 4))
    texts = {i: " ".join(word() for _ in range(12)) for i in range(60)}
    shared = ["a" * 30, "é" * 30, "é" * 29 + "ö", "-" * 40, "日本語の文章" * 5, "日本語の文章" * 4 + "日本語の別件"]
    for i in range(60, 120):
        texts[i] = texts[i - 60][: i % 40] + shared[i % 6] + texts[i - 60]
    texts |= {200: "", 201: None, 202: "a" * 29, 203: "x" * passages.STRETCH + "q" * 30, 204: "x" * (passages.STRETCH - 15) + "q" * 30, None: "a" * 50}
    return texts, [*shared, "q" * 30, "w" * 30, *[t[:30] for t in list(texts.values())[:120:7]]]


@pytest.mark.parametrize("most", [200_000, 5])
def test_first_holders_equal_a_plain_search(spark, most):
    texts, strings = planted()
    docs = spark.createDataFrame([*texts.items(), (61, "é" * 30)], "id long, text string").repartition(3)
    got = {r["string"]: (r["first"], r["second"]) for r in passages.first_holders(spark.createDataFrame([(x,) for x in strings * 2], "string string"), docs, most).collect()}
    want = {}
    for x in strings:
        ids = sorted({i for i, t in [*texts.items(), (61, "é" * 30)] if i is not None and t and x in t})
        want[x] = (*ids, None, None)[:2]
    assert got == want and any(b is not None for _, b in want.values()) and want["w" * 30] == (None, None)


def test_insights_without_postings(spark, tmp_path, monkeypatch):
    """Heads of one frequent word, or of none, meet no table of postings or texts."""

    def refuse(*_, **__):
        raise AssertionError("a term index was made")

    monkeypatch.setattr(index, "build", refuse)
    monkeypatch.setattr(index, "containing", refuse)
    rows = [(i, "the one head that many documents share" if i % 3 else "x" * 40) for i in range(1, 152)] + [(300, "short"), (350, None), (400, "a head that no other one holds at all")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["existing"], r["utility"]) for r in catalog.QUERIES["insight_match"](spark, str(tmp_path)).collect()}
    assert got == {50: (1, 0.6), 100: (1, 0.6), 150: (3, 0.6), 400: (None, 0.7)}
