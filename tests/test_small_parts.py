"""Labels of segments, upper percentiles, routes by metrics, content keys, containment by index."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import index, memory, recall, sinks


def test_labels_of_segments(spark):
    rows = [
        ("a", 1, 0, ["X", "Y"], "some content words here"), ("a", 2, 0, ["Y"], None), ("a", 3, 0, ["Z", "X"], None),
        ("a", 4, 1, [], "the quick brown foxes jump"), ("a", 5, 1, None, "later"), ("a", 6, 2, [], "a b c"), ("a", 7, 3, None, None), (None, 1, 0, ["N"], None),
    ]
    got = {(r["k"], r["segment"]): r["label"] for r in memory.segment_labels(spark.createDataFrame(rows, "k string, at int, segment long, entities array<string>, content string"), "k", "at").collect()}
    assert got == {("a", 0): "X & Y", ("a", 1): "quick brown foxes", ("a", 2): "topic-3", ("a", 3): "topic-4", (None, 0): "N"}


def test_units_know_their_segment(spark):
    marked = spark.createDataFrame([("a", i, i in (2, 3, 7)) for i in range(9)] + [("b", 200_000, True), ("b", 5, False)], "k string, at long, boundary boolean")
    got = {(r["k"], r["at"]): r["segment"] for r in memory.segmented(marked, "k", "at").collect()}
    assert got == {("a", i): (0 if i < 3 else 1 if i < 7 else 2) for i in range(9)} | {("b", 5): 0, ("b", 200_000): 0}


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_upper_percentile(spark, share):
    dice = random.Random(3)
    rows = [(u, i, f"s{i}", dice.randint(0, 6)) for u, n in ((1, 1), (2, 2), (3, 40), (4, 7)) for i in range(n)]
    got = {r["id"]: (r["sentences"], r["kept"], r["text"]) for r in recall.above_percentile(spark.createDataFrame(rows, "id int, at int, sentence string, score int"), share).collect()}
    for u in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == u]
        scores = sorted(r[3] for r in own)
        limit = scores[min(math.floor(len(scores) * (1 - share)), len(scores) - 1)]
        kept = [r[2] for r in own if r[3] >= limit]
        assert got[u] == (len(own), len(kept), " ".join(kept))


def test_upper_percentile_at_whole_places(spark):
    """Seven tenths of 90 sentences are 63, whatever a binary fraction makes of it."""
    rows = [(n, i, f"s{i}", i) for n in (10, 90, 170, 330) for i in range(n)]
    got = {r["id"]: r["kept"] for r in recall.above_percentile(spark.createDataFrame(rows, "id int, at int, sentence string, score int"), 0.3).collect()}
    assert got == {n: n - n * 7 // 10 for n in (10, 90, 170, 330)}


def test_routes(spark):
    rows = spark.createDataFrame([(0.4, 1.0), (0.6, 2.0), (None, 3.0), (0.5, None)], "a double, b double")
    route = lambda r: [x[0] for x in rows.select(recall.routed({"a": F.col("a"), "b": F.col("b")}, r)).collect()]
    assert route({"a": "bare", "b==2": "two", "default": "rest"}) == ["rest", "bare", "rest", "rest"]
    assert route({"b!=1": "no", "a<0.5": "low"}) == ["low", "no", "no", "no"]
    assert route({"c>0": "never", "b>=3": "high"}) == [None, None, "high", None]


def plain_key(text):
    h, units = 5381, text.encode("utf-16-be", "surrogatepass")
    for i in range(0, min(len(units), 1_000), 2):
        h = (h * 33 + int.from_bytes(units[i : i + 2])) & 0xFFFFFFFF
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def test_content_keys_are_over_utf16_units(spark):
    texts = ["", "a", "é字", "😀 x", "😀" * 400, "b" * 499 + "😀c", "long text " * 200]
    got = {r["t"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", sinks.content_key(F.col("t")).alias("k")).collect()}
    assert got == {t: plain_key(t) for t in texts}


def test_containment_by_the_rarest_word(spark, tmp_path):
    texts = ["one two three four five six", "xx one two three four yy", "ONE two three four five", "abc one two three fourfold", "twothree", "", None, "so two three fo it is"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index.build(docs, str(tmp_path / "i"))
    heads = ["one two three four", "two three fo", "ne two three four five", "nothing like this anywhere", "twothree", "o"]
    asked = spark.createDataFrame(list(enumerate(heads)), "ask long, head string")
    got = {(r["ask"], r["id"]) for r in index.containing(spark, str(tmp_path / "i"), asked, docs).collect()}
    assert got == {(a, i) for a, h in enumerate(heads) for i, t in enumerate(texts) if t and h in t}
