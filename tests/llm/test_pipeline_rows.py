"""The pipeline's stages decide on rows: null and repeated identifiers lose, keep and multiply nothing."""

from collections import Counter

import pytest

import corpus_pipeline
from heddle.llm import fair_mix, toxic_trees

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} über" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "a  b\tc"), (5, LONG), (6, LONG + " end"), (7, "é" * 300), (8, "aaaa" * 200), (None, "null id"), (None, None), (None, "another null id")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 2 else "web", None) for n, (i, t) in enumerate(ODD)], DOCS).cache()


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def words(rows):
    out = Counter()
    for i, text, n in rows:
        out[i] += len((text or "").split()) * n
    return +out


def test_odd_rows_through_all_stages(spark, odd, tmp_path):
    spark.createDataFrame([(i, 0, 0) for i in range(9)] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, odd, str(tmp_path))
    assert pairs(clean) == Counter(ODD)
    exact = stages["exact_dedup"](spark, clean, str(tmp_path))
    kept = [(1, None), (3, "a b c"), (5, LONG), (6, LONG + " end"), (7, "é" * 300), (8, "aaaa" * 200), (None, "null id"), (None, "another null id")]
    assert pairs(exact) == Counter(kept)
    near = stages["near_dedup"](spark, exact, str(tmp_path)).cache()
    kept.remove((6, LONG + " end"))
    assert pairs(near) == Counter(kept)
    mixed = stages["mixing"](spark, near, str(tmp_path)).cache()
    taken = {}
    for r in fair_mix.taken(near).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert words((i, t, n) for (i, t), n in pairs(mixed).items()) == +Counter(taken)
    packed = stages["packing"](spark, mixed, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for (i, _), n in pairs(mixed).items() for _ in range(n))


def test_each_stage_takes_repeated_and_null_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    near = pairs(stages["near_dedup"](spark, odd, ""))
    assert near == Counter([(1, None), (2, ""), (None, None), (3, "a b c"), (5, LONG), (7, "é" * 300), (8, "aaaa" * 200), (None, "null id"), (None, "another null id")])
    taken = Counter()
    for r in fair_mix.taken(odd).collect():
        taken[r["doc_id"]] += r["taken"]
    mixed = pairs(stages["mixing"](spark, odd, ""))
    assert words((i, t, n) for (i, t), n in mixed.items()) == +taken
    assert taken[3] and taken[None]


def test_toxic_rows_go_with_null_or_repeated_identifiers(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = docs.join(toxic_trees.learn(docs, labels).score(docs), "doc_id").select("doc_id", "text", "predicted").collect()
    toxic, fine = ([r for r in judged if r["predicted"] == p][:4] for p in (1, 0))
    assert len(toxic) == len(fine) == 4
    odd = spark.createDataFrame([(None, r["text"], None, None, None) for r in toxic + fine], DOCS)
    clean = corpus_pipeline.toxicity(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").union(odd), sf_dir)
    assert pairs(clean.filter("doc_id is null")) == Counter((None, r["text"]) for r in fine)
    assert clean.count() == sum(r["predicted"] == 0 for r in judged) + 4
