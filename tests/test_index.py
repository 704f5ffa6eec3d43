"""The term index against scores from the texts, what a query reads of it, and datasets that follow their tables."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import index, memory, retrieval
from heddle.sources.kept import kept, part


def rows_of(df):
    return {r[0]: r[1] for r in df.collect()}


def test_scores_equal_those_from_the_texts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b"), (-4, "The the THE und"), (-5, "straße über que que"), (-6, "1234 que_the")], "doc_id long, text string")
    docs = docs.union(odd)
    index.build(docs, str(tmp_path / "i"))
    for words in (["the", "und", "que"], ["The"], ["nowhereatall", "über"], ["a"]):
        want, got = rows_of(retrieval.bm25(docs, words)), rows_of(index.bm25(spark, str(tmp_path / "i"), words))
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], abs=2e-6) for i in got)


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index.build(docs, str(tmp_path / "i"))
    assert index.bm25(spark, str(tmp_path / "i"), ["the"]).count() == 0


def test_postings_are_in_order_and_filtered_at_the_scan(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    index.build(docs, str(tmp_path / "i"))
    found = index.postings(spark, str(tmp_path / "i"), ["the"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,the)" in plan.replace("IsNotNull(term), ", "")
    files = spark.read.parquet(str(tmp_path / "i/postings")).withColumn("_f", F.input_file_name()).groupBy("_f").agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("a").collect()
    assert len(files) >= 4 and all(x["b"] <= y["a"] for x, y in zip(files, files[1:], strict=False))


def test_words_are_counted_where_their_text_lies(spark):
    """A text moves once; its words and their counts don't, and repeated or null identifiers change no count."""
    rows = [(1, "the the und"), (2, None), (3, "que " * 400), (1, "the end"), (None, "the lost one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for made in (index.counted(docs), memory.term_index(docs)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {tuple(r) for r in index.counted(docs).filter("term is not null").collect()}
    assert got == {("the", 1, 2, 3), ("und", 1, 1, 3), ("que", 3, 400, 400), ("the", 1, 1, 2), ("end", 1, 1, 2)}


def test_totals_count_documents_without_identifiers_and_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the the und"), (2, None), (None, "the lost one"), (None, "")], "doc_id long, text string")
    index.build(docs, str(tmp_path / "i"))
    assert tuple(part(spark, str(tmp_path / "i"), "totals", index.TOTALS).first()) == (4, 1.5)


def test_a_kept_dataset_follows_its_table(spark, tmp_path):
    built = []

    def build(at):
        built.append(at)
        spark.range(len(built)).write.parquet(f"{at}/t")

    spark.range(3).write.parquet(f"{tmp_path}/x.parquet")
    one = kept(spark, str(tmp_path), f"test-{tmp_path.name}", ["x"], build)
    assert kept(spark, str(tmp_path), f"test-{tmp_path.name}", ["x"], build) == one and len(built) == 1
    assert spark.read.parquet(f"{one}/t").count() == 1
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/x.parquet")
    two = kept(spark, str(tmp_path), f"test-{tmp_path.name}", ["x"], build)
    assert two != one and len(built) == 2 and spark.read.parquet(f"{two}/t").count() == 2
