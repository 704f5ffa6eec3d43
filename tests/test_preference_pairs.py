"""Every bad document is paired with the first good one of its source, as the reference's formatter does."""

import duckdb

from heddle.operators import service
from heddle.plans import catalog

DATA = "/root/testdata/sf0.01"


def test_a_pair_for_every_bad_document(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "b"), (6, "c"), (7, None), (8, None)], "doc_id long, source string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (5, 0), (6, 1), (7, 1), (8, 0)], "doc_id long, quality int")
    got = {(r["source"], r["chosen"], r["rejected"]) for r in service.preference_pairs(docs, labels).collect()}
    assert got == {("a", 2, 1), ("a", 2, 4), (None, 7, 8)}


def test_pairs_equal_the_first_match_join(spark):
    sql = f"""
        WITH b AS (SELECT doc_id, source, quality FROM '{DATA}/documents.parquet' JOIN '{DATA}/labels.parquet' USING (doc_id)),
        p AS (SELECT source, doc_id FROM b WHERE quality = 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1)
        SELECT b.source, p.doc_id, b.doc_id FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source WHERE quality = 0"""
    got = catalog.QUERIES["dpo_pairs"](spark, DATA).select("source", "chosen", "rejected").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, duckdb.sql(sql).fetchall()))
