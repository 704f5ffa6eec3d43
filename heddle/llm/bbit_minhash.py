"""Near-duplicate documents by b-bit MinHash.

Words are lower-cased (A-Z) runs between ASCII blanks; a document's set is its distinct five-word shingles. Band keys of
MinHash minima give candidates; of every minimum only the low bits stay, packed into longs, and the agreeing bits, corrected
for chance agreement, estimate the similarity; candidates that may reach the threshold are confirmed on full sets.

A document with fewer than five words has its whole sequence as one shingle; without words, or with null text, its set is
empty and it is linked with nothing. Documents with equal sets are linked, repeated rows too. Very long texts are taken whole.
A similarity of exactly the threshold links; ties inside a component go to the smallest identifier. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ROW, keyed, row_id, text_or_empty
from heddle.llm.near import Bands, classes

#: At the threshold a pair escapes all bands once in 50,000 times, at 0.8 once in ten million; two bits of each minimum stay.
PLAN = Bands(bands=40, rows=5, bits=2)
#: Six standard deviations of the estimate at the threshold.
SLACK = 0.22


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Bands = PLAN) -> DataFrame:
    """id_col, n_shingles, component_id (smallest identifier reachable by links), kept."""
    found = classes(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")), plan, SLACK)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("comp")).alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, in the documents' own columns: that of the least identifier, nulls last."""
    rows = keyed(docs, "near-rows")
    keep = near_duplicates(rows.select(row_id(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text").filter("kept").select(F.col("id.row").alias(ROW))
    return rows.join(keep, ROW, "left_semi").select(docs.columns)
