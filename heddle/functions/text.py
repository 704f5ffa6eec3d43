"""Text expressions: token estimates, terms and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of a partition in which their words are counted, about.
TOGETHER = 1_000


def estimated_tokens(text) -> Column:
    """A token for each four characters begun; null counts as empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def terms(text, least: int = 3) -> Column:
    """Lower-case runs of letters of `least` characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"), lambda x: F.length(x) >= least)


def together(docs: DataFrame, id_col: str) -> DataFrame:
    """docs dealt by their identifier: what then groups a document's words by it moves no word, and a text has moved once."""
    return docs.repartition(max(8, -(-docs.count() // TOGETHER)), id_col)
