"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again for the next one.

Toxic documents go, then exact copies, then near copies; what is left is mixed to target weights and packed into sequences.
Every stage works on all that its predecessor kept. Stages decide on rows by a stored key of their own, so identifiers may be
null or repeat. The mix may take a document twice, and its rows then are packed as often. Null and empty texts are judged,
compared and packed as empty ones (a mix takes no document without words), very long texts as a whole; an empty table gives
an empty result.

What a stage stores on its way is deleted when the next one begins, unless the documents that one gets still read it: where
results are written and read again, as in `run`, they don't.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heddle.llm import bbit_minhash, content_sort, fair_mix, group_pack, toxic_trees
from heddle.llm.common import discard, noted, scratch_root

#: Tables that the stage before has stored.
_left: list[DataFrame] = []


def _roots(docs: DataFrame) -> str:
    """The folders that a DataFrame reads."""
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return " ".join(x.relation().location().rootPaths().mkString(" ") for x in found if x.getClass().getSimpleName() == "LogicalRelation")


def _release(docs: DataFrame) -> None:
    read = _roots(docs)
    if not any(t.stored_at.rpartition("/")[2] in read for t in _left):
        discard(*_left)
        _left.clear()


def _stage(work: Callable) -> Callable:
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(docs)
        with noted(_left):
            return work(spark, docs, sf_dir)

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic_trees.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return content_sort.dedup(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bbit_minhash.dedup(docs)


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fair_mix.mixed(docs)


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return group_pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned scores and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{scratch_root(spark)}/heddle/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    _release(docs)
    return docs
