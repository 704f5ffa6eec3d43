"""Datasets derived from tables and kept beside them: built once for a state of their tables, read by every later query.

A dataset lies in the shared folder under a name that holds the sizes, file counts and times of its tables, so a changed table
gets a new one. It is built beside its place and moved there when whole: a lost build leaves nothing that a query could take.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heddle.sources.scratch import root


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def state(spark: SparkSession, path: str) -> str:
    """What tells one state of a table from another: its bytes, its files and the time of its folder."""
    files, where = _at(spark, path)
    size = files.getContentSummary(where)
    return f"{path} {size.getLength()} {size.getFileCount()} {files.getFileStatus(where).getModificationTime()}"


def kept(spark: SparkSession, sf_dir: str, name: str, tables: list[str], build: Callable[[str], None]) -> str:
    """The folder of dataset `name`, which `build` writes below the path it is given if it is not there yet."""
    mark = hashlib.sha256("\n".join(state(spark, f"{sf_dir}/{t}.parquet") for t in tables).encode()).hexdigest()[:24]
    folder = f"{root(spark)}/heddle/kept"
    path = f"{folder}/{name}-{mark}"
    files, where = _at(spark, path)
    if not files.exists(where):
        made = f"{folder}/.{name}-{uuid.uuid4().hex}"
        build(made)
        # Another session may have been faster: its dataset is as good, and a move onto it would nest.
        if files.exists(where) or not files.rename(_at(spark, made)[1], where):
            files.delete(_at(spark, made)[1], True)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that only the build of a dataset needed."""
    files, where = _at(spark, path)
    files.delete(where, True)


def part(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One table of a kept dataset; its schema is stated, so that no file is opened to learn it."""
    return spark.read.schema(schema).parquet(f"{path}/{name}")
