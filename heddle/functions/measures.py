"""Measures of agreement by name, as aggregates that users can add to.

A measure either sums: it turns values into a vector of fixed length, vectors add up, and the total gives the measure. Its
partitions are summed where they are and only one vector a key and task moves, so a key may hold any share of the rows. Or it
needs a group's values together: then a group must fit in a task. Both kinds can be called from SQL once registered.

A name that is not known falls back to the deviation. Null values count for nothing; a key without values measures 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Summed:
    """vector of an array of values, and the measure of a total of such vectors."""

    vector: Callable[[np.ndarray], np.ndarray]
    measure: Callable[[np.ndarray], float]

    def of(self, values: np.ndarray) -> float:
        return float(self.measure(np.asarray(self.vector(values), float))) if len(values) else 1.0


@dataclass(frozen=True)
class Gathered:
    """The measure of an array of all values of a group."""

    measure: Callable[[np.ndarray], float]

    def of(self, values: np.ndarray) -> float:
        return float(self.measure(values)) if len(values) else 1.0


def _deviation(t: np.ndarray) -> float:
    n, total, squares = t
    return float(np.sqrt(max(0.0, squares / n - (total / n) ** 2)))


def _entropy(bins: np.ndarray) -> float:
    share = bins[bins > 0] / bins.sum()
    return float(-(share * np.log2(share)).sum() / np.log2(len(bins)))


def _quartiles(v: np.ndarray) -> float:
    if len(v) < 4:
        return float(v.std())
    v = np.sort(v)
    return float(v[int(len(v) * 0.75)] - v[int(len(v) * 0.25)])


BUILT_IN: dict[str, Summed | Gathered] = {
    "std_dev": Summed(lambda v: np.array([len(v), v.sum(), (v * v).sum()]), _deviation),
    "entropy": Summed(lambda v: np.bincount(np.clip(np.floor(v * 10), 0, 9).astype(int), minlength=10), _entropy),
    "interquartile_range": Gathered(_quartiles),
}


class Measures:
    """The measures of a session: the built-in ones and those registered."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, dict(BUILT_IN)

    def register(self, name: str, measure: Summed | Gathered) -> None:
        """Make a measure known by name here, and as an aggregate function in SQL."""
        self.known[name] = measure

        @F.pandas_udf("double")
        def aggregate(values: pd.Series) -> float:
            return measure.of(values.dropna().to_numpy(float))

        self.spark.udf.register(name, aggregate)

    def find(self, name: str) -> Summed | Gathered:
        return self.known.get(name, self.known["std_dev"])

    def apply(self, rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
        """key and `measure` of each key's values."""
        found = self.find(name)
        thin = rows.select(key, F.col(value).cast("double").alias("_value"))
        kind = rows.schema[key].dataType.simpleString()
        if isinstance(found, Gathered):

            def whole(group: pa.Table) -> pa.Table:
                values = group.column("_value").drop_null().to_numpy()
                return pa.table({key: group.column(key).slice(0, 1), "measure": pa.array([found.of(values)])})

            return thin.groupBy(key).applyInArrow(whole, f"`{key}` {kind}, measure double")

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict = {}
            for b in batches:
                keys = b.column(0).dictionary_encode()
                at = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
                names = [*keys.dictionary.to_pylist(), None]
                values = b.column(1).to_numpy(zero_copy_only=False)
                fine = ~np.isnan(values)
                for i in np.unique(at):
                    own = values[(at == i) & fine]
                    add = np.asarray(found.vector(own), float) if len(own) else None
                    old = totals.get(names[i])
                    totals[names[i]] = add if old is None else old if add is None else old + add
                if len(totals) > 10_000:
                    yield batch(totals)
                    totals = {}
            if totals:
                yield batch(totals)

        def batch(totals: dict) -> pa.RecordBatch:
            lists = pa.array([None if v is None else v.tolist() for v in totals.values()], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(list(totals), arrow_key), lists], [key, "v"])

        from pyspark.sql.pandas.types import to_arrow_type

        arrow_key = to_arrow_type(rows.schema[key].dataType)
        parts = thin.mapInArrow(partial, f"`{key}` {kind}, v array<double>")
        # Vectors are added place by place, with map-side combining.
        keys = parts.groupBy(key).agg(F.max(F.size("v")).alias("_n"))
        sums = parts.select(key, F.posexplode("v").alias("_i", "_x")).groupBy(key, "_i").agg(F.sum("_x").alias("_x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda r: r["_x"]).alias("_v")).withColumnRenamed(key, "_key")

        @F.pandas_udf("double")
        def finish(v: pd.Series) -> pd.Series:
            return v.map(lambda x: 1.0 if x is None else float(found.measure(np.array(x, float))))

        return keys.join(sums, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, finish("_v").alias("measure"))
