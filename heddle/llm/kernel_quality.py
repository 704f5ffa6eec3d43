"""Quality by random Fourier features of document statistics, a ridge fit and isotonic calibration.

One pass over the whole texts gives each document a short vector of statistics, which is stored. Everything else works on
those: labelled rows give means and deviations, each partition sums its normal equations of the Fourier features, the sums
are added on Spark, and the driver solves a system of fixed size. An isotonic fit on labelled rows that the ridge fit has
not seen makes the ridge score the chance of the label. All labelled rows are used; nothing is sampled.

Rows whose identifier's checksum mod 3 is 1 are never learned from. Of the others, those with (checksum div 3) mod 4 = 0
calibrate, the rest fit. The statistics come from the text alone.

Null text is empty, and empty texts have a score like others; very long texts count as a whole. Null identifiers are never
learned from; repeated labels and rows count as rows. Equal texts have equal scores, and ties of ridge scores are one point
of the calibration. Where fitting or calibrating rows have no two labels, the score is the share of good rows (one half
without labels). An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ROW, discard, keyed, stored, text_or_empty

#: Fourier features, width of the kernel in units of the root of the number of statistics, and weight of the ridge.
FOURIER, WIDTH, RIDGE = 256, 1.0, 1.0
#: Steps of the ridge score that the calibration tells apart.
STEPS = 10_000
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_MARKS, _SYMBOLS, _CALLS = b".,;:'\"()-", b"#*$%&|<>@~^_=+[]{}\\/", b"!?"
STATISTICS = (
    "words", "word_mean", "word_deviation", "long_words", "short_words", "distinct_words", "repeated_pairs", "lines", "words_a_line", "repeated_lines", "capitals", "shouted",
    "digits", "marks", "symbols", "calls", "beyond_ascii", "entropy", "packed", "stops",
)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the third of the documents that the model may not learn from."""
    return F.coalesce(_checksum(id_col) % 3 == 1, F.lit(False))


def _checksum(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def statistics(text: str) -> list[float]:
    """Shape of a text, from all of it; every number is bounded or grows as a root or logarithm."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    share = counts[counts > 0] / size
    of = lambda chars: float(counts[list(chars)].sum()) / size
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = max(1.0, counts[list(_UPPER + _LOWER)].sum())
    shouted = sum(w.isupper() for w in set(words))
    return [
        np.log1p(len(words)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        float((lengths > 12).mean()),
        float((lengths < 4).mean()),
        len(set(words)) / n,
        1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        np.log1p(len(lines)),
        np.log1p(len(words) / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0,
        np.sqrt(counts[list(_UPPER)].sum() / letters),
        np.sqrt(shouted / max(1, len(set(words)))),
        np.sqrt(of(_DIGITS)),
        np.sqrt(of(_MARKS)),
        np.sqrt(of(_SYMBOLS)),
        np.sqrt(of(_CALLS)),
        np.sqrt(float(counts[128:].sum()) / size),
        float(-(share * np.log2(share)).sum()) if raw else 0.0,
        np.log(size / max(1, len(zlib.compress(raw, 1)))) if raw else 0.0,
        np.sqrt(float(counts[46]) / n),
    ]


def described(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with `x`, the statistics of the whole text."""
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([statistics(t) for t in b.column(width).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], made], [*keep, "x"])

    rows = docs.select(*keep, text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", x array<double>")


class Fourier:
    """The fixed random map: cosines whose inner products approximate a Gaussian kernel of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int = FOURIER, width: float = WIDTH, seed: int = 11):
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        dice = np.random.default_rng(seed)
        self.w = dice.normal(size=(len(mean), size)) / (width * np.sqrt(len(mean)))
        self.b = dice.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of rows (x, y): each partition sums its own, Spark adds them row by row, the driver gets one matrix."""
    width, shared = len(fourier.mean), rows.sparkSession.sparkContext.broadcast(fourier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = shared.value(_matrix(b.column(0), width))
                part = z.T @ np.hstack([z, b.column(1).to_numpy(zero_copy_only=False)[:, None]])
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    side = len(fourier.b) + 1
    sums = rows.select("x", F.col("y").cast("double").alias("y")).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((side, side + 1))
    out[sums["i"], sums["j"]] = sums["v"]
    return out[:, :side], out[:, side]


def isotonic(counts: list[tuple[int, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over (step, rows, good rows) in the order of steps: the steps, and a rising share for each."""
    pools: list[list] = []
    for step, n, good in counts:
        pools.append([n, good, [step]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n_, good_, steps = pools.pop()
            pools[-1] = [pools[-1][0] + n_, pools[-1][1] + good_, pools[-1][2] + steps]
    return np.array([s for p in pools for s in p[2]], float), np.array([p[1] / p[0] for p in pools for _ in p[2]], float)


class Model:
    """Map, weights and calibration; without a map, a constant score."""

    def __init__(self, base: float, fourier: Fourier | None = None, weights: np.ndarray | None = None, curve: tuple[np.ndarray, np.ndarray] | None = None):
        self.base, self.fourier, self.weights, self.curve = base, fourier, weights, curve

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Ridge scores in whole steps."""
        return np.rint(np.clip(self.fourier(x) @ self.weights, -1, 2) * STEPS)

    def chance(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.raw(x), *self.curve), 0.0, 1.0)

    def score(self, described_: DataFrame, keep: list[str], what: str = "chance") -> DataFrame:
        """The columns `keep` of rows (.., x) with `score`."""
        shared, width = described_.sparkSession.sparkContext.broadcast(self), len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for b in batches:
                x = _matrix(b.column(width), len(STATISTICS)) if b.num_rows else np.zeros((0, len(STATISTICS)))
                got = getattr(model, what)(x) if b.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], pa.array(got, pa.float64())], [*keep, "score"])

        rows = described_.select(*keep, "x")
        return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", score double")


def learn(described_: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """A model from rows (id_col, x) and all labels that may be learned from."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y"))
    part = F.floor(_checksum("_id") / 3) % 4 == 0
    rows = stored(described_.select(F.col(id_col).alias("_own"), "x").join(known, F.col("_own") == F.col("_id")).select("x", "y", part.alias("calibrates")), "quality-rows")
    fit, check = rows.filter("not calibrates"), rows.filter("calibrates")
    seen = {(r["calibrates"], r["y"]): r["count"] for r in rows.groupBy("calibrates", "y").count().collect()}
    total = sum(seen.values())
    model = Model(sum(n for (_, y), n in seen.items() if y) / total if total else 0.5)
    if len(seen) == 4:
        at = [F.col("x")[i] for i in range(len(STATISTICS))]
        spread = fit.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
        fourier = Fourier(np.array(spread[: len(at)], float), np.array(spread[len(at) :], float))
        a, b = normal_equations(fit, fourier)
        # The constant is not held back.
        model = Model(model.base, fourier, np.linalg.solve(a + RIDGE * np.diag([1.0] * FOURIER + [1e-6]), b))
        steps = model.score(check, ["y"], "raw").groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("good"))
        model.curve = isotonic([(r["score"], r["n"], r["good"]) for r in steps.orderBy("score").collect()])
    discard(rows)
    return model


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id_col, held_out, score, predicted."""
    rows = stored(described(docs, [id_col], text_col), "quality-statistics")
    got = learn(rows, labels, id_col, label_col).score(rows, [id_col])
    return got.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that are predicted good, in their own columns; each row is judged by itself."""
    rows = keyed(docs, "quality-keyed")
    seen = stored(described(rows, [id_col, ROW], text_col), "quality-statistics")
    good = learn(seen, labels, id_col, label_col).score(seen, [ROW]).filter("score >= 0.5").select(ROW)
    return rows.join(good, ROW, "left_semi").select(docs.columns)
