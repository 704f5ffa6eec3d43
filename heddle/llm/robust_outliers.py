"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules look at word counts and at repeated five-word windows. The documents that pass are described by a vector of
transformed statistics; minimum-covariance-determinant estimates are made for each language and source, and a document
whose robust Mahalanobis distance is too large is rejected.

The estimates follow the deterministic variant: several starts (medians with absolute deviations, alone and with the
correlations of squashed values and of directions), concentration steps from each, which fit mean and covariance to the half of
the rows with the least distances, and of these fits the one whose covariance has the least determinant, carried on until it
settles. Every step is one grouped aggregate with mergeable quantile sketches, so a group of any share is aggregated before rows
move. A group with fewer than LEAST_ROWS rows takes the estimate of its language, and that of all rows if the language has too few.

Null text has no words. Null language or source is a group of its own. Repeated rows count as often as they occur, texts of any
length are counted whole, and ties in distance are all inside the half. Columns that have the name of a result are replaced by
it; others are kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ROW, WORD, discard, joined_small, keyed, stored, text_or_empty

#: Share of a group's rows that the estimate is fitted to, concentration steps from each start, and those of the best.
SUBSET, STEPS, MORE = 0.5, 3, 2
#: Rows below which a group borrows the estimate of the next larger one.
LEAST_ROWS = 200
#: Standard deviation that is added to each statistic's in the end, in its transformed unit: a constant statistic rejects no rounding.
FLOOR = (0.5, 0.12, 0.2, 0.2, 0.2)
#: Rates per thousand words of symbols, repeated lines and repeated words below which a text looks like one without any.
USUAL = {"n_symbols": 50.0, "n_dup_lines": 20.0, "n_repeat_words": 50.0}
#: The 0.5 and the 1 - 1e-9 quantile of the chi-square distribution with five degrees of freedom.
MEDIAN_CHI2, REJECT_CHI2 = 4.3515, 52.62
P = len(FLOOR)
X = [f"x{i}" for i in range(P)]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; text_col is dropped."""
    text = text_or_empty(text_col)
    df = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")).drop(text_col)
    df = df.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long")).withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w))).drop("_words")
    at = F.sequence(F.lit(0), F.col("n_words").cast("int") - 5)
    window = F.transform(at, lambda i: F.xxhash64(*[F.get("_hash", i + k) for k in range(5)]))
    df = df.withColumn("_windows", F.when(F.col("n_words") >= 5, window)).drop("_hash")
    df = df.withColumn("_sorted", F.sort_array("_windows"))
    # A cheap pass tells whether any window repeats; positions are sorted only where one does.
    df = df.withColumn("_any", F.size(F.array_distinct("_sorted")) < F.size("_sorted")).drop("_sorted")
    placed = F.array_sort(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.col("_any"), placed)).drop("_windows")
    last = F.size("_placed") - 1
    twice = F.filter("_placed", lambda x, j: ((j > 0) & (F.get("_placed", j - 1)["w"] == x["w"])) | ((j < last) & (F.get("_placed", j + 1)["w"] == x["w"])))
    df = df.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_placed")
    covered = F.aggregate(F.transform("_starts", lambda i, j: F.least(F.lit(5), F.coalesce(F.get("_starts", j + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("_any"), covered).otherwise(0).cast("long")).drop("_starts", "_any")
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def transformed() -> list[Column]:
    """The statistics as near-symmetric numbers: lengths by logarithm, rates per thousand words by logarithm from the usual rate on."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log(n), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *[F.log1p(1000 / rate * F.col(c) / n) for c, rate in USUAL.items()]]


def _total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _factored(stats: DataFrame) -> DataFrame:
    """Add the Cholesky factor l<i><j> of each group's covariance c<i><j>, whose diagonal is held above the floor."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - (_total([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]) if j else F.lit(0.0))
            stats = stats.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit((FLOOR[i] / 4) ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return stats.drop(*[f"c{i}{j}" for i in range(P) for j in range(i + 1)])


def _distance(df: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance of x from the group's mean m by forward substitution."""
    for i in range(P):
        known = _total([F.col(f"l{i}{k}") * F.col(f"_z{k}") for k in range(i)]) if i else F.lit(0.0)
        df = df.withColumn(f"_z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - known) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", _total([F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(P)])).drop(*[f"_z{i}" for i in range(P)])


def _moments() -> list[Column]:
    mean = [F.avg(f"x{i}").alias(f"m{i}") for i in range(P)]
    return mean + [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]


def _with(df: DataFrame, stats: DataFrame) -> DataFrame:
    return joined_small(df, stats.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")


def _starts(rows: DataFrame) -> DataFrame:
    """grp (group, start), m<i> and l<i><j>: medians, and covariances of three kinds."""
    centre = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{i}", 0.5, 2000).alias(f"m{i}") for i in range(P)])
    apart = _with(rows, centre).groupBy("grp").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 2000).alias(f"a{i}") for i in range(P)])
    scaled = apart.select("grp", *[f"m{i}" for i in range(P)], *[F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + (FLOOR[i] / 4) ** 2).alias(f"s{i}") for i in range(P)])
    z = [(F.col(f"x{i}") - F.col(f"m{i}")) / F.col(f"s{i}") for i in range(P)]
    size = F.sqrt(_total([x * x for x in z]))
    turned = _with(rows, scaled).select("grp", *[f"{c}{i}" for c in "ms" for i in range(P)], *[F.tanh(z[i]).alias(f"t{i}") for i in range(P)], *[F.when(size > 0, z[i] / size).otherwise(0.0).alias(f"u{i}") for i in range(P)])
    both = [F.covar_pop(f"{k}{i}", f"{k}{j}").alias(f"{k}{i}{j}") for k in "tu" for i in range(P) for j in range(i + 1)]
    facts = stored(turned.groupBy("grp").agg(*[F.first(f"{c}{i}").alias(f"{c}{i}") for c in "ms" for i in range(P)], *both), "quality-starts")
    made = []
    for start, k in enumerate((None, "t", "u")):
        spread = []
        for i in range(P):
            for j in range(i + 1):
                norm = F.sqrt(F.col(f"{k}{i}{i}") * F.col(f"{k}{j}{j}")) if k else None
                like = F.lit(1.0) if i == j else F.when(norm > 0, F.col(f"{k}{i}{j}") / norm).otherwise(0.0) if k else F.lit(0.0)
                spread.append((like * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}"))
        made.append(facts.select(F.struct("grp", F.lit(start).alias("start")).alias("grp"), *[f"m{i}" for i in range(P)], *spread))
    return _factored(reduce(DataFrame.union, made))


def _concentrated(rows: DataFrame, stats: DataFrame, steps: int) -> DataFrame:
    for _ in range(steps):
        far = _distance(_with(rows, stats)).select("grp", *X, "d2")
        cut = far.groupBy("grp").agg(F.percentile_approx("d2", SUBSET, 2000).alias("cut"))
        stats = stored(_factored(_with(far, cut).filter("d2 <= cut").groupBy("grp").agg(*_moments())), "quality-step")
    return stats


def mcd(rows: DataFrame) -> DataFrame:
    """One row per grp of rows (grp, x0..): mean m<i>, Cholesky factor l<i><j> of the robust covariance, and det, the logarithm of the fit's determinant."""
    tried = rows.withColumn("grp", F.explode(F.array(*[F.struct("grp", F.lit(k).alias("start")) for k in range(3)])))
    fits = _concentrated(tried, _starts(rows), STEPS)
    columns = [c for c in fits.columns if c != "grp"]
    det = _total([F.log(f"l{i}{i}") for i in range(P)]) * 2
    best = fits.groupBy(F.col("grp.grp").alias("grp")).agg(F.min_by(F.struct(*columns), F.struct(det, "grp.start")).alias("fit")).select("grp", "fit.*")
    fit = _concentrated(rows, best, MORE)
    # The distances' median tells how much smaller the half's covariance is than the whole's.
    scale = _distance(_with(rows, fit)).groupBy("grp").agg(F.greatest(F.percentile_approx("d2", 0.5, 2000) / MEDIAN_CHI2, F.lit(1.0)).alias("scale"))
    whole = [(F.col("scale") * _total([F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)]) + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    return _factored(_with(fit, scale).select("grp", *[f"m{i}" for i in range(P)], det.alias("det"), *whole))


def judge(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", reject: float = REJECT_CHI2) -> DataFrame:
    """docs without text_col, with the base statistics, base_failed, d2 (null where base_failed) and kept."""
    own = [c for c in docs.columns if c not in (text_col, *BASE, "d2", "kept")]
    packed = docs.select(F.struct(*own).alias("_own"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"))
    described = stored(base_statistics(packed, "_text"), "quality-statistics")
    good = described.filter("not base_failed").select("_lang", "_source", *[x.alias(n) for x, n in zip(transformed(), X, strict=True)])
    sizes = stored(good.groupBy("_lang", "_source").agg(F.count("*").alias("n")), "quality-groups")
    by_lang = sizes.groupBy("_lang").agg(F.sum("n").alias("lang_n")).withColumnRenamed("_lang", "_l")
    level = F.when(F.col("n") >= LEAST_ROWS, F.struct("_lang", "_source", F.lit(0).alias("level"))).when(F.col("lang_n") >= LEAST_ROWS, F.struct("_lang", F.lit(None).cast("string").alias("_source"), F.lit(1).alias("level"))).otherwise(F.struct(F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_source"), F.lit(2).alias("level")))
    chosen = stored(sizes.join(by_lang, F.col("_lang").eqNullSafe(F.col("_l"))).select("_lang", "_source", level.alias("grp")), "quality-levels")
    levels = [r[0] for r in chosen.select("grp.level").distinct().collect()]  # at most three
    kind = {0: F.struct("_lang", "_source", F.lit(0).alias("level")), 1: F.struct("_lang", F.lit(None).cast("string").alias("_source"), F.lit(1).alias("level")), 2: F.struct(F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_source"), F.lit(2).alias("level"))}
    wanted = F.array(*[kind[k] for k in sorted(levels)]) if levels else F.array(kind[0])
    rows = stored(good.select(F.explode(wanted).alias("grp"), *X), "quality-vectors")
    stats = _with(chosen.select("_lang", "_source", "grp"), mcd(rows))
    out = described
    for x, n in zip(transformed(), X, strict=True):
        out = out.withColumn(n, x)
    stats = stored(stats.withColumnRenamed("_lang", "_l").withColumnRenamed("_source", "_s").drop("grp"), "quality-estimates")
    discard(rows)
    out = _distance(joined_small(out, stats, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left"))
    out = out.withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= reject))
    return out.select("_own.*", *BASE, "d2", "kept")


def filtered(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The documents that judge keeps, in their own columns; each row is judged by itself, whatever its identifier."""
    rows = keyed(docs, "quality-rows")
    judged = judge(rows.select(ROW, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), **how)
    return rows.join(judged.filter("kept").select(ROW), ROW, "left_semi").select(docs.columns)
