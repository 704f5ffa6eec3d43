"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are rates of a text: lexicon hits (a fixed word list, and words and word beginnings learned from labelled rows),
hits close to a second-person pronoun, disguised hits, capitals and punctuation. The trees give a raw score, and an
isotonic fit on rows that the trees have not seen makes it the chance of the label.

Learning takes a bounded sample of labelled rows (ROWS), in parts by the identifier's checksum mod 5: parts 1 and 2 give
the lexicon, part 3 the trees, part 4 the calibration; part 0 is held out. The lexicon keeps TERMS terms at most. All rows
are scored, from their whole text only.

Null text is empty, and empty texts have a score like others; very long texts count as a whole. Terms that mark toxic texts
equally well are kept in the order of their letters, and equal texts have equal scores. If a part has only one label, the
calibrated score is the share of toxic rows. Null identifiers are never learned from; repeated labels count as rows. An empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ROW, held_out, keyed, stored, text_or_empty

#: Labelled rows that the model is learned from, and terms that the learned lexicon keeps.
ROWS, TERMS = 30_000, 3_000
#: Boosting rounds and depth of the trees.
ROUNDS, DEPTH = 20, 3
#: Words between a hit and a pronoun that still count as close.
NEAR = 3
#: Word beginnings that the lexicon learns, by length.
STEMS = (4, 5, 6)
# Insults in four languages.
INSULTS = frozenset(
    "idiot idiots moron morons loser losers stupid pathetic worthless disgusting scum trash clown clowns dumb fool fools jerk garbage vermin filth "
    "dumm dummkopf abschaum versager wertlos ekelhaft erbärmlich trottel müll depp "
    "idiote stupide imbécile minable ordure déchet débile crétin dégoûtant pathétique "
    "idiota estúpido estúpida imbécil patético basura escoria payaso asqueroso inútil".split()
)
# Second-person pronouns in four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
# Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
_WORDS = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?:[^\W\d_]+[0-9@$!]+|[0-9@$]+)[^\W\d_][\w@$!]*")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SPELLED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*]){3,}[^\W\d_]?")
_UPPER = bytes(range(65, 91))
FEATURES = ("length", "fixed", "learned", "learned_weight", "close", "pronouns", "disguised", "mixed", "stretched", "capitals", "shouted", "exclaimed", "asked", "symbols")


def terms(text: str) -> set[str]:
    """The words of a text and, with a star, their beginnings."""
    words = set(_WORDS.findall(text.lower()))
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


class _Weights(dict):
    """Lexicon weight of each word: the most of its own and its beginnings' weights, 0 if none is in the lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        of = self.lexicon.get
        self[word] = w = max(of(word, 0.0), *(of(f"{word[:k]}*", 0.0) if len(word) > k else 0.0 for k in STEMS))
        return w


def features(text: str, weights: _Weights) -> list[float]:
    low = text.lower()
    words = _WORDS.findall(low)
    n = max(1, len(words))
    hit = list(map(weights.__getitem__, words))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    learned = [i for i, x in enumerate(hit) if x]
    persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    close, hits = 0, {*fixed, *learned}
    if hits and persons:
        close = sum(any(i + d in hits for d in range(-NEAR, NEAR + 1)) for i in persons)
    mixed = _MIXED.findall(low)
    plain = [m.translate(DISGUISE) for m in mixed] + [re.sub(r"[^\w]|_", "", m) for m in _SPELLED.findall(low)]
    disguised = sum(w in INSULTS or weights[w] > 0 for w in plain)
    raw = text.encode("utf-8", "replace")
    letters = max(1, sum(map(len, words)))
    return [
        float(len(words)) ** 0.25,
        100 * len(fixed) / n,
        100 * len(learned) / n,
        100 * sum(hit) / n,
        100 * close / n,
        100 * len(persons) / n,
        100 * disguised / n,
        100 * len(mixed) / n,
        100 * len(_STRETCHED.findall(low)) / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / letters,
        sum(len(w) > 2 for w in re.findall(r"\b[A-Z]{3,}\b", text)) / n,
        100 * text.count("!") / n,
        100 * text.count("?") / n,
        100 * sum(map(text.count, "#*$%&|<>@")) / n,
    ]


def lexicon(rows: DataFrame) -> dict[str, float]:
    """Terms of rows (text, toxic) that mark toxic texts, by their log odds; counted over documents, on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = sorted(terms(text))
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array([label] * len(got), pa.int32())], ["term", "toxic"])

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, fine = size.get(1, 0), size.get(0, 0)
    if not bad or not fine:
        return {}
    counts = rows.select("toxic", "text").mapInArrow(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (fine + 1 - b))
    strong = counts.filter("a >= 3").withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b)).filter("odds >= 3 and z >= 2.5")
    return {r["term"]: float(r["odds"]) for r in strong.orderBy(F.col("z").desc(), "term").limit(TERMS).collect()}


def featured(rows: DataFrame, terms_: dict[str, float], keep: list[str]) -> DataFrame:
    """The columns `keep` of rows (.., text) with `features`, a vector."""
    shared = rows.sparkSession.sparkContext.broadcast(terms_)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value)
        for b in batches:
            made = pa.array([features(t, weights) for t in b.column(width).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(width)], made], [*keep, "dense"])

    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", dense array<double>"
    return rows.select(*keep, "text").mapInArrow(run, shape).withColumn("features", array_to_vector("dense")).drop("dense")


class Model:
    """A learned lexicon, trees and calibration; without trees, a constant score."""

    def __init__(self, terms_: dict[str, float], base: float, trees=None, curve=None):
        self.terms, self.base, self.trees, self.curve = terms_, base, trees, curve

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id_col, held_out, score, predicted."""
        rows = docs.select(id_col, held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("text"))
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(float(self.base)))
        else:
            scored = self.curve.transform(_raw(self.trees, featured(rows, self.terms, [id_col, "held_out"])))
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
        return scored.select(id_col, "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def _raw(trees, rows: DataFrame) -> DataFrame:
    return trees.transform(rows).withColumn("raw", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS) -> Model:
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("toxic"))
    share = rows / max(1, known.count())
    known = known.filter(F.pmod(F.xxhash64("_id", F.lit("labels")), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000))
    part = F.crc32(F.col("_id").cast("string").cast("binary")) % 5
    bounded = stored(docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(F.broadcast(known), F.col("id") == F.col("_id")).select("toxic", part.alias("part"), "text"), "toxic-rows")
    seen = {(r["part"], r["toxic"]): r["count"] for r in bounded.groupBy("part", "toxic").count().collect()}
    bad = sum(n for (_, y), n in seen.items() if y)
    base = bad / max(1, sum(seen.values()))
    terms_ = lexicon(bounded.filter("part in (1, 2)"))
    if not all(seen.get((p, y)) for p in (3, 4) for y in (0, 1)):
        return Model(terms_, base)
    rows_ = stored(featured(bounded.filter("part in (3, 4)"), terms_, ["toxic", "part"]), "toxic-features")
    # The features of a bounded sample fit in a few tasks; more would only add scheduling to each boosting round.
    trees = GBTClassifier(labelCol="toxic", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64, minInstancesPerNode=3).fit(rows_.filter("part = 3").coalesce(2))
    raw = _raw(trees, rows_.filter("part = 4")).select("raw", F.col("toxic").cast("double").alias("label"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw.coalesce(1))
    return Model(terms_, base, trees, curve)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, in their own columns; each row is judged by itself."""
    rows = keyed(docs, "toxic-keyed")
    bad = learn(docs, labels, id_col, text_col).score(rows, ROW, text_col).filter("predicted = 1").select(ROW)
    return rows.join(bad, ROW, "left_anti").select(docs.columns)
