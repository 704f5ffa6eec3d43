"""Language identification by word-first backoff.

A known word scores its log frequency in each language. A word that no language knows falls back to its character
n-grams: the longest order of which a language has seen any gram of the word decides, down to single letters. Each word's
scores are centred over the languages, so words count alike whatever their frequency.

Words are runs of letters, in lower case. The model comes from a bounded sample of labelled rows (ROWS a language) and
keeps WORDS words and GRAMS n-grams a language, so what is broadcast does not grow with the input. Every row is
predicted from its whole text and from nothing else.

Null text, or text without a letter, is `und` with score 0, and so is every text if nothing was learned. Ties go to the
first language in order. Null identifiers are never learned from. Rows that repeat, and equal texts, are predicted alike, very
long texts by all of their words. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.llm.common import held_out

#: Labelled rows that a language is learned from, and what is kept of it.
ROWS, WORDS, GRAMS = 4_000, 50_000, 50_000
#: Longest character n-gram, a word's ends included.
ORDER = 5
#: Unknown words whose scores a task keeps.
CACHE = 100_000
_WORDS = re.compile(r"[^\W\d_]+")


def sampled(rows: DataFrame, by: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """About `most` rows of each value of `by`, chosen by a hash of the identifier: the same rows each time."""
    n = rows.groupBy(by).agg(F.count("*").alias("_n")).withColumnRenamed(by, "_by")
    return rows.join(F.broadcast(n), F.col(by) == F.col("_by")).filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(1_000_000)) * F.col("_n") < F.lit(most * 1_000_000)).drop("_n", "_by")


def _top(counts: DataFrame, term: str, most: int) -> DataFrame:
    order = W.Window.partitionBy("lang").orderBy(F.col("n").desc(), term)
    return counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def learn(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", rows: int = ROWS) -> dict:
    """The model: languages, and log frequencies by word and by n-gram."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = sampled(known.select(id_col, F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "lang", rows, id_col)
    words = known.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).cache()
    ends = F.concat(F.lit("^"), "word", F.lit("$"))

    def of_length(k: int) -> Column:
        # The function must have one parameter: a second one would be bound to the place in the array.
        starts = F.sequence(F.lit(1), F.length("ends") - k + 1)
        return F.when(F.length("ends") >= k, F.transform(starts, lambda i: F.substring("ends", i, F.lit(k)))).otherwise(F.array())

    spread = F.concat(*[of_length(k) for k in range(1, ORDER + 1)])
    grams = words.withColumn("ends", ends).select("lang", "n", F.explode(spread).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept_words, kept_grams = _top(words.filter("n > 1"), "word", WORDS).collect(), _top(grams, "gram", GRAMS).collect()
    total = {r["lang"]: r["t"] for r in words.groupBy("lang").agg(F.sum("n").alias("t")).collect()}
    words.unpersist()
    langs = sorted(total)
    at = {x: i for i, x in enumerate(langs)}

    def table(kept, scale) -> dict[str, np.ndarray]:
        """Log frequency of each term in each language, a term that a language lacks counting half a time; centred."""
        counts: dict[str, np.ndarray] = {}
        for lang, term, n in kept:
            counts.setdefault(term, np.full(len(langs), 0.5))[at[lang]] = n
        return {term: centred(np.log(c / scale)) for term, c in counts.items()}

    size = np.array([float(total[x]) for x in langs])
    by_order = [table([(r["lang"], r["gram"], r["n"]) for r in kept_grams if len(r["gram"]) == k], size) for k in range(1, ORDER + 1)]
    return {"langs": langs, "words": table([(r["lang"], r["word"], r["n"]) for r in kept_words], size), "grams": by_order}


def centred(x: np.ndarray) -> np.ndarray:
    """Log scores relative to the languages' mean, in single precision."""
    return (x - x.mean()).astype(np.float32)


class _Scores(dict):
    """Row number of each word in a growing table of scores: known words first, then unknown ones as they come."""

    def __init__(self, model: dict):
        super().__init__()
        self.model, self.known = model, model["words"]
        self.rows = np.zeros((1024, len(model["langs"])), np.float32)

    def __missing__(self, word: str) -> int:
        if len(self) == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[len(self)] = self.known[word] if word in self.known else self.backed_off(word)
        self[word] = at = len(self)
        return at

    def backed_off(self, word: str) -> np.ndarray:
        ends = f"^{word}$"
        for k in range(min(ORDER, len(ends)), 0, -1):
            grams = self.model["grams"][k - 1]
            seen = [grams[g] for g in (ends[i : i + k] for i in range(len(ends) - k + 1)) if g in grams]
            if seen:
                return np.mean(seen, axis=0)
        return np.zeros(self.rows.shape[1], np.float32)

    def of(self, text: str) -> np.ndarray | None:
        """The languages' scores, or None if the text has no letter."""
        if len(self) > CACHE:
            self.clear()
        words = _WORDS.findall(text.lower())
        if not text.isascii():
            words = [w for w in words if any(map(str.isalpha, w))]
        if not words:
            return None
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.rows[at].sum(axis=0, dtype=np.float64)


def predict_one(scores: _Scores, text: str | None) -> tuple[str, float]:
    s = scores.of(text) if text and scores.model["langs"] else None
    if s is None:
        return "und", 0.0
    best = int(np.argmax(s))
    return scores.model["langs"][best], float(1 / np.exp(s - s[best]).sum())


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score (the language's posterior under even priors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value)
        for b in batches:
            got = [predict_one(scores, t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
