"""Predicates and small plans of memory recall: pages, symbolic filters, patches, query heuristics, compression."""

from __future__ import annotations

import operator
import re
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Hours that a relative time bucket reaches back.
BUCKETS = {"recent": 24, "last_week": 7 * 24, "last_month": 30 * 24}
#: Confidence of a unit that states none.
CONFIDENCE = 0.5
# Words that no keyword query keeps.
STOP_WORDS = tuple(
    "the a an is are was were be been have has had do does did will would could should may might can shall to of in for on with at by from as into about "
    "what which who when where how why that this it they them its and or but not no so if then than very just also".split()
)
# Words that mark greetings, vague questions, and questions after one thing or after a theme.
FILLER = r"(?i)^(hey|hi|hello|thanks|thank you|ok|okay|sure|yes|no|bye|goodbye|great|nice|wow|cool|right|hm+|ah+|oh+|well)([^A-Za-z0-9_]|$)"
VAGUE, EXACT = r"(?i)(better|best|should|how|what if)", r"(?i)(specific|exact|list)"
LOW = r"(^|[^a-z0-9_])(who|which|where|when|what is|name|date|how many|how much|between)($|[^a-z0-9_])"
HIGH = r"(^|[^a-z0-9_])(theme|summary|overview|trend|compare|general|main|overall|what are the|describe)($|[^a-z0-9_])"
MANY_HOPS = r"(?i)compare|contrast|relationship|between|timeline|history|all|every"


def search(units: DataFrame, words: str, text_col: str = "content") -> DataFrame:
    """Units whose text holds the words, whatever their case."""
    return units.filter(F.lower(F.coalesce(text_col, F.lit(""))).contains(words.lower()))


def matching(rows: DataFrame, text: str, columns: list[str], labels: list[str] | None = None) -> DataFrame:
    """Rows with the text, taken literally and whatever its case, in any column, and one of the labels if any are given."""
    hit = reduce(lambda a, b: a | b, [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in columns])
    return rows.filter(hit & F.col("label").isin(*labels) if labels else hit)


def symbolic(units: DataFrame, now: str, bucket: str, entities: list[str], least: float, kinds: list[str], top: int = 10, weight: float = 0.2) -> DataFrame:
    """id, confidence, score, rank: recent enough units of the kinds that name one of the entities, the most confident first."""
    sure = F.coalesce("confidence", F.lit(CONFIDENCE))
    rows = units.filter(F.col("kind").isin(*kinds) & (sure >= least) & F.arrays_overlap(F.transform("entities", F.lower), F.array(*[F.lit(e.lower()) for e in entities])))
    if bucket in BUCKETS:
        until = F.lit(now).cast("timestamp_ntz")
        rows = rows.filter((F.col("ts") <= until) & (F.col("ts") >= until - F.make_dt_interval(hours=F.lit(BUCKETS[bucket]))))
    best = rows.select("id", sure.alias("confidence"), F.round(sure * weight, 6).alias("score")).orderBy(F.desc("confidence"), "id").limit(top)
    return best.withColumn("rank", F.row_number().over(W.Window.orderBy(F.desc("confidence"), "id")))  # at most `top` rows


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """rows with the columns of patch (key, some of rows' columns) where those are not null."""
    new = patch.select(key, *[F.col(c).alias(f"_{c}") for c in patch.columns if c != key])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c != key and c in patch.columns else F.col(c) for c in rows.columns])


def related(units: DataFrame, relations: DataFrame) -> DataFrame:
    """id, targets, kinds: each unit with what its relations (src, dst, type) lead to, in order; units without any have none."""
    lists = relations.groupBy(F.col("src").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("dst", "type"))).alias("r"))
    r = F.coalesce("r", F.array().cast("array<struct<dst:bigint,type:string>>"))
    return units.join(lists, F.col("id") == F.col("_id"), "left").select("id", F.array_join(F.transform(r, lambda x: x["dst"].cast("string")), ",").alias("targets"), F.array_join(F.transform(r, lambda x: x["type"]), ",").alias("kinds"))


def sentences(text, least: int = 1) -> Column:
    """Sentences of a text, cut after . ! ? and at line ends, trimmed; those under `least` characters are left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t\r\n\f]+|[\n\r]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")), lambda s: F.length(s) >= least)


def compressed(units: DataFrame, share: float = 0.5, least: int = 10, text_col: str = "content") -> DataFrame:
    """id, sentences, kept, text: the sentences with most words over two letters, fillers last, in their own order.

    Texts of at most two sentences stay. Equal sentences stay together. A unit's sentences are ranked inside its row.
    """
    df = units.select("id", F.col(text_col).alias("_text"), sentences(F.col(text_col), least).alias("s"))
    words = lambda x: F.size(F.filter(F.split(x, r"[ \t\r\n\f]+"), lambda w: F.length(w) > 2))
    score = lambda x: F.when(x.rlike(FILLER), F.lit(0)).otherwise(words(x))
    ranked = F.array_sort(F.transform("s", lambda x, i: F.struct((-score(x)).alias("low"), i.alias("at"), x.alias("x"))))
    target = F.ceil(F.size("s") * share).cast("int")
    top = F.transform(F.slice(ranked, F.lit(1), F.greatest(target, F.lit(1))), lambda r: r["x"])
    df = df.withColumn("top", top)
    kept = F.filter("s", lambda x: F.array_contains("top", x))
    short = F.size("s") <= 2
    return df.select("id", F.size("s").alias("sentences"), F.when(short, F.size("s")).otherwise(F.size(kept)).alias("kept"), F.md5(F.when(short, F.coalesce("_text", F.lit(""))).otherwise(F.array_join(kept, " ")).cast("binary")).alias("text"))


def scored_sentences(units: DataFrame, least: int = 10, text_col: str = "content") -> DataFrame:
    """id, at, sentence, score: sentences in order, scored by their words over two letters, fillers 0: a stand-in for a model's scores."""
    s = units.select("id", F.posexplode(sentences(F.col(text_col), least)).alias("at", "sentence"))
    words = F.size(F.filter(F.split("sentence", r"[ \t\r\n\f]+"), lambda w: F.length(w) > 2))
    return s.withColumn("score", F.when(F.col("sentence").rlike(FILLER), 0).otherwise(words))


def above_percentile(scored: DataFrame, share: float = 0.5) -> DataFrame:
    """id, sentences, kept, text of scored sentences (id, at, sentence, score): those that reach the score at the place floor(n (1 - share)) of the ascending ones.

    The place is found by counts of scores, a row a score, so a unit's sentences are never sorted as a whole.
    """
    counts = scored.groupBy("id", "score").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.Window.partitionBy("id").orderBy("score"))
    whole = F.sum("_n").over(W.Window.partitionBy("id"))
    # In decimals: 0.7 as a binary fraction is a little less, and 90 times it would fall short of 63.
    place = F.least(F.floor(whole.cast("decimal(20,0)") * F.lit(1 - Decimal(str(share)))).cast("long"), whole - 1)
    limits = counts.withColumns({"_upto": upto, "_place": place}).filter("_upto > _place").groupBy("id").agg(F.min("score").alias("_limit"))
    rows = scored.join(limits, "id").withColumn("_in", F.col("score") >= F.col("_limit"))
    kept = F.array_sort(F.collect_list(F.when(F.col("_in"), F.struct("at", "sentence"))))
    return rows.groupBy("id").agg(F.count("*").alias("sentences"), F.count_if("_in").alias("kept"), F.array_join(F.transform(kept, lambda r: r["sentence"]), " ").alias("text"))


_CONDITION = re.compile(r"^([A-Za-z_]\w*)\s*(>=?|<=?|==|!=)\s*([\d.]+)$")
_COMPARED = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def routed(metrics: dict[str, Column], routes: dict[str, str]) -> Column:
    """The first route whose condition holds: `metric OP number`, or a metric's name alone for over 0.5; a missing or null metric is 0.

    "default" is taken where no condition holds, null where there is none.
    """
    out = F.lit(routes.get("default")).cast("string")
    for condition, to in reversed([x for x in routes.items() if x[0] != "default"]):
        found = _CONDITION.match(condition)
        name, op, limit = found.groups() if found else (condition, ">", "0.5")
        value = F.coalesce(metrics[name].cast("double"), F.lit(0.0)) if name in metrics else F.lit(0.0)
        out = F.when(_COMPARED[op](value, float(limit)), to).otherwise(out)
    return out


def dense(windows: DataFrame, text_col: str, sentences_: int = 2, over: int = 15) -> DataFrame:
    """Windows that hold at least so many sentences of more than `over` characters."""
    long = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[.!?]+"), lambda s: F.length(F.trim(s)) > over)
    return windows.filter(F.size(long) >= sentences_)


def dated(text) -> Column:
    """The first ISO date (with a time, if it has one) of a text, null without one."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2})?)?", 0)
    return F.when(found != "", found)


def depth(query, least: int = 3, most: int = 20) -> Column:
    """How deep a question's retrieval goes: many hops, several names, or many words go deeper."""
    words = F.size(F.split(query, r"[ \t\r\n\f]+"))
    names = F.regexp_count(query, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?![A-Za-z0-9_])"))
    return F.when(query.rlike(MANY_HOPS) | (names > 1), min(most, 15)).when(words > 10, 8).when(words > 5, 5).otherwise(least)


def keywords(query) -> Column:
    """A question's words of three letters or more without stop words, joined by blanks."""
    words = F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9 \t\r\n\f]", ""), r"[ \t\r\n\f]+")
    return F.array_join(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)), " ")


def level(query) -> Column:
    """low for questions after one thing, high for those after a theme, hybrid for both or neither."""
    low, high = F.lower(query).rlike(LOW), F.lower(query).rlike(HIGH)
    return F.when(low & high, "hybrid").when(low, "low").when(high, "high").otherwise("hybrid")


def fuzzy(query) -> Column:
    """Whether a question is too vague to answer without asking back."""
    return (F.length(query) < 20) | (query.rlike(VAGUE) & ~query.rlike(EXACT))


def translations(questions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_col, technique, query: each question as the templates of the techniques turn it."""
    q = F.col(text_col)
    made = [
        ("hyde", F.concat(F.lit("Hypothetical document: "), q, F.lit(" explained in detail with examples."))),
        ("multi_query", F.concat(q, F.lit(" pros and cons"))),
        ("multi_query", F.concat(q, F.lit(" implementation details"))),
        ("step_back", F.concat(F.lit("What is the broader context of: "), q)),
        ("query_rewriting", F.concat(F.lit("Detailed explanation of: "), q)),
        ("intent_clarification", F.concat(F.lit("The user wants to know: "), q)),
    ]
    return questions.select(id_col, F.explode(F.array(*[F.struct(F.lit(t).alias("technique"), x.alias("query")) for t, x in made])).alias("m")).select(id_col, "m.technique", "m.query")
