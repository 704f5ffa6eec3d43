"""Training samples of a workspace: five sources, a filter by confidence, greedy removal of near repeats, and two formats.

Samples are rows (id, kind: positive or negative, instruction, input, output, source, confidence). Their identifiers hold the
source's number in the high bits and the source's own key in the low ones, so they order samples by source, and then by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators import pairs
from heddle.operators.spectral import term_vector

#: Confidence of a sample at least, and similarity from which a later sample repeats an earlier one.
LEAST, SAME = 0.6, 0.92
# The instructions of the sources.
INSTRUCTIONS = {
    "decision_reflection": "Analyze the following decision and provide a reflection on its outcome.",
    "debate_synthesis": "Synthesize a balanced analysis of the following question, considering multiple perspectives.",
    "peer_review": "Review the following content and provide constructive feedback.",
    "red_team": "Defend against the following adversarial challenge.",
    "experience_reflection": "Extract actionable insights from the following experience.",
}
SOURCES = list(INSTRUCTIONS)
#: Bits of a source's own keys.
KEY_BITS = 44
#: What lies between the words of a term vector.
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _rows(source: str, rows: DataFrame, key: Column, input_: Column, output: Column, confidence: Column, kind: Column | None = None) -> DataFrame:
    number = F.lit(SOURCES.index(source)).cast("long")
    return rows.select(
        (F.shiftleft(number, KEY_BITS) + key.cast("long")).alias("id"), (F.lit("positive") if kind is None else kind).alias("kind"), F.lit(INSTRUCTIONS[source]).alias("instruction"),
        input_.alias("input"), output.alias("output"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"),
    )


def decisions(rows: DataFrame) -> DataFrame:
    """Of resolved decisions (key, content, outcome, reflection); a failure is a negative sample."""
    sure = F.when(F.col("outcome") == "success", 0.9).when(F.col("outcome") == "partial", 0.7).otherwise(0.4)
    return _rows("decision_reflection", rows, F.col("key"), F.col("content"), F.col("reflection"), sure, F.when(F.col("outcome") == "failure", "negative").otherwise("positive"))


def debates(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """Of debates (key, query, verdict, convergence) that came to agree."""
    return _rows("debate_synthesis", rows.filter(F.col("convergence") >= least), F.col("key"), F.col("query"), F.col("verdict"), F.col("convergence"))


def reviews(rows: DataFrame) -> DataFrame:
    """Of accepted reviews (key, content, feedback, accepted)."""
    return _rows("peer_review", rows.filter("accepted"), F.col("key"), F.col("content"), F.col("feedback"), F.lit(0.8))


def red_teams(rows: DataFrame, least: float = 0.7) -> DataFrame:
    """Of challenges (key, attack, defense, resilience) that were withstood: the defense, and the attack as its rejected twin."""
    held = rows.filter(F.col("resilience") > least)
    good = _rows("red_team", held, 2 * F.col("key"), F.col("attack"), F.col("defense"), F.col("resilience"))
    return good.union(_rows("red_team", held, 2 * F.col("key") + 1, F.col("attack"), F.col("attack"), 1 - F.col("resilience"), F.lit("negative")))


def experiences(rows: DataFrame) -> DataFrame:
    """Of stored states (key, data: JSON with insight, context, utility); what is no such JSON gives no sample."""
    s = F.from_json("data", "insight string, context string, utility double")
    read = rows.select("key", s.alias("s")).filter("s.insight <> '' and s.context <> ''")
    return _rows("experience_reflection", read, F.col("key"), F.col("s.context"), F.col("s.insight"), F.coalesce("s.utility", F.lit(0.7)))


def collected(parts: list[DataFrame], least: float = LEAST) -> DataFrame:
    """All samples that are sure enough."""
    return reduce(DataFrame.unionByName, parts).filter(F.col("confidence") >= least)


def distinct(samples: DataFrame, same: float = SAME) -> DataFrame:
    """Samples without those whose instruction and input are similar to an earlier kept one's, by term vectors.

    Of samples with one text the first stands for all, so a vector is made for each different text only; texts without a word repeat nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([term_vector(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["id", "v"])

    asked = samples.select("id", F.concat_ws(" ", "instruction", F.coalesce("input", F.lit(""))).alias("text"))
    firsts = asked.groupBy("text", F.when(F.col("text").rlike(f"^{_SPACE}*$"), F.col("id"))).agg(F.min("id").alias("id")).select("id", "text")
    kept = pairs.novel(firsts.mapInArrow(run, "id long, v array<double>"), same, id_col="id", vector_col="v").filter("accepted").select("id")
    return samples.join(kept, "id", "left_semi")


def instructed(samples: DataFrame) -> DataFrame:
    """instruction, input, output of the positive samples, with their id."""
    return samples.filter("kind = 'positive'").select("id", "instruction", "input", "output")


def contrasted(samples: DataFrame) -> DataFrame:
    """prompt, chosen, rejected: each negative sample with the first positive one of its source, if there is one."""
    first = samples.filter("kind = 'positive'").groupBy("source").agg(F.min_by("output", "id").alias("chosen"))
    # A row a source.
    return samples.filter("kind = 'negative'").join(F.broadcast(first), "source").select("id", F.concat_ws("\n", "instruction", "input").alias("prompt"), "chosen", F.col("output").alias("rejected"))


def write(samples: DataFrame, path: str, least: float = LEAST, same: float = SAME) -> None:
    """Filter, remove repeats, and write both formats as JSON lines with a manifest; a folder each, so no task gathers them."""
    from heddle.sources.scratch import discard, stored

    left = stored(distinct(samples.filter(F.col("confidence") >= least), same), "dataset-samples")
    instructed(left).drop("id").write.mode("overwrite").json(f"{path}/sft.jsonl")
    contrasted(left).drop("id").write.mode("overwrite").json(f"{path}/dpo.jsonl")
    counts = left.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "positive").alias("positive"))
    facts = counts.agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("sources"), F.coalesce(F.sum("positive"), F.lit(0)).alias("sft"))
    facts = facts.crossJoin(contrasted(left).agg(F.count("*").alias("dpo")))  # one row each
    facts.select("sft", "dpo", "sources", F.lit(least).alias("min_confidence"), F.lit(same).alias("deduplication_threshold"), F.array(F.lit("sft.jsonl"), F.lit("dpo.jsonl")).alias("files")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest.json")
    discard(left)
