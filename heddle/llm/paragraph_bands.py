"""Near-duplicate paragraphs by MinHash banding, and passages that repeat inside paragraphs or across their ends.

Documents are cut into paragraphs (lines with words). Bands are tuned to the wished recall at the threshold, colliding
paragraphs are joined and verified by exact Jaccard similarity of their five-word shingles, and removals are clustered by
connected components: the first paragraph of a component, by document and place, stays. A link counts if the larger of its
two sets has LEAST shingles (20 words without a repeat); shorter paragraphs repeat by chance or are set phrases.

A passage that two documents share leaves their paragraphs unlike each other as wholes, and may begin in one paragraph and
end in another. Passages are therefore taken from the documents' words whatever the paragraphs: windows of PASSAGE words,
each starting where a key of three words is the least among REACH starts. Which windows of a run of words are taken depends
on that run alone, so documents that share PASSAGE + REACH - 1 = 50 words or more have a window in common wherever the run
stands in them; consecutive windows overlap, so they cover the run but for its ends. Windows with the same words (A-Z
lower-cased), by 96 bits of hashes, are one group, whose first stays. Windows that touch a removed paragraph are left out
first, so what stays of a group is whole; overlapping windows of a document are reported as one passage.

Null and empty texts have no paragraphs. Rows with the same identifier and text count once, and rows without an identifier
count as one document; `dedup` gives each row a key of its own. Texts of any length are cut in stretches, ties go to the
first place, and an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from heddle.llm.common import ROW, WORD, discard, joined_small, keyed, row_id, stored, text_or_empty
from heddle.llm.near import SHINGLE, SIMILAR, Bands, classes

RECALL, LEAST = 0.999, 16
#: Words of a window, and starts that a window's key is the least of.
PASSAGE, REACH = 26, 25
#: Odd multipliers of the three words' hashes in a key.
KEY = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
#: Words whose hashes a task keeps.
CACHE = 500_000
#: Words that are looked at together; places must fit the low 24 bits.
STRETCH = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_POLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_WORD = re.compile(WORD)


def tuned(similarity: float = SIMILAR / 100, recall: float = RECALL, rows: int = 2) -> Bands:
    """The fewest bands of so many rows that miss no more than 1 - recall of the pairs at the threshold."""
    return Bands(math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows, parity=4, few=8)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (doc, paragraph) and text of the paragraphs with words."""
    split = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_or_empty(text_col), "\n")).alias("paragraph", "text"))
    return split.filter(F.col("text").rlike(WORD)).select(F.struct("doc", "paragraph").alias("id"), "text")


class _Hashes(dict):
    """64 bits of the md5 of each lower-cased word, which SQL can make too."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.md5(word).digest()[:8])
        return h


def _least(low: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours."""
    m = 1
    while 2 * m <= width:
        low, m = np.minimum(low[:-m], low[m:]), 2 * m
    return np.minimum(low[: -(width - m)], low[width - m :]) if width > m else low


def _powers(base: np.uint64) -> list[np.uint64]:
    out = [np.uint64(1)]
    with np.errstate(over="ignore"):
        for _ in range(PASSAGE - 1):
            out.append(out[-1] * base)
    return out


def windows(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen windows of stretches (row, words before it, word hashes): row, start, and two hashes of each."""
    h = np.concatenate([x for *_, x in held])
    ends = np.cumsum([len(x) for *_, x in held])
    begins = ends - [len(x) for *_, x in held]
    starts = ends - begins - PASSAGE + 1
    key = h[:-2] * np.uint64(KEY[0]) + h[1:-1] * np.uint64(KEY[1]) + h[2:] * np.uint64(KEY[2])
    # The last words of a stretch start no window; a stretch with fewer than REACH starts has one least key.
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + starts, -1)
    opens = np.flatnonzero(np.cumsum(edge[: len(key)]) > 0)
    low = np.full(len(h) + REACH, ~np.uint64(0))
    low[opens] = (key[opens] & ~_LOW) | opens.astype(np.uint64)
    edge[:] = 0
    np.add.at(edge, begins, 1)
    np.add.at(edge, begins + np.maximum(starts - REACH + 1, 1), -1)
    least = _least(low, REACH)[: len(h)]
    at = (np.unique(least[np.cumsum(edge[: len(least)]) > 0]) & _LOW).astype(np.int64)
    first, second = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j, (x, y) in enumerate(zip(*map(_powers, _POLY), strict=True)):
        word = h[at + j]
        first += word * x
        second += (word ^ (word >> np.uint64(29))) * y
    piece = np.searchsorted(ends, at, side="right")
    row, start = np.array([r for r, *_ in held])[piece], at - begins[piece] + np.array([x for _, x, _ in held])[piece]
    order = np.lexsort((start, row))
    row, start, first, second = row[order], start[order], first[order] ^ (first[order] >> np.uint64(32)), second[order] ^ (second[order] >> np.uint64(32))
    # Stretches overlap; and a window with the words of the one before it, and overlapping it, is a period and adds nothing.
    same = (row[1:] == row[:-1]) & ((start[1:] == start[:-1]) | ((first[1:] == first[:-1]) & (second[1:] == second[:-1]) & (start[1:] - start[:-1] < PASSAGE)))
    new = np.concatenate([[True], ~same]) if len(row) else np.empty(0, bool)
    return row[new], start[new], first[new], second[new]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, start (words before it), the paragraphs p0 to p1 that it touches, words of p0 before it, and h, g (its words' hashes) of the chosen windows."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc", "start", "p0", "p1", "inside", "h", "g"]

    def made(ids: pa.Array, held: list, upto: dict[int, np.ndarray]) -> pa.RecordBatch:
        row, at, h, g = windows(held)
        p0, p1, inside = (np.empty(len(row), np.int32) for _ in range(3))
        edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]]))
        for i, j in zip(edges, edges[1:], strict=False):
            ends = upto[int(row[i])]
            p0[i:j], p1[i:j] = (np.searchsorted(ends, at[i:j] + d, side="right") for d in (0, PASSAGE - 1))
            inside[i:j] = at[i:j] - np.concatenate([[0], ends])[p0[i:j]]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(p0), pa.array(p1), pa.array(inside), pa.array(h.view(np.int64)), pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            held, size, upto = [], 0, {}
            for r in range(b.num_rows):
                lines = [x.split() for x in b.column(1)[r].as_py().encode("utf-8", "replace").lower().split(b"\n")]
                ends = np.cumsum([len(x) for x in lines])
                n = int(ends[-1])
                if n < PASSAGE:
                    continue
                upto[r] = ends
                h = np.fromiter(map(hashes.__getitem__, itertools.chain.from_iterable(lines)), np.uint64, n)
                for base in range(0, max(1, n - PASSAGE - REACH + 2), STRETCH):
                    held.append((r, base, h[base : base + STRETCH + PASSAGE + REACH - 2]))
                    size += len(held[-1][2])
                    if size >= STRETCH:
                        yield made(b.column(0), held, upto)
                        held, size = [], 0
            if held:
                yield made(b.column(0), held, upto)

    return docs.select(F.col(id_col).alias("doc"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc {kind}, start int, p0 int, p1 int, inside int, h long, g int")


def _untouched(found: DataFrame, gone: DataFrame) -> DataFrame:
    """The windows that touch no removed paragraph (doc, paragraph): one pass over each document's own rows in order."""
    rows = found.withColumn("at", F.col("p1")).withColumn("removed", F.lit(None).cast("int"))
    lines = gone.select("doc", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns if c != "doc"], F.col("paragraph").alias("at"), F.col("paragraph").alias("removed"))
    upto = W.Window.partitionBy("doc").orderBy("at", F.col("removed").asc_nulls_last()).rowsBetween(W.Window.unboundedPreceding, 0)
    swept = rows.unionByName(lines).withColumn("last", F.max("removed").over(upto))
    return swept.filter(F.col("h").isNotNull() & (F.col("last").isNull() | (F.col("last") < F.col("p0")))).select(found.columns)


def repeated_passages(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages that repeat outside the removed paragraphs `gone` (doc, paragraph).

    doc, at (words before it), place (paragraph, words of it before), length (words), kept, first (doc, at, paragraph, words) and members.
    """
    every = stored(passages(docs, id_col, text_col), "passages")
    shared = every.groupBy(F.col("h").alias("_h")).agg(F.count("*").alias("n")).filter("n > 1").select("_h")
    twice = stored(every.join(shared, F.col("h") == F.col("_h"), "left_semi").distinct(), "passages-repeated")
    discard(every)
    left = stored(_untouched(twice, gone), "passages-left")
    place = F.struct("doc", "start", "p0", "inside")
    groups = left.groupBy(F.col("h").alias("_h"), F.col("g").alias("_g")).agg(F.min(place).alias("first"), F.count("*").alias("members")).filter("members > 1")
    found = left.join(groups, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).withColumn("kept", place.eqNullSafe(F.col("first")))
    line = W.Window.partitionBy("doc", "kept").orderBy("start")
    opens = F.coalesce((F.col("start") > F.lag("start").over(line) + PASSAGE).cast("int"), F.lit(1))
    runs = found.withColumn("_open", opens).withColumn("run", F.sum("_open").over(line.rowsBetween(W.Window.unboundedPreceding, 0)))
    out = runs.groupBy("doc", "kept", "run").agg(F.min("start").alias("at"), F.min_by(F.struct("p0", "inside"), "start").alias("place"), (F.max("start") - F.min("start") + PASSAGE).cast("int").alias("length"), F.min_by("first", "start").alias("first"), F.max("members").alias("members"))
    out = stored(out.drop("run"), "passages-found")
    discard(twice, left)
    return out


def _all_repeats(docs: DataFrame, id_col: str, text_col: str, recall: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with a near copy, and passages of the rest with an exact one."""
    found = stored(classes(paragraphs(docs, id_col, text_col), tuned(recall=recall), least=least).select("id", "words", "n", "comp").distinct(), "paragraph-classes")
    several = found.groupBy(F.col("comp").alias("_comp")).agg(F.count("*").alias("members"), F.max("n").alias("largest")).filter((F.col("members") > 1) & (F.col("largest") >= least)).drop("largest")
    lines = stored(joined_small(found, several, F.col("comp") == F.col("_comp")).drop("_comp").withColumn("kept", F.col("id").eqNullSafe(F.col("comp"))), "paragraph-repeats")
    discard(found)
    return lines, repeated_passages(docs, lines.filter("not kept").select("id.doc", "id.paragraph"), id_col, text_col)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, least: int = LEAST) -> DataFrame:
    """A row per paragraph that has a near copy, and per passage of the rest that has an exact one.

    id_col, kind (paragraph or passage), paragraph and start (words of the paragraph before it), length (words; a passage
    may run past its paragraph's end), n_shingles (distinct ones of a paragraph, all of a passage), keep_doc_id,
    keep_paragraph and keep_start (where the copy that stays is), members (of the component or the largest group), kept.
    """
    lines, parts = _all_repeats(docs, id_col, text_col, recall, least)
    names = [id_col, "kind", "paragraph", "start", "length", "n_shingles", "keep_doc_id", "keep_paragraph", "keep_start", "members", "kept"]
    whole = lines.select("id.doc", F.lit("paragraph"), "id.paragraph", F.lit(0), "words", "n", "comp.doc", "comp.paragraph", F.lit(0), "members", "kept").toDF(*names)
    shingles = (F.col("length") - SHINGLE + 1).cast("long")
    return whole.union(parts.select("doc", F.lit("passage"), "place.p0", "place.inside", "length", shingles, "first.doc", "first.p0", "first.inside", "members", "kept").toDF(*names))


def without(text: str, paragraphs_: set[int], spans: list[tuple[int, int, bool]]) -> str:
    """A text without whole paragraphs and without the words of spans (start, length, kept) that are not in a kept one."""
    gone, first = [], 0
    for number, line in enumerate(text.split("\n")):
        if number in paragraphs_:
            gone.append((first, first + len(line) + 1))
        first += len(line) + 1
    if spans:
        words = [m.span() for m in _WORD.finditer(text)]
        mark = bytearray(len(words))
        for start, length, kept in sorted(spans, key=lambda x: x[2]):
            mark[start : start + length] = (b"\0" if kept else b"\1") * length
        gone += [(words[m.start()][0], words[m.end() - 1][1]) for m in re.finditer(b"\1+", bytes(mark))]
    out, at = [], 0
    for a, b in sorted(gone):
        out.append(text[at : max(at, a)])
        at = max(at, b)
    left = "".join([*out, text[at:]])
    # The last paragraph has no line end of its own.
    return left.removesuffix("\n") if paragraphs_ and not text.endswith("\n") and at >= len(text) else left


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 1, recall: float = RECALL, least: int = LEAST) -> DataFrame:
    """The documents without their removed paragraphs, and without removed passages of least_words words or more, in their own columns.

    A removed paragraph goes with its line end. Each row is judged by itself: identifiers may be null or repeat.
    """
    rows = keyed(docs, "paragraph-rows")
    lines, parts = _all_repeats(rows.select(row_id(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text", recall, least)
    gone = lines.filter("not kept").select(F.col("id.doc.row").alias(ROW), F.col("id.paragraph").alias("whole"), F.lit(None).alias("span"))
    span = F.struct("at", "length", "kept")
    spans = parts.filter(F.col("kept") | (F.col("length") >= least_words)).select(F.col("doc.row").alias(ROW), F.lit(None).cast("int"), span)
    lists = gone.withColumn("span", F.lit(None).cast(spans.schema[2].dataType)).union(spans).groupBy(ROW).agg(F.collect_set("whole").alias("_whole"), F.collect_list("span").alias("_spans"))

    @F.udf("string")
    def left(text, gone, parts):
        return text if text is None or gone is None else without(text, set(gone), [tuple(x) for x in parts])

    return rows.join(lists, ROW, "left").withColumn(text_col, F.when(F.col("_whole").isNull(), F.col(text_col)).otherwise(left(text_col, "_whole", "_spans"))).select(docs.columns)
