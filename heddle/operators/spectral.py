"""Spectral chunking: elements of a document grouped by placement and meaning.

The affinity of two elements mixes the cosine of their vectors with 1 / (1 + distance) of their places, scaled to the unit
square of the document. The normalised Laplacian's largest eigengap gives the number of groups, and k-means on the rows of its
first eigenvectors (length 1) the groups; seeds are the rows farthest from each other, starting from the first. A group over the
token limit is divided the same way, or in halves where that leaves one group, until it fits or is one element.

A document's elements are taken in stretches of LIMIT consecutive places, so a task holds LIMIT elements of a document at a time
and their square of affinities, however long the document is: no chunk crosses a stretch, and a document of up to LIMIT elements
is chunked as a whole. Elements without words have a zero vector, and are grouped by placement. Places are whole numbers from 0,
each once in a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Elements chunked together, tokens of a chunk, share of meaning in the affinity, rounds of k-means, size of term vectors.
LIMIT, TOKENS, ALPHA, ROUNDS, TERMS = 300, 500, 0.5, 100, 64


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 1e-12)


def affinity(vectors: np.ndarray, places: np.ndarray, alpha: float) -> np.ndarray:
    apart = np.linalg.norm(places[:, None] - places[None], axis=2)
    w = alpha * np.clip(vectors @ vectors.T, 0, 1) + (1 - alpha) / (1 + apart)
    np.fill_diagonal(w, 0)
    return w


def laplacian(w: np.ndarray) -> np.ndarray:
    degree = w.sum(axis=1)
    root = np.divide(1, np.sqrt(degree), out=np.zeros_like(degree), where=degree > 0)
    return np.diag((degree > 0).astype(float)) - root[:, None] * w * root[None]


def groups_by_gap(values: np.ndarray, most: int, otherwise: int) -> int:
    """Place of the largest gap between ascending eigenvalues, of the first `most` gaps; the first of equal ones."""
    gaps = np.diff(values)[: min(most, len(values) - 1)]
    return int(np.argmax(np.round(gaps, 9))) + 1 if len(gaps) else max(1, otherwise)


def grouped(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means from seeds that lie farthest apart; a group that empties keeps its centre."""
    if k >= len(rows):
        return np.arange(len(rows))
    seeds = [0]
    near = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(seeds) < k:
        seeds.append(int(np.argmax(np.round(near, 9))))
        near = np.minimum(near, ((rows - rows[seeds[-1]]) ** 2).sum(axis=1))
    centres, label = rows[seeds].copy(), np.full(len(rows), -1)
    for _ in range(ROUNDS):
        new = np.argmin(np.round(((rows[:, None] - centres[None]) ** 2).sum(axis=2), 9), axis=1)
        if (new == label).all():
            break
        label = new
        for c in range(k):
            if (label == c).any():
                centres[c] = rows[label == c].mean(axis=0)
    return label


def clustered(at: np.ndarray, vectors: np.ndarray, places: np.ndarray, hint: int, alpha: float) -> list[np.ndarray]:
    """The elements `at` in groups, in the order of their first members."""
    if len(at) == 1:
        return [at]
    values, basis = np.linalg.eigh(laplacian(affinity(vectors[at], places[at], alpha)))
    k = groups_by_gap(values, min(len(at) - 1, 2 * hint), hint)
    label = grouped(_unit(basis[:, :k]), k)
    found = [at[label == c] for c in range(k)]
    return sorted((x for x in found if len(x)), key=lambda x: x[0])


def chunks_of(vectors: np.ndarray, places: np.ndarray, tokens: np.ndarray, most: int = TOKENS, alpha: float = ALPHA) -> list[np.ndarray]:
    """Groups of elements (their numbers), none over `most` tokens but single elements."""
    vectors = _unit(vectors)
    low, span = places.min(axis=0), np.ptp(places, axis=0)
    places = (places - low) / np.where(span > 0, span, 1)
    # A stack, for a document that falls apart in single elements would otherwise nest as deep.
    todo = clustered(np.arange(len(places)), vectors, places, max(1, -(-int(tokens.sum()) // most)), alpha)[::-1]
    out = []
    while todo:
        one = todo.pop()
        if tokens[one].sum() <= most or len(one) == 1:
            out.append(one)
            continue
        parts = clustered(one, vectors, places, 2, alpha)
        if len(parts) < 2:
            half = -(-len(one) // 2)
            parts = [one[:half], one[half:]]
        todo += parts[::-1]
    return out


def term_vector(text: str, size: int = TERMS) -> np.ndarray:
    """Counts of the lower-cased words, dealt to `size` places by their checksum: a stand-in where elements carry no vectors."""
    return np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % size for w in text.lower().split()], minlength=size).astype(float)


def chunked(elements: DataFrame, id_col: str = "doc_id", vector_col: str | None = None, most: int = TOKENS, alpha: float = ALPHA, limit: int = LIMIT) -> DataFrame:
    """id_col, chunk (its first place), order, place, tokens: every element (id_col, place, x, y, text) with its chunk and its place in reading order.

    alpha 1 groups by meaning alone, 0 by placement alone. Without vector_col, term vectors of the texts serve.
    """
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    meaning = F.transform(vector_col, lambda x: x.cast("double")) if vector_col else F.coalesce("text", F.lit(""))
    rows = elements.select(id_col, F.floor(F.col("place") / limit).alias("_stretch"), F.struct("place", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), tokens.alias("tokens"), meaning.alias("m")).alias("e"))
    packed = rows.groupBy(id_col, "_stretch").agg(F.array_sort(F.collect_list("e")).alias("rows")).select(id_col, "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at = b.column(1)[i].values
                m = at.field("m").to_pylist()
                if vector_col:
                    width = max((len(v) for v in m if v), default=1)
                    vectors = np.array([v if v and len(v) == width else [0.0] * width for v in m], float)
                else:
                    vectors = np.array([term_vector(t) for t in m])
                number = lambda c: at.field(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                places, size = np.column_stack([number("x"), number("y")]), number("tokens")
                made = chunks_of(np.nan_to_num(vectors), np.nan_to_num(places), size, most, alpha)
                order = np.concatenate(made)
                chunk = np.repeat([number("place")[x[0]] for x in made], [len(x) for x in made])
                same = pa.array([i] * len(order), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(same), *[pa.array(v, t) for v, t in ((chunk, pa.int32()), (number("place")[order], pa.int32()), (places[order, 0], pa.float64()), (places[order, 1], pa.float64()), (size[order], pa.int64()))]],
                    [id_col, "chunk", "place", "x", "y", "tokens"],
                )

    kind = elements.schema[id_col].dataType.simpleString()
    found = packed.mapInArrow(run, f"`{id_col}` {kind}, chunk int, place int, x double, y double, tokens long")
    # From top to bottom, then from left to right; a chunk has no more elements than a stretch.
    order = F.row_number().over(W.Window.partitionBy(id_col, "chunk").orderBy(F.floor(F.col("y") * 1e6), "x", "place"))
    return found.select(id_col, "chunk", order.alias("order"), "place", "tokens")


def assembled(found: DataFrame, elements: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, chunk, elements, tokens, text of the chunks, texts in reading order."""
    both = found.join(elements.select(id_col, "place", F.coalesce("text", F.lit("")).alias("text")), [id_col, "place"])
    rows = both.groupBy(id_col, "chunk").agg(F.count("*").alias("elements"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("order", "text"))).alias("rows"))
    return rows.select(id_col, "chunk", "elements", "tokens", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"))
