"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so the plan is made from a histogram of at most `capacity` counts, whatever
the number of documents:

1. large lengths, in descending order, are cut into groups of equal cardinality and rounded up to the group's longest;
2. configurations of these few sizes are optimised as a cutting-stock programme by column generation, and rounded down;
3. actual lengths are substituted in their group's order, which splits the sequences into classes of equal content;
4. what the rounding left over, and then the small lengths, are placed by best fit into the gaps of the classes.

A class is a range of sequences with the same lengths at the same offsets, so a document finds its place from its length
and its rank within that length. Ranks are counted in buckets; no length gathers in one task.

Ids are those of the file's tokenizer. For speed they are made from its vocabulary by an own split and tiktoken; a text that
holds one of the file's added tokens, such as <|endoftext|>, is encoded by the tokenizer itself.

Null text is empty: it is the end token alone. Repeated rows are packed as often as they occur. Very long texts are encoded
whole, and cut into pieces. Pieces of one length are alike to the plan; a hash of identifier and piece, then their order, decides which of them takes which place.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import bucketed_total, stored, text_or_empty

CAPACITY, END = 1024, 2
#: Groups of equal cardinality, and the share of the capacity up to which a length is small.
GROUPS, SMALL = 1_024, 1 / 4
#: Limits tried for what a used configuration may leave of the capacity; below 0 none is used.
WASTE = (CAPACITY, 128, 64, 32, 16, 8, 4, 2, 1, 0, -1)
#: Words whose ids a task keeps.
CACHE = 500_000
BUCKET_ROWS = 20_000

# The split before the merges, for texts of these characters only: their letters, digits and blanks are the same to
# Python's re as to the vocabulary's own pattern. Other texts are split by the tokenizer itself.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_PLAIN = re.compile(f"[\\t-\\r\\x20-\\x7e{_LETTERS}¡-©«°´·»¿‐-‧‰-⁞€]*")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """An encoder with the vocabulary of a byte-level tokenizers file, and its cache from split words to packed ids."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(of[c] for c in word): i for word, i in vocab.items() if all(c in of for c in word) and not re.fullmatch(r"<\|.*\|>", word)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _added(path: str):
    """The file's own tokenizer, and a pattern of the added tokens that it takes out of a text before the split."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    names = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return tokenizer, re.compile("|".join(map(re.escape, names))) if names else None


class _Ids(dict):
    """Packed little-endian ids by split word; texts with an added token go to the file's tokenizer whole."""

    def __init__(self, path: str):
        super().__init__()
        self.encoder = _encoder(path)
        self.tokenizer, self.added = _added(path)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids = np.asarray(self.encoder.encode_ordinary(word), "<u4").tobytes()
        return ids

    def of(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _SPLIT.findall(text)))
        return np.asarray(self.encoder.encode_ordinary(text), "<u4").tobytes()


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(path)
        end = END.to_bytes(4, "little")
        for b in batches:
            rows, columns = [], ([], [], [], [])
            for r, text in enumerate(b.column(1).to_pylist()):
                body = ids.of(text) + end
                n = len(body) // 4
                at, to = 0, (n - 1) % capacity + 1
                while at < n:
                    for c, v in zip(columns, (len(columns[0]) and rows[-1] == r and columns[0][-1] + 1 or 0, at, to - at, zlib.crc32(body[4 * at : 4 * to])), strict=True):
                        c.append(v)
                    rows.append(r)
                    at, to = to, to + capacity
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32: the token sequences of the documents, longer ones cut; the first piece takes the odd length."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(_pieces(path, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _dearest(sizes: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth by prices: how much, and how many of each size. No more than three sizes fit together."""
    # The dearest size for each room, and the dearest two for the room that each size leaves.
    one, which = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.lexsort((-price, sizes))
    first = order[np.unique(sizes[order], return_index=True)[1]]
    one[sizes[first]], which[sizes[first]] = np.maximum(price[first], 0), np.where(price[first] > 0, first, -1)
    top = np.maximum.accumulate(one)
    which = which[np.maximum.accumulate(np.where((one == top) & (one > 0), np.arange(capacity + 1), 0))]
    room = capacity - sizes
    gain = np.where(room[:, None] >= sizes[None, :], price[None, :] + top[np.maximum(room[:, None] - sizes[None, :], 0)], 0)
    second = np.argmax(gain, axis=1)
    pair = gain[np.arange(len(sizes)), second]
    start = int(np.argmax(price + pair))
    pattern = np.zeros(len(sizes))
    left = capacity - sizes[start]
    pattern[start] += 1
    if pair[start] > 0:
        pattern[second[start]] += 1
        left -= sizes[second[start]]
        if which[left] >= 0:
            pattern[which[left]] += 1
    return float(price @ pattern), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional cutting-stock optimum by column generation: patterns (how many of each size) and their multiplicities.

    The basis is kept as its inverse, which a new pattern changes by one row. Sizes are over a quarter of the capacity. What
    rounding adds up to on the way costs worth, never a document: multiplicities are cut to what is left of each size.
    """
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, amount = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    least, gained = amount.sum(), 0
    for turn in range(1, 60 * k + 1):
        worth, pattern = _dearest(sizes, inverse.sum(axis=0), capacity)
        # A basis that has long gained nothing turns in a circle; it is as good a plan as any other of its worth.
        if amount.sum() < least - 1e-6 * least:
            least, gained = amount.sum(), turn
        if worth <= 1 + 1e-7 or turn - gained > 2 * k + 50:
            break
        used = np.flatnonzero(pattern)
        step = (inverse[:, used] * pattern[used]).sum(axis=1)
        ratio = np.where(step > 1e-7, amount / np.where(step > 1e-7, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[leave] * step, 0)
        amount[leave], basis[:, leave] = ratio[leave], pattern
        row = inverse[leave] / step[leave]
        inverse -= step[:, None] * row
        inverse[leave] = row
    return [(basis[:, j].astype(int), amount[j]) for j in range(k)]


class _Classes:
    """Classes of sequences by their gap: (how many, lengths in order)."""

    def __init__(self, capacity: int):
        self.capacity, self.gaps = capacity, {}

    def add(self, count: int, lengths: list[int]) -> None:
        if count > 0:
            self.gaps.setdefault(self.capacity - sum(lengths), []).append((count, lengths))

    def best_fit(self, length: int, n: int) -> None:
        """Place n sequences' worth of one length, each where it leaves the least gap; open sequences where it fits nowhere."""
        for gap in sorted(g for g in self.gaps if g >= length):
            each = gap // length
            while n and self.gaps.get(gap):
                count, lengths = self.gaps[gap].pop()
                full = min(count, n // each)
                rest = n - full * each if full < count and n - full * each < each else 0
                self.add(full, lengths + [length] * each)
                if rest:
                    self.add(1, lengths + [length] * rest)
                self.add(count - full - (rest > 0), lengths)
                n -= full * each + rest
            if not n:
                return
        each = self.capacity // length
        self.add(n // each, [length] * each)
        if n % each:
            self.add(1, [length] * (n % each))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, list[int]]]:
    """Classes of sequences (how many, lengths in order) that hold every length of the histogram as often as it counts.

    Configurations are used where they waste no more than a limit of WASTE; of these limits the one that needs the fewest
    sequences counts, the widest first. Without any configuration the plan is that of best-fit decreasing, which so bounds it.
    """
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if small * capacity < s < capacity]
    best: list[tuple[int, list[int]]] | None = None
    made = _grouped(large, capacity, groups) if large else None
    for waste in WASTE if large else (None,):
        classes = _Classes(capacity)
        classes.add(histogram.get(capacity, 0), [capacity])
        rest = _substituted(classes, made, waste) if large else {}
        for s in (s for s in histogram if s <= small * capacity):
            rest[s] = histogram[s]
        for s in sorted(rest, reverse=True):
            classes.best_fit(s, rest[s])
        found = [x for gap in sorted(classes.gaps) for x in classes.gaps[gap]]
        if best is None or sum(n for n, _ in found) < sum(n for n, _ in best):
            best = found
    return best


def _grouped(large: list[tuple[int, int]], capacity: int, groups: int) -> tuple:
    """Lengths in descending order and their counts' running totals, demand of each rounded size, and the optimal configurations."""
    total = sum(c for _, c in large)
    # Group borders at equal cardinality; a length's documents may fall in two groups.
    edges = sorted({total * g // groups for g in range(groups + 1)})
    upto = np.cumsum([c for _, c in large])
    lengths = np.array([s for s, _ in large])
    sizes = np.array([lengths[np.searchsorted(upto, e, side="right")] for e in edges[:-1]])
    counts = np.diff(edges)
    kinds = np.unique(sizes)[::-1]
    demand = np.array([counts[sizes == s].sum() for s in kinds])
    found = sorted(configurations(kinds, demand.astype(float), capacity), key=lambda x: -x[1])
    return lengths, upto, demand, [(pattern, int(amount + 1e-6), capacity - int(pattern @ kinds)) for pattern, amount in found]


def _substituted(classes: _Classes, made: tuple, waste: int) -> dict[int, int]:
    """Add the configurations with no more waste, actual documents in place of the rounded sizes; the lengths left over."""
    lengths, upto, demand, found = made
    left, next_at = demand.copy(), np.concatenate([[0], np.cumsum(demand)[:-1]])
    for pattern, times, gap in found:
        times = min([times, *[int(left[g] // a) for g, a in enumerate(pattern) if a]])
        if times <= 0 or not pattern.any() or gap > waste:
            continue
        columns = []
        for g in np.flatnonzero(pattern):
            for _ in range(pattern[g]):
                columns.append(int(next_at[g]))
                next_at[g] += times
                left[g] -= times
        # Each column is a run of actual documents; cut where any column's length changes.
        cuts = {0, times}
        for c in columns:
            cuts |= {int(u) - c for u in upto[np.searchsorted(upto, c, side="right") :] if u - c < times}
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:], strict=False):
            classes.add(b - a, [int(lengths[np.searchsorted(upto, c + a, side="right")]) for c in columns])
    ends = np.cumsum(demand)
    rest: dict[int, int] = {}
    for g in range(len(demand)):
        at = int(next_at[g])
        while at < ends[g]:
            i = int(np.searchsorted(upto, at, side="right"))
            to = min(int(upto[i]), int(ends[g]))
            rest[int(lengths[i])] = rest.get(int(lengths[i]), 0) + to - at
            at = to
    return rest


def places(classes: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, sequence of the first rank, offset) for every position of every class."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for count, lengths in classes:
        offset = 0
        for s in lengths:
            rows.append((s, rank.get(s, 0), rank.get(s, 0) + count, sequence, offset))
            rank[s] = rank.get(s, 0) + count
            offset += s
        sequence += count
    return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **how) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, path, id_col, text_col, capacity), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = places(plan(histogram, capacity, **how))
    spark = docs.sparkSession
    at = spark.createDataFrame(rows, "length_at long, first long, upto long, sequence long, offset long")
    buckets = max(1, sum(histogram.values()) // BUCKET_ROWS)
    ranked = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(buckets))).withColumn("one", F.lit(1))
    ranked = bucketed_total(ranked, ["length"], "bucket", [F.col("id").asc_nulls_last(), "piece", "start", "ids_crc32"], "one", "rank")
    rank = F.col("rank") - 1
    placed = ranked.join(F.broadcast(at), (F.col("length") == F.col("length_at")) & (rank >= F.col("first")) & (rank < F.col("upto")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("sequence") + rank - F.col("first")).alias("sequence_id"), "offset")
