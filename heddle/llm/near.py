"""Links between near-equal texts: word shingles, MinHash bands, exact verification, connected components.

Texts with the same shingle set are one node, so copies never meet in pairs. A band bucket links its nodes to one of them
first (a star), the one that meets most nodes over all its buckets: the text that others are copies of meets more than a copy
does. Where a bucket still holds several components, nodes outside its largest one are compared with a few members of that one
where the plan says so, and those that remain apart with all others. There a node meets the nodes of its own and the two neighbouring size classes only, and the classes of a bucket are separate
join keys. Before full sets are compared, parity bitmaps of the sets rule out pairs that cannot be linked. No link between
different components is left out. Sets of one or two shingles are linked by equality alone, so they need no bands.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import discard, stored

SHINGLE, SIMILAR = 5, 75
#: Nodes up to which texts are looked up by broadcast (100 bytes each, 20 MB); beyond it they are joined by a shuffle.
BROADCAST_NODES = 200_000
#: Sizes of linked sets differ by a factor of 4/3 at most, so their classes of this ratio are the same or neighbours.
CLASS = 1.34


@dataclass(frozen=True)
class Bands:
    """bands of rows minima each; bits low bits of every minimum are kept for estimates (0: none), and parity longs of a set's bitmap.

    few: members of a bucket's largest component that the nodes outside it meet before they meet all; worth a round for
    short bands, in which more of them collide.
    """

    bands: int
    rows: int
    bits: int = 0
    parity: int = 16
    few: int = 0

    def missed(self, similarity: float) -> float:
        """Chance that no band of a pair of this similarity agrees."""
        return (1 - similarity**self.rows) ** self.bands

    @property
    def longs(self) -> int:
        return self.bits * -(-self.bands * self.rows // 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BLANKS = np.zeros(256, bool)
_BLANKS[list(b" \t\n\v\f\r")] = True
#: Bytes that are hashed together, about.
PIECE = 1 << 20
#: A number for each byte, 0 for blanks, and the base of the words' polynomial hashes.
_BYTES = np.where(_BLANKS, np.uint64(0), np.random.default_rng(17).integers(1 << 63, size=256, dtype=np.uint64) | np.uint64(1))
_BASE = np.uint64(0x9E3779B97F4A7C17)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, and each text's number of words; A-Z count as a-z, and the six ASCII blanks part words.

    All bytes are hashed together: no word is an object of its own.
    """
    whole = [t.encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(whole).lower() + b"\n", np.uint8)
    blank = _BLANKS[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.cumsum([len(t) + 1 for t in whole]) + 1
    sizes = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return np.empty(0, np.uint64), sizes
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(raw), PIECE)), len(starts)))
    return np.concatenate([_piece(raw[starts[i] : starts[j] if j < len(starts) else len(raw)], starts[i:j] - starts[i]) for i, j in itertools.pairwise(cuts)]), sizes


def _piece(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes, which begin with one; blanks after a word add nothing to its hash."""
    begin = np.zeros(len(raw), np.int32 if len(raw) < 1 << 31 else np.int64)
    begin[starts] = starts
    inside = np.arange(len(raw), dtype=begin.dtype) - np.maximum.accumulate(begin)
    powers = np.full(int(np.diff(np.append(starts, len(raw))).max()), _BASE, np.uint64)
    powers[0] = 1
    return _mixed(np.add.reduceat(_BYTES[raw] * np.multiply.accumulate(powers)[inside], starts))


def _shingled(h: np.ndarray, width: int) -> np.ndarray:
    out = h[: len(h) - width + 1].copy()
    for k in range(1, width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return _mixed(out + np.uint64(width))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; the whole sequence if it is shorter than one; empty without words."""
    out = _shingled(flat, SHINGLE) if len(flat) >= SHINGLE else flat
    begins = np.cumsum(sizes) - sizes
    return [_distinct(out[a : a + n - SHINGLE + 1]) if n >= SHINGLE else _shingled(flat[a : a + n], n) if n else np.empty(0, np.uint64) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]


def minima(sets: list[np.ndarray], count: int, seed: int = 1) -> np.ndarray:
    """MinHash minima (a row per hash, a column per set); sets must not be empty."""
    dice = np.random.default_rng(seed)
    odd = dice.integers(1 << 31, size=count, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = dice.integers(1 << 32, size=count, dtype=np.uint32)
    out = np.empty((count, len(sets)), np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for i in range(count):
        out[i] = np.minimum.reduceat(flat * odd[i] + add[i], starts)
    return out


def _band_keys(low: np.ndarray, plan: Bands) -> np.ndarray:
    """A key per band and set, with the band's number mixed in."""
    keys = np.full((plan.bands, low.shape[1]), 0, np.uint64)
    for b in range(plan.bands):
        h = np.full(low.shape[1], b + 1, np.uint64)
        for r in range(plan.rows):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + low[b * plan.rows + r])
        keys[b] = h
    return keys


def _packed(low: np.ndarray, plan: Bands) -> np.ndarray:
    """The low bits of the minima as longs: all first bits, then all second bits, and so on."""
    per = plan.longs // max(1, plan.bits)
    out = np.zeros((plan.longs, low.shape[1]), np.uint64)
    for bit in range(plan.bits):
        for i in range(low.shape[0]):
            out[bit * per + i // 64] |= ((low[i].astype(np.uint64) >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i % 64)
    return out


def _parities(sets: list[np.ndarray], longs: int = 16) -> np.ndarray:
    """A bitmap per set: a bit is set where an odd number of hashes fall on it. Two bitmaps differ in no more bits than the sets in hashes."""
    bits = 64 * longs
    at = np.concatenate([(s & np.uint64(bits - 1)).astype(np.int64) + i * bits for i, s in enumerate(sets)])
    odd = (np.bincount(at, minlength=bits * len(sets)) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), bits), axis=1).view(np.int64)


def _columns(plan: Bands) -> list[str]:
    """The long columns of a signature: low bits of minima, parity bitmap."""
    return [f"s{k}" for k in range(plan.longs)] + [f"p{k}" for k in range(plan.parity)]


def _signer(plan: Bands, floor: int = 0):
    """Signatures of (id, text); sets of fewer than floor shingles are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                flat, sizes = hashed_words(b.column(1).to_pylist())
                if floor:
                    long = sizes >= floor
                    b, flat, sizes = b.filter(pa.array(long)), flat[np.repeat(long, sizes)], sizes[long]
                sets = shingle_sets(flat, sizes)
                if floor:
                    large = np.array([len(x) >= floor for x in sets], bool)
                    b, sizes, sets = b.filter(pa.array(large)), sizes[large], list(itertools.compress(sets, large))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, longs = np.empty(0, np.int64), np.empty((len(_columns(plan)), 0), np.int64)
                if full:
                    low = minima([sets[i] for i in full], plan.bands * plan.rows)
                    keys = np.ascontiguousarray(_band_keys(low, plan).T).view(np.int64).ravel()
                    longs = np.concatenate([_packed(low, plan).view(np.int64), _parities([sets[i] for i in full], plan.parity).T])
                missing = np.ones(len(sets), bool)
                missing[full] = False
                spread = np.zeros((len(longs), len(sets)), np.int64)
                spread[:, full] = longs
                ends = np.concatenate([[0], np.cumsum(np.where(missing, 0, plan.bands))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        pa.array(sizes, pa.int32()),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys), mask=pa.array(missing)),
                        *[pa.array(c, mask=missing) for c in spread],
                    ],
                    ["id", "words", "n", "node", "keys", *_columns(plan)],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(*hashed_words(b.column(2).to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["nid", "wanted", "node", "body"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= SIMILAR * (len(x) + len(y) - both))
        kept = b.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (a < b) is either a centre or has one edge, to its centre."""
    ends = edges.select(F.col("b").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("a", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.count_if((F.col("up") > 0) & (F.col("up") + F.col("down") > 1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """nid, comp: the smallest node that each node of links (a, b) can reach; by large-star and small-star steps."""

    def turned(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = (both.filter("v > u") if large else near).join(least, "u")
        to = out.select(F.col("v").alias("b"), F.col("m").alias("a"))
        return (to if large else to.union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))).filter("a < b").select("a", "b").distinct()

    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    while not _all_stars(edges):
        before, edges = edges, stored(turned(turned(edges, True), False), "edges")
        discard(before)
    return edges.select(F.col("b").alias("nid"), F.col("a").alias("comp")).union(edges.select(F.col("a").alias("nid"), F.col("a").alias("comp"))).distinct()


def _alike(x: str, y: str, plan: Bands, slack: float) -> Column:
    """Whether two nodes can be similar: by their sizes, their parity bitmaps, and the agreeing low bits of their minima.

    Sets of n and m hashes that differ in d are as similar as (n + m - d) / (n + m + d); their bitmaps differ in at most d bits.
    Unrelated minima agree in `bits` bits by chance once in 2**bits times; the estimate is corrected for that, and passes
    unless it lies below the threshold by more than slack.
    """
    sizes = (100 * F.col(f"{x}.n") >= SIMILAR * F.col(f"{y}.n")) & (100 * F.col(f"{y}.n") >= SIMILAR * F.col(f"{x}.n"))
    differing = reduce(lambda p, q: p + q, [F.bit_count(F.col(f"{x}.p{k}").bitwiseXOR(F.col(f"{y}.p{k}"))) for k in range(plan.parity)])
    sizes = sizes & ((100 + SIMILAR) * differing <= (100 - SIMILAR) * (F.col(f"{x}.n") + F.col(f"{y}.n")))
    if not plan.bits:
        return sizes
    per, chance, minima_ = plan.longs // plan.bits, 0.5**plan.bits, plan.bands * plan.rows
    differ = [reduce(lambda p, q: p.bitwiseOR(q), [F.col(f"{x}.s{k + bit * per}").bitwiseXOR(F.col(f"{y}.s{k + bit * per}")) for bit in range(plan.bits)]) for k in range(per)]
    unequal = reduce(lambda p, q: p + q, [F.bit_count(d) for d in differ])
    return sizes & ((1 - unequal / minima_ - chance) / (1 - chance) >= SIMILAR / 100 - slack)


def classes(items: DataFrame, plan: Bands, slack: float = 0.22, least: int = 0) -> DataFrame:
    """id, words, n, node, comp of items (id, text): words, set size, set identity, and the component's smallest id; null without words.

    With least, only links count whose larger set has so many shingles; sets that are too small for such a link are left out
    of the result. items is read once for signatures, and again for the texts of candidate nodes.
    """
    kind = items.schema["id"].dataType.simpleString()
    longs = _columns(plan)
    # The smaller set of a link has SIMILAR percent of the larger one's shingles at least.
    floor = -(-SIMILAR * least // 100)
    shape = f"id {kind}, words int, n long, node binary, keys array<long>" + "".join(f", {s} long" for s in longs)
    signed = stored(items.select("id", "text").mapInArrow(_signer(plan, floor), shape), "near-signed")
    per = signed.filter("node is not null").groupBy("node").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "keys", *longs)])
    nodes = stored(per.withColumn("nid", F.monotonically_increasing_id()), "near-nodes")
    members_ = stored(signed.select("id", "words", "n", "node"), "near-items")
    discard(signed)
    thin = nodes.select("nid", "n", *longs)
    placed = nodes.filter("n >= 3").select("nid", F.explode("keys").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    met = stored(placed.join(shared, "bucket"), "near-met")
    meets = met.join(met.groupBy("nid").agg(F.sum("size").alias("meets")), "nid")
    centre = meets.groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("nid")).alias("least"))).alias("top")).select("bucket", (-F.col("top.least")).alias("rep"))
    members = stored(met.join(centre, "bucket").select("bucket", "nid", "rep"), "near-members")
    discard(met)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(pairs, name)
        wanted = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
        wanted = stored(nodes.join(wanted, "nid", "left_semi").select("nid", F.col("id").alias("_id"), F.col("node").alias("wanted")), f"{name}-wanted")
        lookup = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted
        texts = items.join(lookup, F.col("id").eqNullSafe(F.col("_id"))).select("nid", "wanted", "text")
        body = texts.mapInArrow(_sets, "nid long, wanted binary, node binary, body binary").filter("node = wanted").select("nid", "body").dropDuplicates(["nid"])
        body = stored(body, f"{name}-sets")
        full = pairs.join(body.select(F.col("nid").alias("b"), F.col("body").alias("y")), "b").join(body.select(F.col("nid").alias("a"), F.col("body").alias("x")), "a")
        out = stored(full.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"), f"{name}-links")
        discard(pairs, wanted, body)
        return out

    alike = _alike("x", "y", plan, slack) & (F.greatest("x.n", "y.n") >= least)
    star = members.filter("nid <> rep").select(F.col("rep").alias("a"), F.col("nid").alias("b")).distinct()
    star = star.join(thin.alias("x"), F.col("a") == F.col("x.nid")).join(thin.alias("y"), F.col("b") == F.col("y.nid"))
    links = verified(star.filter(alike).select("a", "b"), "near-star")

    def apart(comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The members of buckets that hold several components, and each such bucket's largest one."""
        of = members.join(comp, "nid", "left").withColumn("comp", F.coalesce("comp", "nid"))
        several = of.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("bucket")
        mixed = stored(of.join(several, "bucket"), "near-mixed")
        return mixed, mixed.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"))

    def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
        """The components with further links: each known one is a star already."""
        return components(comp.select(F.col("comp").alias("a"), F.col("nid").alias("b")).union(links))

    comp = stored(components(links), "near-components")
    mixed, major = apart(comp)
    if plan.few:
        inside = mixed.join(major, "bucket").filter("comp = major").groupBy("bucket").agg(*[F.min_by("nid", F.xxhash64("nid", F.lit(k))).alias(f"c{k}") for k in range(plan.few)])
        few = inside.select("bucket", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(plan.few)]))).alias("a"))
        few = mixed.join(major, "bucket").filter("comp <> major").select("bucket", F.col("nid").alias("b")).join(few, "bucket").select("a", "b").distinct()
        few = few.join(thin.alias("x"), F.col("a") == F.col("x.nid")).join(thin.alias("y"), F.col("b") == F.col("y.nid"))
        before, comp = comp, stored(joined(comp, verified(few.filter(alike).select("a", "b"), "near-few")), "near-components")
        discard(mixed, before)
        mixed, major = apart(comp)
    sized = mixed.join(thin, "nid").withColumn("class", F.floor(F.log("n") / math.log(CLASS)).cast("int"))
    minor = sized.join(major, "bucket").filter("comp <> major").withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    other = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("x.major")) | (F.col("x.nid") < F.col("y.nid")))
    # Pairs with a bucket's centre were compared in its star.
    new = (F.col("x.nid") != F.col("x.rep")) & (F.col("y.nid") != F.col("y.rep"))
    cross = minor.alias("x").join(sized.alias("y"), other & new & alike).select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct()
    more = verified(cross, "near-cross")
    discard(mixed, members)

    comp = joined(comp, more)
    named = stored(nodes.select("nid", "node", "id").join(comp, "nid", "left").withColumn("comp", F.coalesce("comp", "nid")), "near-named")
    discard(nodes)
    least_of = named.groupBy("comp").agg(F.min("id").alias("first"))
    return members_.join(named.join(least_of, "comp").select(F.col("node").alias("_node"), F.col("first").alias("comp")), F.col("node") == F.col("_node"), "left").select("id", "words", "n", "node", "comp")
