"""Repeated byte strings by suffix arrays that are built with the linear grouping construction.

A string of `least` bytes counts as repeated if it also starts anywhere else, in the same document or in another one. Work
is divided so that no task sees more than a bounded block, whatever the number of copies:

1. every window of `least` bytes picks an anchor, the leftmost least hash of its GRAM-byte grams, so equal windows pick
   equal anchors at equal places. Neighbouring windows with one anchor are a run; its bytes are the run's context;
2. runs are counted by anchor and context digest, which make 128 bits together. A context that occurs twice repeats all its
   windows; an anchor with a single context needs no more. One document stands for each context of the other anchors;
3. contexts are trimmed to the bytes around the gram that any other one of their anchor shares: contexts that are sorted by
   the bytes on one side share most with a neighbour. A small anchor is sorted in its block; an anchor with more than SALTED
   contexts is range-sorted over all tasks, by either side, and partition borders are mended. What is left goes to the
   anchor's block, or, in sorted order, to blocks of SALTED contexts. A suffix array of the block puts windows with equal
   bytes next to each other. A window that is single in its block of a divided anchor meets those of the other blocks by its
   digest; after the trim few are;
4. covered bytes are the union of the repeated windows.

The suffix array comes in two phases. Groups of suffixes with the same Lyndon prefix are made in descending order: each
suffix of the group in turn points to the nearest suffix on its left in a lower group, and these move right above what
stays of their own group, those that are pointed at more often higher. Then suffixes are emitted in ascending order: each
one that is out releases, along the pointers to its left, suffixes to the fronts of their groups. Nothing is renamed.

Null text is empty and has no windows. Texts shorter than `least` bytes have none either. Repeated rows are copies of each
other, so all their windows are repeated; rows with the same identifier and other texts are separate documents. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import ROW, discard, keyed, stored, text_or_empty

#: Bytes of a repeated string, and of the grams that anchors are chosen from (a power of two under it).
LEAST, GRAM = 200, 64
#: Contexts of one anchor that a block takes, and bytes from which a block is closed.
SALTED, BLOCK = 1_000, 1 << 18
#: Bytes whose anchors are sought at a time; positions must fit the low 24 bits.
STRETCH = 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15


def suffix_array(s: list[int]) -> list[int]:
    """The order of the suffixes of s, whose end counts as smaller than any value."""
    n = len(s)
    at_value: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        at_value.setdefault(c, []).append(i)
    members = [at_value[c] for c in sorted(at_value)]
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * n
    for g, at in enumerate(members):
        for i in at:
            group[i] = g
    link = list(range(-1, n - 1))
    done = bytearray(n)
    order = []
    g = len(members) - 1
    while g >= 0:
        own = members[g] = [i for i in members[g] if group[i] == g]
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = link[j]
            link[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            moved.setdefault((k, group[j]), []).append(j)
        # The most pointed at move first: later ones come to stand between them and their old group.
        for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            old, new = key[1], len(members)
            members.append(moved[key])
            for j in moved[key]:
                group[j] = new
            up = above[old]
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
        order.append(g)
        g = below[g]
    front, at = [0] * len(members), 0
    for g in reversed(order):
        front[g] = at
        at += len(members[g])
    out = [0] * n
    open_ = bytearray(b"\x01") * n
    j = n - 1
    for i in range(-1, n):
        if i >= 0:
            j = out[i] - 1
        while j >= 0 and open_[j]:
            open_[j] = 0
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            j = link[j]
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_BYTES = np.random.default_rng(11).integers(1 << 63, size=256, dtype=np.uint64)


def runs(pieces: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: piece, first and last start in it, the gram's hash and its place after the first start."""
    body = b"".join(pieces)
    ends = np.cumsum([len(p) for p in pieces])
    offsets = ends - [len(p) for p in pieces]
    if len(body) < least:  # also no pieces at all
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    h, m, power = _BYTES[np.frombuffer(body, np.uint8)], 1, _ODD
    while m < GRAM:
        h = h[:-m] * np.uint64(power) + h[m:]
        m, power = 2 * m, power * power % (1 << 64)
    h = _mixed(h)
    low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    width, m = least - GRAM + 1, 1
    while 2 * m <= width:
        low, m = np.minimum(low[:-m], low[m:]), 2 * m
    if width > m:
        low = np.minimum(low[: -(width - m)], low[width - m :])
    anchor = (low & _LOW).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for a, b in zip(offsets, ends, strict=True):
        valid[max(a, b - least + 1) : b] = False
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~valid[:-1]]) & valid
    starts = np.flatnonzero(new)
    stop = np.concatenate([(anchor[1:] != anchor[:-1]) | ~valid[1:], [True]]) & valid
    piece = np.searchsorted(offsets, starts, side="right") - 1
    return piece, starts - offsets[piece], np.flatnonzero(stop) - offsets[piece], h[anchor[starts]], anchor[starts] - starts


def _anchors(least: int):
    names = ["id", "th", "h", "dig", "at", "upto", "span", "gram", "n"]

    def made(b: pa.RecordBatch, held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        piece, a, z, h, gram = runs([p for _, _, p in held], least)
        rows, out = [], ([], [], [], [], [], [], [])
        mark = None
        for p, s, e, g, at in zip(piece.tolist(), a.tolist(), z.tolist(), h.view(np.int64).tolist(), gram.tolist(), strict=True):
            row, base, body = held[p]
            dig = xxhash.xxh3_64_intdigest(body[s : e + least])
            if mark == (p, g, dig) and out[3][-1] == base + s - 1:  # a period: the same run again
                out[3][-1] = base + e
                out[6][-1] += 1
                continue
            mark = (p, g, dig)
            rows.append(row)
            for c, v in zip(out, (g, dig - (dig >> 63 << 64), base + s, base + e, e - s + 1, at, 1), strict=True):
                c.append(v)
        take = pa.array(rows, pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for row in range(b.num_rows):
                body = b.column(2)[row].as_py()
                for base in range(0, max(1, len(body) - least + 1), STRETCH):
                    piece = body[base : base + STRETCH + least - 1]
                    if size and size + len(piece) > 2 * STRETCH:
                        yield made(b, held)
                        held, size = [], 0
                    if len(piece) >= least:
                        held.append((row, base, piece))
                        size += len(piece)
            yield made(b, held)

    return run


def _bodies(least: int):
    """Cut the contexts that a document stands for out of its bytes: what is left of the gram, outward, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                body, wanted = b.column(2)[row].as_py(), b.column(3)[row].values
                at, span, gram = (wanted.field(c).to_pylist() for c in ("at", "span", "gram"))
                left = [body[a : a + g][::-1] for a, g in zip(at, gram, strict=True)]
                right = [body[a + g : a + s + least - 1] for a, s, g in zip(at, span, gram, strict=True)]
                same = pa.array([row] * len(left), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), *[wanted.field(c) for c in ("at", "n", "h")], pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["id", "th", "at", "n", "h", "left", "right"])

    return run


def repeats(bodies: list[bytes], counts: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the bodies in suffix order: body, start in it, and how often the window occurs, bodies counted as given."""
    if not bodies:
        return (np.empty(0, np.int64),) * 3
    lengths = np.array([len(x) for x in bodies])
    begins = np.cumsum(lengths + 1) - lengths - 1
    flat = np.zeros(int((lengths + 1).sum()), np.uint16)
    for at, x in zip(begins, bodies, strict=True):
        flat[at : at + len(x)] = np.frombuffer(x, np.uint8)
        flat[at : at + len(x)] += 1
    order = np.array(suffix_array(flat.tolist()), np.int64)
    owner = np.searchsorted(begins, order, side="right") - 1
    whole = order - begins[owner] <= lengths[owner] - least
    order, owner = order[whole], owner[whole]
    if not len(order):
        return owner, order, order
    windows = np.lib.stride_tricks.sliding_window_view(flat, least)
    first = np.ones(len(order), bool)
    for k in range(1, len(order), 10_000):
        now = order[k - 1 : k + 10_000]
        first[k : k + 10_000] = (windows[now[1:]] != windows[now[:-1]]).any(axis=1)
    run = np.cumsum(first) - 1
    total = np.bincount(run, np.array(counts, float)[owner]).astype(np.int64)
    return owner, order - begins[owner], total[run]


def _common(x: bytes, y: bytes) -> int:
    """Length of the longest common beginning."""
    m = min(len(x), len(y))
    return m - ((int.from_bytes(x[:m]) ^ int.from_bytes(y[:m])).bit_length() + 7) // 8


def _shared(parts: list[bytes]) -> list[int]:
    """For each part, the longest beginning that any other one has too."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        k = _common(parts[i], parts[j])
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def _sharing(salted: int):
    """The same for sorted partitions of rows (key, h, side), within each h; a partition's first and last side go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn = TaskContext.get().partitionId(), 0
        kinds = {"key": pa.int64(), "h": pa.int64(), "shared": pa.int32(), "salt": pa.int64(), "part": pa.int32(), "turn": pa.int64(), "edge": pa.binary()}
        last = None

        def row(key: int, h: int, side: bytes, shared: int, turn: int, edge: bool) -> tuple:
            return key, h, shared, part << 32 | turn // salted, part, turn, side if edge else None

        for b in batches:
            made = []
            for key, h, side in zip(*[c.to_pylist() for c in b.columns], strict=True):
                k = _common(last[2], side) if last and last[1] == h else 0
                if last:
                    made.append(row(*last[:3], max(last[3], k), last[4], last[4] == 0))
                last = (key, h, side, k, turn)
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(kinds), kinds.values(), strict=True)], list(kinds))
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(*last, True), kinds.values(), strict=True)], list(kinds))

    return run


def _trims(large: DataFrame, side: str, other: str, salted: int) -> DataFrame:
    """key, <side>_shared and salt of contexts: the bytes of one side that any other context of their anchor shares."""
    spark = large.sparkSession
    ordered = large.repartitionByRange("h", side, other, "key").sortWithinPartitions("h", side, other, "key")
    found = stored(ordered.select("key", "h", side).mapInArrow(_sharing(salted), "key long, h long, shared int, salt long, part int, turn long, edge binary"), "suffix-trims")
    edges = found.filter("edge is not null").select("part", "turn", "key", "h", "edge").orderBy("part", "turn").collect()  # two rows a partition
    over = []
    for x, y in zip(edges, edges[1:], strict=False):
        if x["part"] != y["part"] and x["h"] == y["h"]:
            k = _common(bytes(x["edge"]), bytes(y["edge"]))
            over += [(x["key"], k), (y["key"], k)]
    over = spark.createDataFrame(over, "key long, over int").groupBy("key").agg(F.max("over").alias("over"))
    return found.join(F.broadcast(over), "key", "left").select("key", F.greatest("shared", F.coalesce("over", F.lit(0))).alias(f"{side}_shared"), "salt")


def trimmed(lefts: list[bytes], rights: list[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """How many bytes left and right of each context of an anchor can lie in a window of another one."""
    return [(k, r) if k + r >= least else (0, 0) for k, r in zip(_shared(lefts), _shared(rights), strict=True)]


def _blocks(least: int):
    names = ["id", "th", "a", "b", "win"]

    def closed(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: batch.column(c).to_pylist() for c in ("h", "salt", "divided", "at", "n", "left", "right")}
        counts, divided = column["n"], np.array(column["divided"])
        whole = list(zip(column["left"], column["right"], strict=True))
        cut = [(len(x), len(y)) for x, y in whole]
        keys = list(zip(column["h"], column["salt"], strict=True))
        for k, group in itertools.groupby(range(len(keys)), key=keys.__getitem__):
            rows = list(group)
            if not divided[rows[0]]:
                for i, c in zip(rows, trimmed([whole[i][0] for i in rows], [whole[i][1] for i in rows], least), strict=True):
                    cut[i] = c
        starts = [at + len(x) - k for at, (x, _), (k, _) in zip(column["at"], whole, cut, strict=True)]
        bodies = [x[:k][::-1] + y[:r] for (x, y), (k, r) in zip(whole, cut, strict=True)]
        # Equal trimmed contexts of an anchor go into the suffix array once, with all their occurrences.
        owners: dict[tuple, list[int]] = {}
        for i, body in enumerate(bodies):
            if body:
                owners.setdefault((keys[i], body), []).append(i)
        held = list(owners.values())
        distinct, start, times = repeats([body for _, body in owners], [sum(counts[i] for i in x) for x in held], least)
        rows, a, z, win = [], [], [], []
        found = np.flatnonzero(times > 1)
        found = found[np.lexsort((start[found], distinct[found]))]
        if len(found):
            o, s = distinct[found], start[found]
            edge = np.flatnonzero((o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)) + 1
            for lo, hi in zip([0, *edge], [*edge, len(found)], strict=True):
                for i in held[o[lo]]:
                    if counts[i] == 1:  # others are known to be repeated as a whole
                        rows.append(i)
                        a.append(starts[i] + int(s[lo]))
                        z.append(starts[i] + int(s[hi - 1]))
                        win.append(None)
        told = None
        lead = np.array([x[0] for x in held], np.int64)
        for k in np.flatnonzero(divided[lead[distinct]]).tolist() if divided.any() else []:
            i, s = int(lead[distinct[k]]), int(start[k])
            dig = xxhash.xxh3_128_digest(bodies[i][s : s + least])
            single = times[k] == 1
            if not single and dig == told:
                continue
            told = dig
            rows.append(i)
            a.append(starts[i] + s if single else None)
            z.append(None)
            win.append(dig)
        take = pa.array(rows, pa.int64())
        made = pa.table([batch.column("id").take(take), batch.column("th").take(take), pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(win, pa.binary())], names)
        yield from made.to_batches(20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            keys = list(zip(b.column("h").to_pylist(), b.column("salt").to_pylist(), strict=True))
            widths = pc.add(pc.binary_length(b.column("left")), pc.binary_length(b.column("right"))).to_pylist()
            begin = 0
            for k, key in enumerate(keys):
                if key != last and size >= BLOCK:
                    yield from closed(pa.Table.from_batches([*held, b.slice(begin, k - begin)]))
                    held, size, begin = [], 0, k
                last = key
                size += widths[k]
            held.append(b.slice(begin))
        if size:
            yield from closed(pa.Table.from_batches(held))

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.encode(text, "UTF-8").alias("body"))


def _with_lists(docs: DataFrame, rows: DataFrame, values: list[str], how: str) -> DataFrame:
    """docs (id, th, body) with `found`, the list of a document's rows (id, th, values..)."""
    lists = rows.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct(*values)).alias("found"))
    return docs.join(lists, (F.col("th") == F.col("_th")) & F.col("id").eqNullSafe(F.col("_id")), how).select("id", "th", "body", "found")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, salted: int = SALTED) -> DataFrame:
    """id, th (the text's hash), a, b: ranges of starts of repeated windows, in bytes; ranges may overlap."""
    if least < GRAM:
        raise ValueError(f"least must be {GRAM} bytes or more")
    placed = _keyed(docs, id_col, text_col)
    kind = placed.schema["id"].dataType.simpleString()
    anchors = stored(placed.mapInArrow(_anchors(least), f"id {kind}, th long, h long, dig long, at long, upto long, span int, gram int, n long"), "suffix-anchors")
    per = stored(anchors.groupBy("h", "dig").agg(F.sum("n").alias("n"), F.min(F.struct("id", "th", "at", "span", "gram")).alias("rep")), "suffix-contexts")
    twice = stored(per.filter("n > 1").select("h", "dig"), "suffix-copies")
    several = per.groupBy("h").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    need = stored(per.join(several, "h").select("rep.*", "n", "h", "contexts"), "suffix-wanted")
    discard(per)

    def bodies(wanted: DataFrame) -> DataFrame:
        return _with_lists(placed, wanted, ["at", "span", "gram", "n", "h"], "inner").mapInArrow(_bodies(least), f"id {kind}, th long, at long, n long, h long, left binary, right binary")

    columns = ["id", "th", "at", "n", "h", "salt", "divided", "left", "right"]
    ready = bodies(need.filter(F.col("contexts") <= salted)).withColumn("salt", F.lit(0).cast("long")).withColumn("divided", F.lit(False)).select(columns)
    large = need.filter(F.col("contexts") > salted)
    if not large.isEmpty():
        large = stored(bodies(large).withColumn("key", F.monotonically_increasing_id()), "suffix-large")
        cut = large.join(_trims(large, "left", "right", salted), "key").join(_trims(large, "right", "left", salted).drop("salt"), "key").filter(F.col("left_shared") + F.col("right_shared") >= least)
        cut = cut.withColumn("at", F.col("at") + F.octet_length("left") - F.col("left_shared")).withColumn("divided", F.lit(True))
        ready = ready.union(cut.withColumn("left", F.expr("substring(left, 1, left_shared)")).withColumn("right", F.expr("substring(right, 1, right_shared)")).select(columns))
    found = stored(ready.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_blocks(least), f"id {kind}, th long, a long, b long, win binary"), "suffix-found")
    # A window's rows are one a block, so a list is no longer than the blocks of an anchor.
    merged = found.filter("win is not null").groupBy("win").agg(F.count("*").alias("k"), F.collect_list(F.when(F.col("a").isNotNull(), F.struct("id", "th", "a"))).alias("one")).filter("k > 1")
    merged = merged.select(F.explode("one").alias("x")).select("x.id", "x.th", "x.a", F.col("x.a").alias("b"))
    copies = anchors.join(twice, ["h", "dig"], "left_semi").select("id", "th", F.col("at").alias("a"), F.col("upto").alias("b"))
    return found.filter("win is null").select("id", "th", "a", "b").union(merged).union(copies)


def covered(ranges: list[tuple[int, int]], least: int = LEAST) -> list[tuple[int, int]]:
    """The maximal byte ranges [from, to) under windows that start in the ranges."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + least)
        else:
            out.append([a, b + least])
    return [(a, b) for a, b in out]


def _cut(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, kept, sizes = [], [], []
            for body, found in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                found = found.values if found.is_valid else None
                gone = covered(list(zip(found.field("a").to_pylist(), found.field("b").to_pylist(), strict=True)), least) if found is not None else []
                edges = [0, *[x for s in gone for x in s], len(body)]
                kept.append(b"".join(body[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"from": x, "to": y} for x, y in gone])
                sizes.append(len(body))
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "th", "n_bytes", "spans", "kept"])

    return run


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, salted: int = SALTED) -> DataFrame:
    """One row per document: id_col, n_bytes, spans (removed byte ranges), kept (the other bytes)."""
    placed = _keyed(docs, id_col, text_col)
    kind = placed.schema["id"].dataType.simpleString()
    rows = _with_lists(placed, repeated(docs, id_col, text_col, least, salted), ["a", "b"], "left")
    out = rows.mapInArrow(_cut(least), f"id {kind}, th long, n_bytes long, spans array<struct<from:long,to:long>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The documents without their repeated strings, in their own columns; each row is one of its own, also where identifiers are null or repeat.

    Bytes of a character that a removed string cuts in two are left out as well.
    """
    rows = keyed(docs, "repeat-rows")
    left = cut(rows, ROW, text_col, least).filter(F.size("spans") > 0).select(F.col(ROW).alias("_id"), "kept")
    kind = rows.schema[ROW].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()], pa.string())], ["_id", "_kept"])

    left = left.mapInArrow(texts, f"_id {kind}, _kept string")
    return rows.join(left, F.col(ROW) == F.col("_id"), "left").withColumn(text_col, F.coalesce("_kept", text_col)).select(docs.columns)


def digests(cut_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The sizes and digest of a cut: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    return cut_docs.select(id_col, "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
