"""Each stage of the pipeline against a plain version of it, on the rows that its predecessor kept."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from heddle.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return {r["doc_id"]: r for r in df.select(COLUMNS).collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def targets(sizes, share=1.5, cap=2):
    """Targets by source: excess over the cap is dealt again by weight."""
    order = sorted(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= cap * sizes[s]}
        for s in over or open_:
            out[s] = cap * sizes[s] if over else level * weight[s]
            left -= out[s]
        open_ -= over or set(open_)
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)

    def kept(name, docs):
        out = stages[name](spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        return spark.read.schema(out.schema).parquet(str(tmp_path / name))

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    clean = kept("toxicity", docs)
    assert clean.columns == docs.columns
    judged = {r["doc_id"]: r["predicted"] for r in queries.op5_toxic_trees(spark, DATA).collect()}
    assert set(rows_of(clean)) == {i for i, p in judged.items() if not p}

    exact = kept("exact_dedup", clean)
    first = {}
    for i, r in sorted(rows_of(clean).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), i)
    assert set(rows_of(exact)) == set(first.values())

    near = kept("near_dedup", exact)
    sets = {i: shingles(r["text"]) for i, r in rows_of(exact).items()}
    head = {i: i for i in sets}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                head[b] = a
    assert set(rows_of(near)) == {i for i in ids if root(i) == i}

    mixed = kept("mixing", near)
    taken, source, text = defaultdict(int), {}, {}
    for i, r in rows_of(near).items():
        source[i], text[i] = r["source"], (r["text"] or "").split()
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += len(text[i])
    for r in mixed.collect():
        words = r["text"].split()
        assert words == text[r["doc_id"]][: len(words)] and words
        taken[r["doc_id"]] += len(words)
    assert all(n <= 2 * len(text[i]) for i, n in taken.items())
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    for s, goal in targets(sizes).items():
        assert abs(sum(n for i, n in taken.items() if source[i] == s) - goal) <= 256

    packed = kept("packing", mixed).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, filled = Counter(), Counter(), defaultdict(list)
    for r in mixed.collect():
        n = len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1
        want.update([(r["doc_id"], 0, (n - 1) % 1024 + 1)] + [(r["doc_id"], k, 1024) for k in range(1, -(-n // 1024))])
    for r in packed:
        got[r["doc_id"], r["piece"], r["length"]] += 1
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in filled.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
