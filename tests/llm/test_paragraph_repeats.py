"""Near copies of paragraphs, and passages that repeat inside paragraphs or across their ends, are reported and removed."""

import random
from collections import defaultdict

import numpy as np
import pytest

from heddle.llm import paragraph_bands

DATA = "/root/testdata/sf0.001"


def prose(dice, n):
    return " ".join("".join(dice.choices("abcdefghijklmnop", k=dice.randint(3, 8))) + dice.choice(["", "", "", "", "", "", "", "."]) for _ in range(n))


def hashed(text):
    table = paragraph_bands._Hashes()
    return np.array([table[w] for w in text.lower().encode().split()], np.uint64)


@pytest.fixture(scope="module")
def planted():
    dice = random.Random(11)
    passage = prose(dice, 60)
    cut = passage.split(" ")
    over_lines = " ".join(cut[:30]) + "\n" + " ".join(cut[30:])
    near = prose(dice, 80)
    texts = [
        prose(dice, 300) + " " + passage + " " + prose(dice, 250),
        "All rights reserved .\n" + prose(dice, 40),
        prose(dice, 200) + " " + over_lines + " " + prose(dice, 400) + "\nall rights  reserved .",
        prose(dice, 80),
        near,
        prose(dice, 20) + "\n" + near.replace(near.split(" ")[40], "other", 1) + "\n" + prose(dice, 20),
    ]
    return passage, texts


def test_a_passage_over_line_ends_and_a_near_paragraph(spark, planted):
    passage, texts = planted
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = paragraph_bands.repeated(docs).collect()
    whole = {(r["doc_id"], r["paragraph"], r["kept"], r["keep_doc_id"]) for r in found if r["kind"] == "paragraph"}
    assert whole == {(4, 0, True, 4), (5, 1, False, 4)}
    inside = [r for r in found if r["kind"] == "passage"]
    assert {(r["doc_id"], r["kept"], r["keep_doc_id"]) for r in inside} == {(0, True, 0), (2, False, 0)}
    for r in inside:
        words = " ".join(texts[r["doc_id"]].split("\n")[r["paragraph"] :]).split()[r["start"] : r["start"] + r["length"]]
        assert " ".join(words) in passage and len(words) == r["length"] >= paragraph_bands.PASSAGE
    left = {r["doc_id"]: r["text"] for r in paragraph_bands.dedup(docs).collect()}
    assert [left[i] for i in (0, 1, 3, 4)] == [texts[i] for i in (0, 1, 3, 4)]
    assert len(left[2].split()) == 664 - sum(r["length"] for r in inside if not r["kept"])
    assert left[5] == "\n".join(texts[5].split("\n")[::2])
    longer = {r["doc_id"]: r["text"] for r in paragraph_bands.dedup(docs, least_words=100).collect()}
    assert [longer[i] for i in range(5)] == texts[:5]


def test_a_removed_last_paragraph_takes_its_line_end_along():
    assert paragraph_bands.without("a b\nc d\ne f", {2}, []) == "a b\nc d"
    assert paragraph_bands.without("a b\nc d\ne f", {0}, []) == "c d\ne f"
    assert paragraph_bands.without("a b\nc d\n", {1}, []) == "a b\n"
    assert paragraph_bands.without("a b c d", set(), [(1, 2, False)]) == "a  d"
    assert paragraph_bands.without("a b c d", set(), [(1, 2, False), (2, 2, True)]) == "a  c d"


def test_every_shared_run_of_fifty_words_is_found():
    dice = random.Random(3)
    run_words = paragraph_bands.PASSAGE + paragraph_bands.REACH - 1
    for _ in range(300):
        run = prose(dice, run_words)
        found = [set(zip(*[x.tolist() for x in paragraph_bands.windows([(0, 0, hashed(prose(dice, dice.randint(0, 60)) + " " + run + " " + prose(dice, dice.randint(0, 60))))])[2:]], strict=True)) for _ in range(2)]
        assert found[0] & found[1]


def test_windows_do_not_depend_on_stretches(monkeypatch):
    dice = random.Random(5)
    texts = [prose(dice, n) for n in (26, 27, 49, 50, 51, 400, 1000)] + ["again " * 300, "a b c " * 200]
    whole = [[x.tolist() for x in paragraph_bands.windows([(0, 0, hashed(t))])] for t in texts]
    monkeypatch.setattr(paragraph_bands, "STRETCH", 64)
    for text, want in zip(texts, whole, strict=True):
        h = hashed(text)
        parts = [(0, base, h[base : base + 64 + 26 + 25 - 2]) for base in range(0, max(1, len(h) - 26 - 25 + 2), 64)]
        assert [x.tolist() for x in paragraph_bands.windows(parts)] == want
    both = paragraph_bands.windows([(i, 0, hashed(t)) for i, t in enumerate(texts)])
    assert [[x[both[0] == i].tolist() for x in both[1:]] for i in range(len(texts))] == [w[1:] for w in whole]


def test_passages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    found = paragraph_bands.repeated(spark.createDataFrame(docs)).collect()
    gone = {(r["doc_id"], r["paragraph"]) for r in found if r["kind"] == "paragraph" and not r["kept"]}
    groups = defaultdict(set)
    for r in docs:
        words = [(w, p) for p, line in enumerate((r["text"] or "").split("\n")) for w in line.encode().lower().split()]
        if len(words) >= paragraph_bands.PASSAGE:
            table = paragraph_bands._Hashes()
            _, at, *_ = paragraph_bands.windows([(0, 0, np.array([table[w] for w, _ in words], np.uint64))])
            for a in at.tolist():
                part = words[a : a + paragraph_bands.PASSAGE]
                if not any((r["doc_id"], p) in gone for p in range(part[0][1], part[-1][1] + 1)):
                    groups[tuple(w for w, _ in part)].add((r["doc_id"], a))
    want = defaultdict(set)
    for places in groups.values():
        if len(places) > 1:
            for d, a in places:
                want[d, (d, a) == min(places)] |= set(range(a, a + paragraph_bands.PASSAGE))
    got = defaultdict(set)
    before = {(r["doc_id"], p): sum(len(x.encode().split()) for x in (r["text"] or "").split("\n")[:p]) for r in docs for p in range((r["text"] or "").count("\n") + 1)}
    for r in found:
        if r["kind"] == "passage":
            at = before[r["doc_id"], r["paragraph"]] + r["start"]
            got[r["doc_id"], r["kept"]] |= set(range(at, at + r["length"]))
    assert got == want and want
