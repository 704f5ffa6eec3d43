"""Hashes of words made over all bytes at once: equal for equal words only, whatever texts and pieces they lie in."""

import random

import numpy as np
import pytest

from heddle.llm import near


def words(text):
    return text.encode("utf-8", "replace").lower().split()


@pytest.mark.parametrize("piece", [7, 100, 1 << 20])
def test_equal_words_have_equal_hashes(piece, monkeypatch):
    monkeypatch.setattr(near, "PIECE", piece)
    dice = random.Random(3)
    letters = "abcABC é字\n\t  \v\f\r\x1c\xa0"
    texts = ["", " ", "\n\n", "a", " a", "a ", "x" * 5_000, "x" * 4_999, "A\x00b a\x00B", "0", "00", "\x00", "\x00\x00", "\ud800"] + ["".join(dice.choice(letters) for _ in range(dice.randint(0, 60))) for _ in range(3_000)]
    h, sizes = near.hashed_words(texts)
    found = [words(t) for t in texts]
    assert sizes.tolist() == [len(f) for f in found]
    of = {}
    for word, x in zip((w for f in found for w in f), h.tolist(), strict=True):
        assert of.setdefault(word, x) == x
    assert len(set(of.values())) == len(of) > 2_000
    assert near.hashed_words([])[1].tolist() == [] and near.hashed_words(["", "\n"])[0].tolist() == []


def test_sets_are_the_distinct_shingles():
    dice = random.Random(5)
    texts = [" ".join(dice.choice("abcde") for _ in range(dice.randint(0, 40))) for _ in range(400)]
    sets = near.shingle_sets(*near.hashed_words(texts))
    names = {}
    for text, got in zip(texts, sets, strict=True):
        w = words(text)
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        assert len(got) == len(want) and (np.diff(got.astype(object)) > 0).all()
        for shingle in want:
            names.setdefault(shingle, None)
    # Sets of two texts share as many hashes as shingles.
    for i in range(0, 400, 7):
        for j in range(i, 400, 31):
            a, b = (words(texts[k]) for k in (i, j))
            grams = [({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for w in (a, b)]
            assert len(np.intersect1d(sets[i], sets[j])) == len(grams[0] & grams[1])
