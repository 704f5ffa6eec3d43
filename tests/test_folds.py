"""Folds without gathering against one pass over each key."""

import random

import pytest

from heddle.operators import chunks, folds


def plain(rows, reach, strict):
    """group of each (key, order) for rows (key, order, value)."""
    out, by = {}, {}
    for key, order, value in rows:
        if value is not None:
            by.setdefault(key, []).append((value, order))
    for key, held in by.items():
        first, group = None, -1
        for value, order in sorted(held):
            if first is None or value - first > reach or (value - first == reach and not strict):
                first, group = value, group + 1
            out[key, order] = group
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_groups_equal_one_pass(spark, strict):
    dice = random.Random(7)
    rows = []
    for key, n, step in (("long", 900, 3), ("wide", 60, 40), (None, 30, 2), ("flat", 50, 0), ("one", 1, 1)):
        value = dice.randint(-50, 50)
        for order in range(n):
            value += dice.randint(0, step)
            rows.append((key, order, float(value)))
    rows.append(("one", 7, None))
    dice.shuffle(rows)
    table = spark.createDataFrame(rows, "key string, order long, value double")
    got = folds.grouped(table, "key", "order", "value", 10, strict).collect()
    assert {(r["key"], r["order"]): r["group"] for r in got} == plain(rows, 10, strict) and len(got) == len(rows) - 1


def test_empty(spark):
    assert folds.grouped(spark.createDataFrame([], "key string, order long, value double"), "key", "order", "value", 5).count() == 0


def test_lines_of_crowded_pages(spark):
    """Many items on one height, equal items, null texts; a line is measured from its first item."""
    dice = random.Random(2)
    items = [(p, float(dice.randint(0, 9)), round(dice.uniform(0, 30), 1), dice.choice(["a", "b", None])) for p in (1, 2) for _ in range(120)] + [(3, 1.0, 5.0, "x")] * 40
    got = {(r["page"], r["line"]): (r["x"], r["y"], r["text"]) for r in chunks.lines(spark.createDataFrame(items, "page int, x double, y double, text string")).collect()}
    want = {}
    for page in (1, 2, 3):
        held, first, line = {}, None, -1
        for y, x, t in sorted(((round(-y * 1e6), x, t) for p, x, y, t in items if p == page), key=lambda i: i[0]):
            if first is None or y - first > 2_000_000:
                first, line = y, line + 1
            held.setdefault(line, []).append((x, t, -y / 1e6))
        for line, rows in held.items():
            words = [t for _, t, _ in sorted(rows, key=lambda i: (i[0], i[1] is not None, i[1] or "")) if t is not None]
            want[page, line] = (min(r[0] for r in rows), max(r[2] for r in rows), " ".join(words))
    assert got == want


def test_pages_of_many_documents(spark):
    pages = spark.createDataFrame([(d, p, 10.0 * p) for d in (1, 2) for p in range(5)], "doc int, page int, height double")
    got = {(r["doc"], r["page"]): r["top"] for r in chunks.page_offsets(pages, "doc").collect()}
    assert got == {(d, p): sum(10.0 * q + 50 for q in range(p)) for d in (1, 2) for p in range(5)}
