"""Configurations of the packing plan: the dearest one against all, and plans against best-fit decreasing."""

import itertools
import random

import numpy as np

from heddle.llm import group_pack


def test_the_dearest_configuration_is_found():
    dice = random.Random(1)
    for _ in range(200):
        capacity = dice.randint(20, 60)
        sizes = np.array(sorted({dice.randint(capacity // 4 + 1, capacity) for _ in range(dice.randint(1, 7))}, reverse=True))
        price = np.array([round(dice.uniform(-0.2, 1), 3) for _ in sizes])
        worth, pattern = group_pack._dearest(sizes, price, capacity)
        best = max(sum(price[i] for i in c) for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(len(sizes)), n) if sum(sizes[i] for i in c) <= capacity)
        assert abs(worth - best) < 1e-9 and pattern @ sizes <= capacity and abs(price @ pattern - worth) < 1e-9


def best_fit_decreasing(histogram, capacity):
    classes = group_pack._Classes(capacity)
    for s in sorted(histogram, reverse=True):
        classes.best_fit(s, histogram[s])
    return sum(n for gap in classes.gaps for n, _ in classes.gaps[gap])


def test_configurations_save_sequences():
    """Lengths as they come, and lengths that best fit pairs badly: 3 of 341 and 2 of 512 fill a sequence, mixed ones do not."""
    dice = random.Random(4)
    drawn = {}
    for _ in range(40_000):
        s = min(1023, max(1, int(dice.lognormvariate(5.8, 0.7))))
        drawn[s] = drawn.get(s, 0) + 1
    for histogram in (drawn, {511: 900, 400: 700, 341: 1_500, 284: 1_300, 257: 800, 600: 500, 10: 50}):
        plan = group_pack.plan(histogram)
        placed = {}
        for n, lengths in plan:
            assert sum(lengths) <= group_pack.CAPACITY
            for s in lengths:
                placed[s] = placed.get(s, 0) + n
        assert placed == histogram
        # The drawn ones leave best fit little to lose: their volume is nearly reached.
        least = -(-sum(s * n for s, n in histogram.items()) // group_pack.CAPACITY)
        best = best_fit_decreasing(histogram, group_pack.CAPACITY)
        assert least <= sum(n for n, _ in plan) < best or histogram is drawn and sum(n for n, _ in plan) <= best
