"""The local search of packing ends only at the bound or where no exchange helps."""

import random
from collections import Counter
from itertools import combinations

import pytest
from placelens.llm import packing


def _pieces(plan):
    out = Counter()
    for p, n in plan.items():
        for x in p:
            out[x] += n
    return out


def _helps(a, b, size):
    slack = size - sum(a)
    gains = [y for y in b] + [y - x for y in b for x in a]
    gains += [sum(p) - x for p in combinations(b, 2) for x in a] + [y - sum(p) for y in b for p in combinations(a, 2)]
    return any(0 < g <= slack for g in gains)


@pytest.mark.parametrize(("size", "least", "n"), [(100, 24, 300), (100, 20, 1000), (300, 74, 400), (2048, 500, 300), (64, 1, 40)])
def test_no_exchange_is_left(size, least, n):
    rng = random.Random(size + n)
    lengths = [min(size, least + int(rng.expovariate(6 / size))) for _ in range(n)]
    start = packing.best_fit(Counter(lengths), size)
    plan = packing.local_search(start, size)
    assert _pieces(plan) == Counter(lengths) and all(sum(p) <= size and m > 0 for p, m in plan.items())
    bins, bound = sum(plan.values()), -(-sum(lengths) // size)
    assert bins <= sum(start.values())
    if bins > bound:
        for a in plan:
            for b in plan:
                if sum(a) >= sum(b) and (a != b or plan[a] > 1):
                    assert not _helps(a, b, size), (a, b)


def test_exchange_within_a_pattern():
    plan = packing.local_search({(3, 2): 8}, 6)
    assert sum(plan.values()) == 7 and _pieces(plan) == Counter({3: 8, 2: 8})
