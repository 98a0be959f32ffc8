"""The q-gram index against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from placelens.operators import similar

WORDS = ("little", "acorns", "st", "saint", "marys", "mary", "primary", "school", "nursery", "oak", "oaks", "tree", "infant", "junior", "a", "ab", "é", "the", "of", "pre-school", "kids", "kid", "club")


def _texts(seed, n):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 6))) for _ in range(n)]
    for t in list(out):  # near copies
        t = list(t)
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice("abcxyz é")
        out.append("".join(t))
    return out + ["", None, "a", "ab", "ba", "aa", "aaaa", "aaab", "abab", "baba", "x" * 220, "x" * 215 + "yzyzy", "abc " * 60, "abd " * 60]


@pytest.mark.parametrize(("threshold", "few"), [(0.55, 0), (0.75, 0), (0.8, 0), (0.85, 0), (0.92, 0), (1.0, 0), (0.8, 64), (0.8, 10**6)])
def test_no_pair_is_missed(spark, threshold, few):
    left, right = _texts(1, 60), _texts(2, 60)
    df = lambda texts: spark.createDataFrame([(k % 2 if k % 17 else None, t) for k, t in enumerate(texts)], "area int, text string")
    got = {(r.area, r.text, r.match_text): r.ratio for r in similar.similar_pairs(df(left + left[:9] * 2), df(right + left[:30:2]), ["area"], threshold, few).collect()}
    want = {}
    for i, a in enumerate(left + left[:9] * 2):
        for j, b in enumerate(right + left[:30:2]):
            if i % 17 and j % 17 and i % 2 == j % 2 and a and b:
                ratio = SequenceMatcher(None, a, b).ratio()
                if ratio >= threshold:
                    want[i % 2, a, b] = ratio
    assert got == want and len(want) > 5


def test_best(spark):
    left = spark.createDataFrame([(1, "p", "little acorns"), (2, "p", "little acorns"), (3, "q", "little acorns"), (4, "p", None), (5, "p", "zzz")], "id int, postcode string, text string")
    right = spark.createDataFrame([(9, "p", "little acorn"), (8, "p", "little acorn"), (7, "p", "little oaks"), (6, None, "little acorns")], "id int, postcode string, text string")
    got = sorted(map(tuple, similar.best_similar(left, right, ["postcode"], 0.8).collect()))
    assert got == [(1, 8, pytest.approx(0.96)), (2, 8, pytest.approx(0.96))]
    assert similar.best_similar(left.limit(0), right, ["postcode"], 0.8).collect() == []


def test_one_name_does_not_meet_itself_many_times(spark):
    """Rows that share a text are compared once."""
    rows = spark.range(3000).selectExpr("id", "'p' AS postcode", "'the same name' AS text")
    assert similar.similar_pairs(rows, rows, ["postcode"], 0.8, few=0).count() == 1
    best = similar.best_similar(rows, rows, ["postcode"], 0.8)
    assert best.count() == 3000 and best.where("match_id <> 0").count() == 0


@pytest.mark.parametrize("threshold", [0.55, 0.8, 0.92])
def test_best_in_dense_blocks(spark, threshold):
    """Numbered names share their grams: blocks are scanned in parts, with the same best partner as all pairs have."""
    rng = random.Random(5)
    texts = lambda n: [f"customer {rng.randint(0, 10**rng.randint(1, 6))}" for _ in range(n)] + ["", None, "x" * 220, "customer " * 9, "customer " * 9 + "1", "é9", "customer"]
    left, right = texts(150), texts(200)
    best = {}
    for i, a in enumerate(left):
        found = [(-SequenceMatcher(None, a, b).ratio(), j) for j, b in enumerate(right) if a and b and i % 2 == j % 2]
        ratio, j = min(found, default=(0, 0))
        if -ratio >= threshold:
            best[i] = (j, -ratio)
    df = lambda rows: spark.createDataFrame([(k, k % 2, t) for k, t in enumerate(rows)], "id long, area int, text string")
    seen = []
    scanned, similar._scanned = similar._scanned, lambda *a: seen.append(1) or scanned(*a)
    try:
        got = {r.id: (r.match_id, r.ratio) for r in similar.best_similar(df(left), df(right), ["area"], threshold, few=20, part=30).collect()}
    finally:
        similar._scanned = scanned
    assert seen and got == best


def test_order_of_candidates():
    texts = ["a", "ab", "abc" * 30, "", "xyz"]
    assert similar.best_of(["ab", "ba", "abc" * 31, "q"], texts, 0.6) == [(1, 1.0), (0, 2 / 3), (2, 2 * 90 / 183), None]


def test_one_text_in_many_blocks_is_spread(spark):
    """Rows go by block too: a name that every postcode has must not be one task's work."""
    rows = [(f"p{k}", "oak nursery") for k in range(400)]
    side = spark.createDataFrame(rows, "block string, text string")
    pairs = similar.similar_pairs(side, side, ["block"], 0.8)
    sizes = pairs.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 400 and max(sizes) < 200
