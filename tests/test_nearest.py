"""The nearest record of a like name against all pairs."""

import math
import random
from difflib import SequenceMatcher

import pytest
from placelens.operators import linkage

KIND = "id long, area int, name string, lat double, lon double"


def _km(a, b):
    (la, lo), (ma, mo) = a, b
    x = math.sin(math.radians(ma - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(ma)) * math.sin(math.radians(mo - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, x)))


def _rows(seed, n):
    rng = random.Random(seed)
    places = [(51.0, 0.0), (51.2, 0.3), (-30.0, 179.95), (-30.0, -179.95), (89.8, 10.0), (89.9, -170.0)]
    out = []
    for k in range(n):
        at = rng.choice(places)
        spot = (min(90.0, at[0] + rng.choice((0.001, 0.1, 0.6)) * rng.uniform(-1, 1)), at[1] + rng.choice((0.001, 0.1, 0.6)) * rng.uniform(-1, 1))
        out.append((k if k % 40 else k // 2, rng.choice((1, 2, None)), rng.choice(("oak", "oaks", "elm", "", None)), *(spot if k % 31 else (None, 1.0))))
    return out


@pytest.mark.parametrize("gate", [1.0, 0.8, 0.0, 1.01])
def test_against_all_pairs(spark, gate):
    left, right = _rows(1, 120), _rows(2, 300)
    best = {}
    for i, area, name, *at in left:
        for j, other, text, *to in right:
            if area is not None and area == other and None not in (name, text, at[0], to[0]) and SequenceMatcher(None, name, text).ratio() >= gate and _km(at, to) <= 40:
                best[i] = min(best.get(i, (1e9, 0)), (_km(at, to), j))
    made = lambda rows: spark.createDataFrame(rows, KIND)
    got = {r.id: r for r in linkage.near_in_scope(made(left), made(right), "area", 40.0, gate).collect()}
    assert set(got) == set(best)
    assert all(abs(got[i].km - km) < 1e-6 for i, (km, _) in best.items())
    assert all(got[i].match_id == j for i, (_, j) in best.items())


def test_pairs_are_not_made_in_dense_places(spark):
    """Equal names in one area: the plan meets on cells, not on the area alone."""
    rows = spark.range(400).selectExpr("id", "1 AS area", "'oak' AS name", "50 + id % 20 / 1000 AS lat", "id div 20 / 1000 AS lon")
    made = linkage.near_in_scope(rows, rows, "area", 40.0, 1.0)
    assert made.where("km = 0 and id = match_id").count() == 400
    met = linkage.nearest_by_cells(rows, rows.selectExpr("id AS match_id", "area", "lat AS r_lat", "lon AS r_lon"), ["area"], 40.0)
    assert met.count() == 400
