"""Simplified areas keep their common borders."""

import json
import math
import random

import pytest
from placelens.operators import topology
from placelens.sources import geojson

_KIND = "id long, rings array<array<struct<x: double, y: double>>>"


def _mesh(n, seed, wiggle=0.05, m=12):
    """n * n areas with ragged borders; corners and border points are made once, so that neighbours have the same."""
    rng = random.Random(seed)
    corner = {(i, j): (i + rng.uniform(-0.2, 0.2), j + rng.uniform(-0.2, 0.2)) for i in range(n + 1) for j in range(n + 1)}
    edges = {}

    def edge(a, b):
        if (b, a) in edges:
            return edges[b, a][::-1]
        if (a, b) not in edges:
            (ax, ay), (bx, by) = corner[a], corner[b]
            inner = [(ax + (bx - ax) * t / m + rng.uniform(-wiggle, wiggle), ay + (by - ay) * t / m + rng.uniform(-wiggle, wiggle)) for t in range(1, m)]
            edges[a, b] = [corner[a], *inner, corner[b]]
        return edges[a, b]

    out = {}
    for i in range(n):
        for j in range(n):
            way = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1), (i, j)]
            points = [p for a, b in zip(way, way[1:], strict=False) for p in edge(a, b)[:-1]]
            at = rng.randrange(len(points))
            points = points[at:] + points[:at]
            if rng.random() < 0.5:
                points.reverse()
            out[i * n + j] = [points + points[:1]]
    return out


def _df(spark, areas):
    return spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in areas.items()], _KIND).repartition(3)


def _back(df):
    return {r.id: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in df.collect()}


def _area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def _segments(areas):
    out = {}
    for k, rings in areas.items():
        for r in rings:
            for a, b in zip(r, r[1:], strict=False):
                out.setdefault((min(a, b), max(a, b)), set()).add(k)
    return out


@pytest.mark.parametrize("tolerance", [0.02, 0.1, 10.0])
def test_neighbours_keep_their_borders(spark, tolerance):
    areas = _mesh(4, 7)
    got = _back(topology.simplify(_df(spark, areas), tolerance))
    assert set(got) == set(areas)
    before, after = _segments(areas), _segments(got)
    for rings in got.values():
        assert all(r[0] == r[-1] and len(set(r)) >= 3 for r in rings)
    pairs = lambda s: {tuple(sorted(v)) for v in s.values() if len(v) == 2}
    assert pairs(after) == pairs(before)
    ends = {}
    for (a, b), who in after.items():  # each border between two areas is one unbroken line of common points
        if len(who) == 2:
            for p in (a, b):
                ends.setdefault(tuple(sorted(who)), {}).setdefault(p, 0)
                ends[tuple(sorted(who))][p] += 1
    assert all(sorted(n.values()).count(1) == 2 for n in ends.values())
    # no gap or overlap: the areas sum to that of the outer border
    outer = [s for s, who in after.items() if len(who) == 1]
    total = sum(abs(_area(r[0])) for r in got.values())
    follow = {}
    for rings in got.values():
        ring = rings[0] if _area(rings[0]) > 0 else rings[0][::-1]
        for a, b in zip(ring, ring[1:], strict=False):
            if (min(a, b), max(a, b)) in set(outer):
                follow[a] = b
    at = start = next(iter(follow))
    loop = [start]
    while True:
        at = follow[at]
        loop.append(at)
        if at == start:
            break
    assert math.isclose(total, _area(loop), rel_tol=1e-9)
    assert sum(len(r[0]) for r in got.values()) < sum(len(r[0]) for r in areas.values())


def test_tolerance_zero_and_exact_distance(spark):
    areas = _mesh(2, 1)
    got = _back(topology.simplify(_df(spark, areas), 0.0))
    assert {k: {frozenset(s) for s in zip(r[0], r[0][1:], strict=False)} for k, r in got.items()} == {k: {frozenset(s) for s in zip(r[0], r[0][1:], strict=False)} for k, r in areas.items()}


def test_enclave_shares_its_ring_and_never_collapses(spark):
    circle = [(math.cos(t / 10) * 0.3, math.sin(t / 10) * 0.3) for t in range(62)]
    turned = (circle[20:] + circle[:20])[::-1]
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0), (-1.0, -1.0)]
    got = _back(topology.simplify(_df(spark, {1: [square, turned + turned[:1]], 2: [circle + circle[:1]]}), 5.0))
    assert set(got[1][1]) == set(got[2][0]) and len(set(got[2][0])) == 3
    assert len(set(got[1][0])) >= 3


def test_crossing_arcs_are_taken_back(spark):
    # a spike of the first area reaches through a notch that simplifying would close
    notch = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (2.2, 1.0), (2.0, 0.2), (1.8, 1.0), (0.0, 1.0), (0.0, 0.0)]
    spike = [(0.0, 1.5), (1.9, 1.5), (2.0, 0.4), (2.1, 1.5), (4.0, 1.5), (4.0, 3.0), (0.0, 3.0), (0.0, 1.5)]
    lines = {1: notch, 2: spike}
    plain = {k: topology.simplified_arc(v, 0.85, False) for k, v in lines.items()}
    assert (2.0, 0.2) not in plain[1] and (2.0, 0.4) in plain[2]
    got = _back(topology.simplify(_df(spark, {k: [v] for k, v in lines.items()}), 0.85))
    assert (2.0, 0.2) in got[1][0] and (2.0, 0.4) in got[2][0]


def test_odd_rings(spark):
    line = [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    same = [(5.0, 5.0), (5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (6.0, 6.0), (5.0, 5.0)]
    df = spark.createDataFrame([(1, []), (2, None), (3, [[{"x": x, "y": y} for x, y in line]]), (None, [[{"x": x, "y": y} for x, y in same]]), (4, [[{"x": 1.0, "y": 2.0}]])], _KIND)
    got = {r.id: r.rings for r in topology.simplify(df, 0.1).collect()}
    assert set(got) == {3, None, 4} and len(got[None][0]) == 4
    assert topology.simplify(spark.createDataFrame([], _KIND), 1.0).collect() == []


def test_shared_borders(spark):
    a = [(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (1.25, 0.75), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    b = [(1.0, 1.0), (1.25, 0.75), (1.0, 0.5), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]
    (r,) = topology.shared_borders(_df(spark, {1: [a], 2: [b]})).collect()
    assert (r.a, r.b) == (1, 2) and math.isclose(r.length, 0.5 + 2 * math.hypot(0.25, 0.25))


def test_geojson(spark, tmp_path):
    a = [[[0, 0], [1, 0], [1, 0.5], [1.01, 0.75], [1, 1], [0, 1], [0, 0]]]
    b = [[[[1, 1], [1.01, 0.75], [1, 0.5], [1, 0], [2, 0], [2, 1], [1, 1]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5.5, 5.2], [5.7, 5.2], [5.7, 5.4], [5.5, 5.2]]]]
    features = [
        {"type": "Feature", "properties": {"code": "A", "name": "é"}, "geometry": {"type": "Polygon", "coordinates": a}},
        {"type": "Feature", "properties": {"code": "B", "name": None}, "geometry": {"type": "MultiPolygon", "coordinates": b}},
        {"type": "Feature", "properties": {"code": ""}, "geometry": {"type": "Polygon", "coordinates": a}},
        {"type": "Feature", "properties": {"code": "C"}, "geometry": None},
        {"type": "Feature", "properties": {"code": "D"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    got = geojson.read_simplified(spark, f"file://{tmp_path}/a.geojson", "code", ["name"], 0.05)
    rows = {r.code: r for r in got.collect()}
    assert set(rows) == {"A", "B"} and rows["A"].name == "é" and rows["B"].part == [0, 1, 1]
    # the bump of 0.01 goes, and the border is one line from corner to corner on both sides
    assert {(p.x, p.y) for p in rows["A"].rings[0]} == {(0, 0), (1, 0), (1, 1), (0, 1)}
    assert (rows["B"].south, rows["B"].west, rows["B"].north, rows["B"].east) == (0, 1, 6, 6)
    text = json.loads(got.where("code = 'B'").select(geojson.feature(["code", "name"]).alias("f")).first().f)
    assert [len(p) for p in text["geometry"]["coordinates"]] == [1, 2] and text["properties"]["code"] == "B"


def test_rows_of_small_files_are_not_broadcast(spark, monkeypatch):
    """Points are far more than the bytes of their file say: neither side of a join on them goes to the driver."""
    plans, written = [], topology.scratch.written
    monkeypatch.setattr(topology.scratch, "written", lambda df: (plans.append(df._jdf.queryExecution().toString()), written(df))[1])
    topology.arcs_of(_df(spark, _mesh(2, 3)))
    topology.crossings(spark.createDataFrame([("a", [(0.0, 0.0), (1.0, 1.0)]), ("b", [(0.0, 1.0), (1.0, 0.0)])], "arc_id string, line array<struct<x: double, y: double>>"), 0.1).collect()
    assert plans and not any("BroadcastHashJoin" in p for p in plans)
