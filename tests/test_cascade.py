"""Parts of the link cascades on small tables; their tiers are held against SQL in the catalog."""

import math
import random

from placelens.functions import geo, names
from placelens.operators import cascade
from pyspark.sql import functions as F


def test_nearest_within(spark):
    rng, left, right = random.Random(2), [], []
    for k in range(80):
        lat = rng.choice((51.5, 0.0, -33.9, 84.0))
        left.append((k, rng.choice(("a", "b", None)), lat + rng.uniform(-0.01, 0.01), 0.3 + rng.uniform(-0.02, 0.02)))
        right.append((k, rng.choice(("a", "b")), lat + rng.uniform(-0.01, 0.01), 0.3 + rng.uniform(-0.02, 0.02)))
    left += [(100, "a", None, 1.0), (101, "a", 51.5, 0.3)]
    right += [(200, "a", 51.5, 0.3), (150, "a", 51.5, 0.3), (300, "a", 51.5, None)]
    kind = "id int, area string, lat double, lon double"
    got = {r.id: (r.match_id, r.metres) for r in cascade.nearest_within(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), 700.0).collect()}

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2000 * geo.EARTH_KM * math.asin(math.sqrt(h))

    want = {}
    for k, area, lat, lon in left:
        near = sorted((metres(lat, lon, b, x), j) for j, own, b, x in right if own == area and None not in (lat, b, x))
        if near and near[0][0] <= 700:
            want[k] = near[0]
    assert {k: m for k, (m, _) in got.items()} == {k: j for k, (_, j) in want.items()} and got[101] == (150, 0.0)
    assert all(abs(got[k][1] - want[k][0]) < 1e-3 for k in got) and len(got) > 15


def _one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]


def test_names(spark):
    assert _one(spark, names.without_category, "Oak - Childcare providers", "Oak-Before & After School Care - Childminders and childcare Providers ", "Childcare providers", "- Childcare providers", None) == ["Oak", "Oak", "Childcare providers", "- Childcare providers", None]
    assert _one(spark, names.unqualified, "Oak (Leeds)", "Oak (a) (b)", "Oak ()", "Oak) x)", "Elm – Day Nursery (am)", "(x)", "Oak", "Oak (a(b)", None) == ["Oak", "Oak (a)", None, None, "Elm", None, None, "Oak (a", None]
    assert _one(spark, names.merge_name, "St Mary’s – the Nursery_1", "É Pre-School Ltd.", "Other", None) == ["st mary s nursery_1", "é", "other", None]
    assert _one(spark, names.after_at, "A @ B", "A@", "A", "A @ B @ C", None) == ["B", None, None, "B @ C", None]


def test_links_of_odd_rows(spark):
    left = spark.createDataFrame([(1, None, None, None, None, None), (2, "E1", "", "", "", ""), (3, "N1", "EY1", "x", "p", "x")], "id int, area string, urn string, name string, postcode string, address string")
    right = spark.createDataFrame([("EY1", None, None, None, None), (None, "x", "x", "p", "x")], "urn string, name string, registered_name string, postcode string, address string")
    got = {r.id: (r.match_id, r.method) for r in cascade.inspection_links(left, right).collect()}
    assert got == {1: (None, "unmatched"), 2: (None, "unmatched"), 3: (None, "not_applicable")}
    schools = spark.createDataFrame([], "urn string, name string, postcode string, address string, area string, lat double, lon double")
    rows = left.withColumns({"kind": F.lit("holiday_club"), "lat": F.lit(0.0), "lon": F.lit(None).cast("double")})
    got = {r.id: (r.match_id, r.method) for r in cascade.school_links(rows, schools, right.select("urn")).collect()}
    assert got == {1: (None, "unmatched"), 2: (None, "unmatched"), 3: (None, "not_applicable")}
