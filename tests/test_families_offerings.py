"""Edge cases of timelines, support and offerings; their queries are held against SQL in the catalog."""

import datetime as dt
import itertools
import math
import random

from placelens.functions.numbers import exact_sum
from placelens.operators import offerings as O
from placelens.operators import scoring, scratch, support, timeline
from placelens.plans import families
from pyspark.sql import functions as F

_FLAGS = ("has_partner", "user_works", "partner_works", "user_exempt", "partner_exempt", "earns_enough", "over_100k", "in_england", "public_funds", "ni_number", "fostered", "disabled", "low_income", "on_uc", "has_send", "benefit")


def test_timeline_is_evaluation_by_date(spark):
    rng = random.Random(3)
    rows = [(k, rng.randint(2005, 2027), rng.randint(1, 12), *(rng.random() < 0.6 for _ in _FLAGS)) for k in range(150)]
    children = spark.createDataFrame(rows, "child_id int, birth_year int, birth_month int, " + ", ".join(f"{f} boolean" for f in _FLAGS)).cache()
    for at in (dt.date(2026, 6, 15), dt.date(2026, 12, 1), dt.date(2027, 8, 31)):
        dates = [at] + [dt.date(at.year + (at.month + k - 1) // 12, (at.month + k - 1) % 12 + 1, 1) for k in range(1, 13)]
        states = {}
        for d in dates:
            for r in scoring.entitlements(children, F.lit(d)).collect():
                states.setdefault((r.child_id, r.scheme), []).append(r.eligible)
        want = {(*k, "loss" if v[0] else "gain", dates[next(i for i, x in enumerate(v) if x != v[0])]) for k, v in states.items() if len(set(v)) > 1}
        got = timeline.transitions(timeline.joined(timeline.scheme_intervals(children)), F.lit(at))
        assert {tuple(r) for r in got.collect()} == want and len(want) > 10


def test_joined_intervals(spark):
    d = lambda k: dt.date(2026, 1, 1) + dt.timedelta(days=k)
    rows = [(1, "a", d(0), d(10)), (1, "a", d(2), d(5)), (1, "a", d(10), d(12)), (1, "a", d(13), d(14)), (1, "b", d(0), d(3)), (2, "a", d(9), d(11)), (2, "a", d(9), d(11))]
    got = timeline.joined(spark.createDataFrame(rows, "child_id int, scheme string, start date, stop date")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", d(0), d(12)), (1, "a", d(13), d(14)), (1, "b", d(0), d(3)), (2, "a", d(9), d(11))]


def test_cut_by_spells(spark):
    d = lambda k: dt.date(2026, 1, 1) + dt.timedelta(days=k)
    rows = [(1, "a", d(0), d(10)), (1, "b", d(0), d(10)), (2, "a", d(0), d(10)), (2, "b", d(3), d(4)), (3, "a", d(5), d(9))]
    spells = [(1, d(2), d(4)), (1, d(3), d(20)), (1, d(10), d(12)), (3, d(0), d(30)), (4, d(0), d(9))]
    got = timeline.cut(spark.createDataFrame(rows, "child_id int, scheme string, start date, stop date"), spark.createDataFrame(spells, "child_id int, start date, stop date"), ("a",))
    assert sorted(map(tuple, got.collect())) == [(1, "a", d(2), d(4)), (1, "a", d(3), d(10)), (1, "b", d(0), d(10)), (2, "b", d(3), d(4)), (3, "a", d(5), d(9))]


def test_timeline_deals_children_by_their_number(spark):
    assert scratch.dealt(spark.range(1000), "id", rows=10).rdd.getNumPartitions() == 100
    plan = families.scheme_timeline(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan


def test_support_shares_sum_to_the_award(spark):
    rng, rows = random.Random(1), []
    for family in range(60):
        for child in range(rng.randint(1, 5)):
            fees = [round(rng.uniform(0, 9000), 2) for _ in range(3)]
            rows.append((family, child, rng.random() < 0.7, rng.random() < 0.7, rng.random() < 0.2, family % 2 == 0, None, *fees, 0.0, 0.0, 0.0))
    kind = "family int, child int, tfc_eligible boolean, uc_eligible boolean, disabled boolean, on_uc boolean, charges double, fees_lower double, fees_mean double, fees_upper double, saved_lower double, saved_mean double, saved_upper double"
    got = support.by_child(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 3 * len(rows) and {r.kind for r in got} == {"tfc", "uc"}
    for variant, at in (("lower", 7), ("mean", 8), ("upper", 9)):
        for family in range(60):
            own, mine = [r for r in rows if r[0] == family], [r for r in got if (r.family, r.variant) == (family, variant)]
            if family % 2:
                assert all(r.uc == 0 for r in mine)
                continue
            able = [r for r in own if r[3]]
            cost = sum(r[at] for r in able)
            award = round(min(cost / 12 * 0.85, 1031.88 if len(able) == 1 else 1768.94) * 12, 2) if able else 0
            assert abs(sum(r.uc for r in mine) - award) < 0.011 and all(r.tfc == 0 for r in mine)


def test_no_order_of_rows_decides_between_equal_supports(spark):
    """604.8 + 491.4 + 1474.2 is 2570.4, or a little less, by the order in which doubles are added."""
    values = (3024.0, 2457.0, 7371.0)
    rows = [(f"f{k}", n, True, n == 0, False, False, None, 0.0, x, 0.0, 0.0, 0.0, 0.0) for k, order in enumerate(itertools.permutations(values)) for n, x in enumerate(order)]
    kind = "family string, child int, tfc_eligible boolean, uc_eligible boolean, disabled boolean, on_uc boolean, charges double, fees_lower double, fees_mean double, fees_upper double, saved_lower double, saved_mean double, saved_upper double"
    df = spark.createDataFrame(rows, kind).coalesce(1)
    got = support.by_child(df, F.col("tfc_total") < 2570.4).where("variant = 'mean'").select("family", "kind").distinct().collect()
    assert len(got) == 6 and len({r.kind for r in got}) == 1
    for values in ([0.1] * 10, [4000.0, 0.01, 75.6, 1474.2], [-0.07, 378.0, -1e9, 0.3], [None, 2.5], [None]):
        (one,) = spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum(F.col("x")).alias("s")).collect()
        known = [v for v in values if v is not None]
        assert one.s == (math.fsum(known) if known else None)


def test_offerings_of_odd_rows(spark):
    listings = spark.createDataFrame([("E1", "1", ["a", None, "a"], ["x"], "N", " "), ("E1", "1", ["a"], None, "M", "N/A"), ("E1", "2", None, None, None, None), ("E1", "2", None, None, None, None)], "area string, provider_id string, classes array<string>, labels array<string>, name string, postcode string")
    links = spark.createDataFrame([("E1", "1", "u", None), ("E1", "2", None, None)], "area string, provider_id string, urn string, school_urn string")
    got = O.claims(O.listed(listings, links)).collect()
    assert sorted((r.source_id, r.care_type or "", r.name or "", r.method) for r in got) == [("E1:1", "", "N", "structured"), ("E1:1", "a", "M", "structured"), ("E1:2", "", "", "none"), ("E1:2", "", "", "none")]
    assert all(r.postcode is None for r in got)
    (one,) = O.settled(O.claims(O.listed(listings, links))).collect()
    assert (one.place, one.care_type, one.conflicts) == ("u", "a", [])
    assert O.settled(O.claims(O.listed(listings.limit(0), links))).collect() == []


def test_variants_are_rows_only_after_all_shuffles(spark):
    """A row per variant would be shuffled three times over."""
    df = spark.range(1).selectExpr("CAST(id AS STRING) AS family", "id AS child", "id > 0 AS tfc_eligible", "id > 1 AS uc_eligible", "id > 2 AS disabled", "id > 3 AS on_uc", "CAST(id AS DOUBLE) AS charges", *(f"CAST(id AS DOUBLE) AS {k}_{v}" for k in ("fees", "saved") for v in support.VARIANTS))
    plan = support.by_child(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [k for k, line in enumerate(plan) if "Generate" in line]
    assert len(made) == 1 and made[0] < min(k for k, line in enumerate(plan) if "Join" in line or "Aggregate" in line)
