import io
import random
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import components, linkage, publish, quality, relational, scoring, spatial
from placelens.sources import flat, html, workbooks


def _providers(spark, n=300, seed=1):
    rng, rows = random.Random(seed), []
    for k in range(n):
        lat, lon = rng.uniform(51, 52), rng.uniform(-1, 1)
        box = k % 6 == 0
        rows.append((k, k % 8, None if box else lat, None if box else lon, *((lat, lon, lat + 0.05, lon + 0.05) if box else (None,) * 4)))
    return spark.createDataFrame(rows, "provider_id long, care_type int, lat double, lon double, bbox_south double, bbox_west double, bbox_north double, bbox_east double"), rows


@pytest.mark.parametrize("limit", [5, 500])
def test_spatial_search(spark, limit):
    df, rows = _providers(spark)
    queries = [(1, 51.5, 0.0, 51.4, -0.2, 51.6, 0.2), (2, 51.5, 0.0, 51.1, -0.9, 51.9, 0.9), (3, 60.0, 0.0, 59.9, -0.1, 60.1, 0.1)]
    got = {}
    for r in spatial.spatial_search(df, spark.createDataFrame(queries, "query_id long, q_lat double, q_lon double, south double, west double, north double, east double"), limit=limit).collect():
        got.setdefault((r.query_id, r.mode), set()).add(r.provider_id)
    import math

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * geo.EARTH_KM * math.asin(math.sqrt(min(1, h)))

    for q, lat, lon, s, w, n, e in queries:

        def hits(s, w, n, e):
            points, boxes = [], []
            for k, _, y, x, bs, bw, bn, be in rows:
                lo_y, lo_x, hi_y, hi_x = (y, x, y, x) if y is not None else (bs, bw, bn, be)
                if lo_y <= n and hi_y >= s and lo_x <= e and hi_x >= w:
                    d = km(lat, lon, y, x) if y is not None else max(km(lat, lon, a, b) for a in (bs, bn) for b in (bw, be))
                    (points if y is not None else boxes).append((d, k))
            return sorted(points), sorted(boxes)

        dy, dx = (n - s) / 2, (e - w) / 2
        points, boxes = hits(s - dy, w - dx, n + dy, e + dx)
        mode = "inflated"
        if len(points) > limit and max(km(lat, lon, a, b) for a in (s, n) for b in (w, e)) > points[limit - 1][0]:
            points, boxes = hits(s, w, n, e)
            mode = "exact"
        want = {k for _, k in points[:limit] + boxes[:limit]}
        assert got.get((q, mode), set()) == want


def test_search_meets_boxes_of_every_size(spark):
    rng = random.Random(5)
    rows = []
    for k in range(200):
        south, west, size = rng.uniform(-80, 60), rng.uniform(-170, 100), 10 ** rng.uniform(-3, 1.8)
        rows.append((k, 0, None, None, south, west, min(90.0, south + size), min(180.0, west + size)) if k % 2 else (k, 0, south, west, None, None, None, None))
    df = spark.createDataFrame(rows, "provider_id long, care_type int, lat double, lon double, bbox_south double, bbox_west double, bbox_north double, bbox_east double")
    views = [(q, 0.0, 0.0, s, w, s + h, w + h) for q, (s, w, h) in enumerate([(50.0, -1.0, 0.01), (-10.0, -20.0, 5.0), (0.0, 0.0, 40.0), (-90.0, -180.0, 180.0)])]
    got = spatial._hits(df, spark.createDataFrame(views, "query_id long, q_lat double, q_lon double, south double, west double, north double, east double"), tuple(map(F.col, ("south", "west", "north", "east"))), 1000)
    want = {(q, r[0]) for q, _, _, s, w, n, e in views for r in rows for a, b, c, d in [(r[2], r[3], r[2], r[3]) if r[2] is not None else r[4:]] if a <= n and c >= s and b <= e and d >= w}
    assert {(r.query_id, r.provider_id) for r in got.collect()} == want and len(want) > 100


def test_nearest_finds_far_places(spark):
    rng = random.Random(6)
    places = [(k, rng.gauss(51, 0.2), rng.gauss(0, 0.2)) for k in range(50)] + [(90, -60.0, 170.0)]
    points = [(1, 51.0, 0.0), (2, 40.0, 20.0), (3, -70.0, -175.0), (4, 51.01, 0.01)]
    got = {}
    for r in spatial.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, p_lat double, p_lon double"), 3).collect():
        got.setdefault(r.id, []).append((r.rank, r.place_id))
    for i, y, x in points:
        best = sorted(places, key=lambda p: ((p[1] - y) ** 2 + (p[2] - x) ** 2, p[0]))[:3]
        assert sorted(got[i]) == [(k + 1, p[0]) for k, p in enumerate(best)]
    few = spatial.nearest(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(places[:2], "place_id long, p_lat double, p_lon double"), 3)
    assert few.count() == 8


def test_coverage_of_keys_without_failures(spark):
    totals = spark.createDataFrame([("a", 4), ("b", 2), ("c", 0)], "k string, total long")
    failures = spark.createDataFrame([("a", "x"), ("c", "x")], "k string, f string")
    got = {(r.k, r.f): (r.present, r.pct) for r in relational.coverage(totals, failures, "k", "f", ["x", "y"]).collect()}
    assert got == {("a", "x"): (3, 75.0), ("a", "y"): (4, 100.0), ("b", "x"): (2, 100.0), ("b", "y"): (2, 100.0)}


def test_update_with_repeated_keys(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    other = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "k long, w string")
    assert {tuple(r) for r in relational.update_from(base, other, ["k"], "v", "w").collect()} == {(1, "y"), (2, "b")}


def test_components_raise_when_unsettled(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "u long, v long")
    with pytest.raises(RuntimeError, match="settle"):
        components.components(spark.range(61), edges, max_rounds=1)


def test_components_of_shared_keys(spark):
    rows = [(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, None, None), (9, "b", "y"), (8, "b", None), (7, None, "y")]
    df = spark.createDataFrame(rows, "id long, k string, l string")
    got = {r.id: r.component for r in components.components(df, components.key_edges(df, "id", ["k", "l"])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 7: 7, 8: 7, 9: 7}


def test_linkage_tiers(spark):
    left = spark.createDataFrame([(1, "u1", "oak nursery", "p1", "a"), (2, None, "elm nursery", "p2", "a"), (3, None, "ash day nursery", "p9", "b"), (4, None, "only one", "p8", "c"), (5, None, "nothing alike", "p7", "d")], "id long, urn string, name string, postcode string, area string")
    right = spark.createDataFrame([(10, "u1", "zzz", "p0", "z"), (20, None, "elm nurserys", "p2", "z"), (21, None, "elm nursery", "p2", "z"), (30, None, "ash day nurserys", "p3", "b"), (40, None, "only one", "p4", "e")], "id long, urn string, name string, postcode string, area string")
    got = {r.id: (r.match_id, r.method) for r in linkage.link(left, right).collect()}
    assert got == {1: (10, "urn_exact"), 2: (21, "postcode_name"), 3: (30, "area_name"), 4: (40, "unique_name"), 5: (None, "unmatched")}


def test_inspection_scores(spark):
    def score(framework, rating=None, subs=(), cards=(), flags=(), points=None):
        s = lambda v: F.lit(v).cast("string")
        c = scoring.inspection_score(s(framework), s(rating), [s(x) for x in subs] or [s(None)], [s(x) for x in cards] or [s(None)], [F.lit(x).cast("boolean") for x in flags], F.lit(points).cast("double"))
        return round(spark.range(1).select(c.alias("x")).first().x, 4)

    assert score(None) == -10 and score(None, points=6.0) == 6
    assert score("legacy", "Outstanding") == 9
    assert score("legacy", "Good", ["Outstanding", "Good", "Good", "Good", "Requires Improvement"]) == 6.668
    assert score("report_card", cards=["Strong", "Expected"], flags=[False, None, True]) == 5.25
    assert score("legacy_transition", flags=[False]) == -11 and score("ungraded_confirmed", flags=[False]) == -10


@pytest.mark.parametrize(
    ("band", "care", "fee", "hours", "want"),
    [("under2", "nursery", {"per_hour": 8.5}, None, 8.5), ("under2", "nursery", {"full_day": 95.0}, None, 9.5), ("under2", "nursery", {"morning_session": 55.0}, None, 11.0), ("under2", "nursery", {"afternoon_session": 48.0}, None, 12.0), ("all", "after_school_club", {"per_session": 15.5}, 2.5, 6.2), ("all", "nursery", {"per_session": 15.5, "per_day": 80.0}, None, None), ("all", "nursery", {"per_day": 80.0}, None, 8.0), ("all", "breakfast_club", {"per_session": 3.0}, 4.0, 2.0), ("all", "nursery", {"full_day": 95.0}, None, None)],
)
def test_rate_waterfall(spark, band, care, fee, hours, want):
    fees = {k: F.lit(fee.get(k)).cast("double") for k in ("per_hour", "full_day", "morning_session", "afternoon_session", "per_session", "per_day")}
    session = {"full_day": F.lit(10.0), "morning": F.lit(5.0), "afternoon": F.lit(4.0)}
    got = spark.range(1).select(scoring.hourly_rate(F.lit(band), fees, session, F.lit(care), F.lit(hours).cast("double")).alias("x")).first().x
    assert got == want if want is None else got == pytest.approx(want)


def test_pool_and_allocation(spark):
    df = spark.createDataFrame([(1, k, h) for k, h in enumerate((10.0, 15.0, 10.0, 5.0))], "f long, k long, h double")
    assert [r.used for r in relational.pool_depletion(df, "f", ["k"], "h", F.lit(30.0)).orderBy("k").collect()] == [10, 15, 5, 0]
    shares = [r.share for r in relational.allocate_with_remainder(df, "f", ["k"], "h", F.lit(100.0)).orderBy("k").collect()]
    assert round(sum(shares), 2) == 100 and shares[0] == 25


def test_merges(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k long, v string")
    assert sorted(map(tuple, relational.upsert(base, new, ["k"], F.col("v")).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, relational.insert_ignore(base, new, ["k"], F.col("v")).collect())) == [(1, "a"), (2, "b"), (3, "e")]
    assert relational.set_check(base, new, ["k"], "n").first().status == "FAIL"


def test_ranking_puts_missing_last(spark):
    rows = [(1, 0, 5.0, 1.0), (1, 1, 3.0, 1.0), (2, 0, -1.0, 2.0), (3, 0, float("nan"), 0.5), (4, 0, 4.0, 9.0)]
    df = spark.createDataFrame(rows, "provider_id long, care_type int, graduates double, km double").withColumns({"min_months": F.lit(None).cast("int"), "min_years": F.lit(3), "max_years": F.lit(4), "funded": F.lit(True)})
    assert [r.provider_id for r in spatial.filter_sort_dedupe(df, "most_graduate", [40]).collect()] == [1, 4, 3, 2]
    assert spatial.filter_sort_dedupe(df, "most_graduate", [20]).count() == 0


def test_binary_answer_round_trip(spark):
    kinds = {"provider_id": "q", "km": "f", "care_type": "b"}
    df = spark.createDataFrame([(1, 7, 2.5, None), (1, 8, None, 3)], "query_id long, provider_id long, km double, care_type int")
    row = publish.pack_answers(df, "query_id", "provider_id", kinds).first()
    back = publish.unpack_columns(bytes(row.answer), kinds)
    assert len(row.answer) == 8 + 2 * 13 and back.provider_id.tolist() == [7, 8] and back.care_type.tolist() == [-1, 3] and back.km.isna().tolist() == [False, True]


def test_snapshots_switch_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    for n in (3, 5):
        publish.publish_snapshot(spark.range(n), root)
        assert publish.read_snapshot(spark, root).count() == n


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, 8.0, 18.0, 5), (2, 4.0, 18.0, 0), (3, None, None, 1)], "k long, o double, e double, n int")
    got = {(r.k, r.rule) for r in quality.violations(df, "k", quality.opening_hours_rules(F.col("o"), F.col("e"), F.col("n"))).collect()}
    assert got == {(2, "open_range"), (2, "duration"), (2, "no_day")}


def test_flat_files(spark, tmp_path):
    (tmp_path / "a 2024-01-05.csv").write_text('﻿Provider Name,Places,Date ,Date\n"Oak, The",12,05/01/2024,x\nElm,many,2024-02-01,\n')
    (tmp_path / "a 2023-12-31.csv").write_text("Provider Name\nold\n")
    path = flat.newest(spark, f"file://{tmp_path}/*.csv")
    df = flat.read_text_table(spark, path)
    assert df.columns == ["provider_name", "places", "date", "date_2"]
    rows = flat.typed(flat.keep_columns(df, {"provider_name": "name", "places": "places", "date": "date", "none": "none"}), {"places": "int", "date": "date"}).orderBy("name").collect()
    assert [(r["name"], r.places, str(r.date), r.none) for r in rows] == [("Elm", None, "2024-02-01", None), ("Oak, The", 12, "2024-01-05", None)]


def test_workbooks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Code</t></si><si><t>E0</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Rank</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in workbooks.read_xlsx(spark, f"file://{tmp_path}/a.xlsx", ["Code", "Rank"], "S").collect()] == [("E0", "7")]
    ns = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    cell = "<table:table-cell{0}><text:p>{1}</text:p></table:table-cell>"
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        body = f"<table:table-row>{cell.format('', 'Name')}{cell.format('', 'URL')}</table:table-row><table:table-row table:number-rows-repeated=\"2\">{cell.format('', 'Oak')}{cell.format(' table:formula=&quot;'.replace('&quot;', chr(34)) + 'of:=HYPERLINK(&quot;http://x&quot;)' + chr(34), 'link')}</table:table-row><table:table-row table:number-rows-repeated=\"9999\"><table:table-cell/></table:table-row>"
        z.writestr("content.xml", f'<x {ns}><table:table table:name="T">{body}</table:table></x>')
    assert [tuple(r) for r in workbooks.read_ods(spark, f"file://{tmp_path}/a.ods", ["name", "url"], "T").collect()] == [("Oak", "http://x")] * 2


def test_geometry_files(spark, tmp_path):
    ring = [[0, 0], [0.5, 0.0001], [1, 0], [1, 1], [0, 0]]
    (tmp_path / "a.geojson").write_text('{"features":[{"properties":{"code":"E1"},"geometry":{"type":"Polygon","coordinates":[' + str(ring) + "]}},{}]}")
    row = workbooks.read_geojson(spark, f"file://{tmp_path}/a.geojson", ["code"], 0.01).first()
    assert (row.code, row.south, row.east) == ("E1", 0, 1) and row.rings == "[[[0, 0], [1, 0], [1, 1], [0, 0]]]"
    shape = struct.pack("<i4d", 5, 1.0, 2.0, 3.0, 4.0) + bytes(8)
    shp = bytes(100) + struct.pack(">ii", 1, len(shape) // 2) + shape
    dbf = struct.pack("<BBBBIHH", 3, 0, 0, 0, 1, 65, 5) + bytes(20) + b"CODE\0\0\0\0\0\0\0C" + bytes(4) + bytes([4, 0]) + bytes(14) + b"\r" + b" AB1 "
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.shp", shp)
        z.writestr("x.dbf", dbf)
    assert tuple(workbooks.read_shape_boxes(spark, f"file://{tmp_path}/a.zip", "CODE").first()) == ("AB1", 1, 2, 3, 4)
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table t (a text, b int)")
    db.execute("insert into t values ('x', 1), (null, 2)")
    db.commit()
    db.close()
    assert [tuple(r) for r in workbooks.read_sqlite(spark, f"file://{tmp_path}/a.gpkg", "select a, b from t order by b", ["a", "b"]).collect()] == [("x", "1"), (None, "2")]
    assert io.BytesIO


def test_html_fields():
    page = '<title>Oak - Portal</title><h1>Oak</h1><dl><dt>Type:</dt><dd>Nursery</dd><dt>Type</dt><dd>Club</dd></dl><table><tr><th>Places</th><td>12</td></tr></table><p><strong>Area:</strong> North </p><a href="mailto:a@b.c?x">m</a><a href="tel:01">t</a> at AB1 2CD'
    f = html.fields(page)
    assert f["pairs"] == {"Type": "Club", "Places": "12", "Area": "North"} and html.fields(page, True)["pairs"]["Type"] == "Nursery"
    assert (f["title"], f["heading"], f["email"], f["phone"], f["postcode"], f["n_links"]) == ("Oak - Portal", "Oak", "a@b.c", "01", "AB1 2CD", 2)
    assert html.decode_email("42" + bytes(b ^ 0x42 for b in b"x@y.z").hex()) == "x@y.z"
    assert html.fields(None)["pairs"] == {}


def test_grid_projection(spark):
    import numpy as np

    from placelens.functions import projection

    lat, lon = projection.to_airy(np.array([651409.903]), np.array([313177.270]))
    assert np.degrees(lat[0]) == pytest.approx(52 + 39 / 60 + 27.2531 / 3600, abs=1e-7)
    assert np.degrees(lon[0]) == pytest.approx(1 + 43 / 60 + 4.5177 / 3600, abs=1e-7)
    got = spark.createDataFrame([(530047, 180422), (None, 1)], "e int, n int").select(projection.grid_to_degrees(F.col("e"), F.col("n")).alias("p")).collect()
    assert (got[0].p.lat, got[0].p.lon) == (pytest.approx(51.5078, abs=2e-3), pytest.approx(-0.1279, abs=2e-3)) and got[1].p is None


def test_postcode_documents(spark):
    import json

    from placelens.operators import postcodes

    rows = spark.createDataFrame([("AB1 2CD", 51.0, -1.0, "E06", "E10", 1), ("AB1 3EF", 51.1, -1.1, "E07", "E99999999", 1), ("AB1 9ZZ", None, None, "E06", "E10", 9)], "postcode string, lat double, lon double, lad string, county string, quality int")
    boxes = spark.createDataFrame([("AB1 2CD", 50.9, -1.2, 51.2, -0.9)], "postcode string, south double, west double, north double, east double")
    doc = postcodes.postcode_documents(postcodes.postcode_rows(rows, boxes)).collect()
    assert [r.outward for r in doc] == ["AB1"]
    assert json.loads(doc[0].doc) == {"_": ["E06", "E07", "E10"], "2CD": {"b": [-1.2, 50.9, -0.9, 51.2], "c": [-1.0, 51.0], "a": [0, 2]}, "3EF": {"b": [-1.102, 51.098, -1.098, 51.102], "c": [-1.1, 51.1], "a": [1]}}
