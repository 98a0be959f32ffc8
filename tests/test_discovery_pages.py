"""Column discovery, page trees and record rules on small cases."""

import datetime as dt

from placelens.operators import discovery, quality
from placelens.sources import page_tree as P
from pyspark.sql import functions as F


def test_class_pairs_in_three_scopes():
    page = """<div><div class="row"><span class="label x">Name :</span><b class="value">Oak</b></div>
    <div><p class="label">Phone:</p><p class="value">01 <i>2</i></p></div>
    <section><div><em class="label">Far</em></div><div><span class="value">found</span></div></section>
    <div><span class="label"></span><span class="value">no label</span></div><div><span class="label">Lone</span></div><br/><ul><li class=label>open<li class=value>li</ul></div>"""
    assert P.class_pairs(P.tree(page), "label", "value") == {"name": "Oak", "phone": "01 2", "far": "found", "open": "li", "lone": "Oak"}
    assert P.class_pairs(P.tree(None), "label", "value") == {} and P.class_pairs(P.tree("<p class=label>x"), "label", "value") == {}
    deep = "<div>" * 5000 + "<b class=label>a</b><i class=value>b</i>"
    assert P.class_pairs(P.tree(deep), "label", "value") == {"a": "b"}


def test_own_name():
    name = lambda html, given=None: P.own_name(P.tree(html), frozenset({"Family Hub"}), "hit", given)
    assert name("<title>Family Hub | Oak Nursery</title><h1>x</h1>") == ("Oak Nursery", False)
    assert name('<meta name="application-name" content="Glos Directory"><title>glos directory</title><h1>Family Hub</h1><div id="hit"><h1>Elm</h1></div>') == ("Elm", False)
    assert name("<h1>Family Hub</h1><h1>Ash</h1>") == ("Ash", False) and name("<h1>Family Hub</h1>", "Given") == ("Given", False)
    assert name("<h1>family hub</h1>") == ("family hub", True) and name("", "Family Hub") == ("Family Hub", True) and name(None) == (None, False)


def test_address():
    html = '<div id="b"><p>9 Post Rd<br>Ville<br/>ZZ9 9ZZ</p></div><div id="a"><p>Flat 1<br> 2  High St <br>Rear<br>Yard<br>Town</p></div>'
    assert P.address(P.tree(html), {"a": "visit", "b": "postal"}) == {"town": "Town", "address_line1": "Flat 1", "address_line2": "2 High St", "address_line3": "Rear, Yard", "address_type_visit": "true", "postcode": "ZZ9 9ZZ", "address_type_postal": "true"}
    assert P.address(P.tree(html), {"b": "postal", "a": "visit"}) == {"postcode": "ZZ9 9ZZ", "town": "Ville", "address_line1": "9 Post Rd", "address_type_postal": "true"}
    assert P.address(P.tree("<div id=a></div>"), {"a": "x"}) == {}


def test_discovery(spark):
    df = spark.createDataFrame([("E06000001", "Oak", "x", 1), ("E06000002", " ", "E06000009", 2), (None, "Elm", "y", None)], "ref string, `Name` string, `odd.name` string, code int")
    patterns = {"area": "^E[0-9]{8}$"}
    rows = {r.column: r for r in discovery.profile(df, patterns).collect()}
    assert (rows["ref"].rows, rows["ref"].filled, rows["ref"].area, rows["Name"].filled, rows["odd.name"].area) == (3, 2, 1.0, 2, 1 / 3)
    got = {r.role: (r.column, r.score) for r in discovery.choose(discovery.profile(df, patterns), {"code": (["lad_code", "code"], "area"), "area": ([], "area"), "name": (["title", "name"], None), "none": (["q"], None)}).collect()}
    assert got == {"code": ("code", 1.99), "area": ("ref", 1.0), "name": ("Name", 1.99)}
    assert discovery.choose(discovery.profile(df.limit(0), patterns), {"area": ([], "area")}).collect() == []
    layers = spark.createDataFrame([(0, "roads", "g"), (1, "District_Borough", None), (2, "boundary_districts", "geom"), (3, "county", "g")], "place int, table_name string, geometry_column string")
    assert tuple(discovery.find_layer(layers, ["unitary", "district"]).first()) == ("boundary_districts", "geom")
    assert tuple(discovery.find_layer(layers, ["zzz"]).first()) == ("roads", "g") and discovery.find_layer(layers.limit(0), ["a"]).collect() == []


def test_record_rules(spark):
    kind = "id int, institution_type string, lad25cd string, phone string, email string, website string, fis_url string, rating string, inspected string, framework string, safeguarding_met boolean, places int, care_types array<string>"
    good = ("nursery", "E06000001", "01234567890", "a@b.c", "http://a", None, "Good", "2026-01-01", "legacy", None, 30, ["x"])
    rows = [(1, *good), (2, *([None] * 12)), (3, "childminder", "W1", "1", "a@b", "a", "a", "Bad", "2027-01-01", "z", True, 0, ["childminder", "cm", "x", None]), (4, "nursery", "E06000001", None, None, "http://a", "http://b", "Good", "2010-01-01", "report_card", None, 16, ["childminder"]), (5, *good[:7], "soon", *good[8:])]
    got = {}
    rules = quality.record_rules(F.lit(dt.date(2026, 6, 1)), {"cm": "childminder"})
    for r in quality.violations(spark.createDataFrame(rows, kind), "id", rules).collect():
        got.setdefault(r.id, set()).add(r.rule)
    assert got == {
        2: {"missing lad25cd", "missing rating", "missing inspected", "missing framework", "missing places", "no_care_type"},
        3: {"lad25cd", "phone", "email", "website", "fis_url", "rating", "inspected_in_future", "framework", "places", "repeated_care_type", "website_is_fis", "institution_and_care"},
        4: {"inspected_long_ago", "safeguarding_met", "places_at_home", "institution_and_care"}, 5: {"inspected_unreadable"},
    }


def test_pages_are_spread_whatever_the_row_groups(spark):
    from placelens.plans import discovery as plans

    got = plans.page_tree_fields(spark, "/root/testdata/sf0.001")
    sizes = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and min(sizes) > 0
