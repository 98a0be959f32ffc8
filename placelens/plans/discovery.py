"""Record rules, page trees and column discovery over tables made of customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import discovery, quality, scratch
from placelens.plans.base import table
from placelens.plans.registry import registry
from placelens.sources import page_tree

QUERIES, ORACLE_SQL, query = registry()
c = F.col

_RECORDS = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'childminder' WHEN 1 THEN 'nursery' END AS institution_type, CASE c_custkey % 5 WHEN 0 THEN 'E06000001' WHEN 1 THEN 'W06000001' WHEN 2 THEN 'E1' WHEN 3 THEN 'E06000002' END AS lad25cd,
 CASE c_custkey % 4 WHEN 0 THEN '01234567890' WHEN 1 THEN '+441234' WHEN 2 THEN '0123456789' END AS phone, CASE c_custkey % 7 WHEN 0 THEN 'a@b.org' WHEN 1 THEN 'a@b' WHEN 2 THEN 'a b@c.d' END AS email,
 CASE c_custkey % 6 WHEN 0 THEN 'http://a.org' WHEN 1 THEN 'a.org' WHEN 2 THEN 'https://f.org' END AS website, CASE c_custkey % 4 WHEN 0 THEN 'https://f.org' WHEN 1 THEN 'f.org' END AS fis_url,
 CASE c_custkey % 5 WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Outstanding' END AS rating, CASE c_custkey % 8 WHEN 0 THEN '2026-01-02' WHEN 1 THEN '2026-07-01' WHEN 2 THEN '2019-05-01' WHEN 3 THEN 'soon' WHEN 4 THEN '2020-01-01' END AS inspected,
 CASE c_custkey % 4 WHEN 0 THEN 'legacy' WHEN 1 THEN 'report_card' WHEN 2 THEN 'other' END AS framework, CASE c_custkey % 3 WHEN 0 THEN true END AS safeguarding_met, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey % 30 * 20 AS INT) END AS places, c_custkey % 5 AS cares FROM customer"""
_BROKEN = {
    "missing lad25cd": "lad25cd IS NULL", "missing rating": "rating IS NULL", "missing inspected": "inspected IS NULL", "missing framework": "framework IS NULL", "missing places": "places IS NULL",
    "lad25cd": "lad25cd IN ('W06000001', 'E1')", "phone": "phone = '+441234'", "email": "email IN ('a@b', 'a b@c.d')", "website": "website = 'a.org'", "fis_url": "fis_url = 'f.org'", "rating": "rating = 'Fair'", "framework": "framework = 'other'",
    "inspected_unreadable": "inspected = 'soon'", "inspected_in_future": "inspected = '2026-07-01'", "inspected_long_ago": "inspected = '2019-05-01'", "safeguarding_met": "framework = 'report_card' AND safeguarding_met IS NULL",
    "places": "places NOT BETWEEN 1 AND 500", "places_at_home": "places BETWEEN 16 AND 500 AND cares IN (0, 1)", "no_care_type": "cares = 4", "repeated_care_type": "cares = 2", "website_is_fis": "website = fis_url",
    "institution_and_care": "CASE WHEN institution_type = 'childminder' THEN cares IN (1, 2, 3) WHEN institution_type IS NOT NULL THEN cares IN (0, 1) ELSE false END",
}


@query(" UNION ALL ".join(f"SELECT id, '{k}' AS rule FROM ({_RECORDS}) WHERE {v}" for k, v in _BROKEN.items()))
def record_rules(spark, d):
    rows = spark.sql(_RECORDS.replace("FROM customer", "FROM {rows}"), rows=table(spark, d, "customer"))
    cares = F.expr("CASE cares WHEN 0 THEN array('childminder') WHEN 1 THEN array('childminder', 'x', NULL) WHEN 2 THEN array('breakfast_club', 'free_breakfast_club') WHEN 3 THEN array('x') END")
    rules = quality.record_rules(F.lit("2026-06-01").cast("date"), {"free_breakfast_club": "breakfast_club"})
    return quality.violations(rows.withColumn("care_types", cares), "id", rules)


@query("""SELECT id, CASE k WHEN 0 THEN 'Oak ' || id WHEN 1 THEN 'Elm ' || id WHEN 2 THEN 'Ash ' || id ELSE 'Family Hub' END AS name, k = 3 AS doubtful, CASE WHEN k < 3 THEN '0' || id END AS phone, CASE WHEN k <> 2 THEN 'AB1 2CD' END AS postcode,
 CASE k WHEN 2 THEN 'Ville' ELSE 'Town' END AS town, CASE k WHEN 3 THEN NULL ELSE id || ' High St' END AS line FROM (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer)""")
def page_tree_fields(spark, d):
    """Pages where the pair lies in the same row, behind the label or in the row above, and the name in the title, the header or a second heading."""
    html = F.expr("""CASE id % 4
      WHEN 0 THEN concat('<title>Family Hub | Oak ', id, '</title><h1>x</h1><div><span class="eyo-data-label">Phone:</span><b class="eyo-data-field v">0', id, '</b></div><div id="pnlVisitAddressWrapper"><p>', id, ' High St<br>Town<br/>ab1 2cd</p></div>')
      WHEN 1 THEN concat('<meta name="application-name" content="My Hub"><title>my hub</title><h1>My Hub</h1><div id="hit-header"><h1>Elm ', id, '</h1></div><p class="eyo-data-label">phone</p><p class="eyo-data-field">0', id, '</p><div id="pnlPostalAddressWrapper"><p>', id, ' High St<br>Town<br>AB1 2CD</p></div>')
      WHEN 2 THEN concat('<h1>Family Hub</h1><h1>Ash ', id, '</h1><section><div><i class="eyo-data-label">Phone :</i></div><div><i class="eyo-data-field">0', id, '</i></div></section><div id="pnlVisitAddressWrapper"><p>', id, ' High St<br> Ville </p></div>')
      ELSE '<title>Family Hub</title><h1>Family Hub</h1><div id="pnlVisitAddressWrapper"><p>Town<br>AB1 2CD</p></div>' END""")
    # keys are few bytes and a page much work: row groups of the file would be few tasks
    pages = scratch.spread(table(spark, d, "customer").select(c("c_custkey").alias("id"))).withColumn("html", html)
    got = pages.select("id", page_tree.page_details(c("html"), "eyo-data-label", "eyo-data-field", ("Family Hub",)).alias("p"))
    return got.select("id", "p.name", "p.doubtful", c("p.pairs")["phone"].alias("phone"), c("p.address")["postcode"].alias("postcode"), c("p.address")["town"].alias("town"), c("p.address")["address_line1"].alias("line"))


_SHOWN = ("s_suppkey", "s_name", "s_nationkey", "coded")
_CODED = "SELECT *, CASE WHEN s_suppkey % 4 <> 0 THEN 'E06' || lpad(CAST(s_suppkey % 100000 AS VARCHAR), 6, '0') WHEN s_suppkey % 8 = 0 THEN 'none' END AS coded FROM supplier"


@query(" UNION ALL ".join(f"""SELECT '{k}' AS "column", count(*) AS rows, count({k}) AS filled, round(avg(CAST(regexp_matches(CAST({k} AS VARCHAR), '^E[0-9]{{8}}$') AS INT)), 6) AS area, round(avg(CAST(regexp_matches(CAST({k} AS VARCHAR), '^[0-9]+$') AS INT)), 6) AS number FROM ({_CODED})""" for k in _SHOWN))
def column_profiles(spark, d):
    return _profiles(spark, d).select("column", "rows", "filled", F.round("area", 6).alias("area"), F.round("number", 6).alias("number"))


def _profiles(spark, d):
    coded = F.expr("CASE WHEN s_suppkey % 4 <> 0 THEN concat('E06', lpad(CAST(s_suppkey % 100000 AS STRING), 6, '0')) WHEN s_suppkey % 8 = 0 THEN 'none' END")
    rows = table(spark, d, "supplier").withColumn("coded", coded).select(*_SHOWN)
    return discovery.profile(rows, {"area": "^E[0-9]{8}$", "number": "^[0-9]+$"})


@query(f"""SELECT 'area' AS role, 'coded' AS "column", round(avg(CAST(regexp_matches(coded, '^E[0-9]{{8}}$') AS INT)), 4) AS score FROM ({_CODED}) UNION ALL SELECT 'name', 's_name', 1.99 UNION ALL SELECT 'number', 's_nationkey', 3.0""")
def discovered_columns(spark, d):
    """The area by its values alone, the name by its name alone, the number by both."""
    return discovery.choose(_profiles(spark, d), {"area": (["lad_code"], "area"), "name": (["title", "s_name"], None), "number": (["s_nationkey"], "number"), "none": (["q"], None)})
