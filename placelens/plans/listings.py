"""Queries of placelens.operators.listings over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import records
from placelens.operators import household, linkage
from placelens.operators import listings as L
from placelens.plans.base import table
from placelens.plans.records import _PARTS, _parts
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query("""WITH v AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'phone' ELSE 'email' END AS field, o_orderpriority AS source, o_orderkey AS i FROM orders),
f AS (SELECT k, field, arg_min(source, i) AS source FROM v GROUP BY 1, 2), n AS (SELECT count(*) AS total FROM customer),
s AS (SELECT field, source, count(*) AS n FROM f WHERE k IN (SELECT c_custkey FROM customer) GROUP BY 1, 2),
a AS (SELECT x.field, 'absent' AS source, total - coalesce(p.n, 0) AS n FROM (VALUES ('phone'), ('email'), ('fax')) x(field) CROSS JOIN n LEFT JOIN (SELECT field, sum(n) AS n FROM s GROUP BY 1) p ON p.field = x.field)
SELECT field, source, CAST(n AS BIGINT) AS count, round(100.0 * n / total, 1) AS pct FROM (SELECT * FROM s UNION ALL SELECT * FROM a WHERE n > 0) CROSS JOIN n""")
def field_sources(spark, d):
    field = F.when(c("o_orderkey") % 3 == 0, "phone").otherwise("email")
    values = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), field.alias("field"), c("o_orderpriority").alias("source"), c("o_orderkey").alias("i"))
    return L.field_sources(table(spark, d, "customer"), values, "c_custkey", ["phone", "email", "fax"], "i")


_ROWS = "SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber < 7 THEN CAST(l_quantity AS BIGINT) END AS low, CAST(l_linenumber AS BIGINT) * 9 AS high, l_returnflag AS mode FROM lineitem"
_ISSUES = f"""r AS ({_ROWS}), i AS (SELECT id, 'low' AS path, 'invalid_type' AS code FROM r WHERE low IS NULL UNION ALL SELECT id, 'low', 'too_big' FROM r WHERE low > 45
 UNION ALL SELECT id, 'mode', 'invalid_value' FROM r WHERE mode NOT IN ('A', 'R') UNION ALL SELECT id, 'low', 'custom' FROM r WHERE low > high)"""


def _checked(spark, d):
    low = F.when(c("l_linenumber") < 7, c("l_quantity").cast("long"))
    rows = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), low.alias("low"), (c("l_linenumber").cast("long") * 9).alias("high"), c("l_returnflag").alias("mode"))
    checks = [*L.field_checks("low", required=True, high=45), *L.field_checks("mode", allowed=["A", "R"]), L.pair_check("low", "high")]
    return rows, L.issues(rows, "id", checks)


@query(f"""WITH {_ISSUES}, n AS (SELECT *, row_number() OVER (PARTITION BY path, code ORDER BY id) AS place FROM i)
SELECT path, code, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (place <= 10) AS sample FROM n GROUP BY 1, 2""")
def validation_summary(spark, d):
    return L.issue_summary(_checked(spark, d)[1], "id")


@query(f"WITH {_ISSUES}, e AS (SELECT id, string_agg(path || ':' || code, ',' ORDER BY path || ':' || code) AS errors FROM i GROUP BY 1) SELECT r.id, errors, errors IS NULL AS pass FROM r LEFT JOIN e USING (id)")
def validation_results(spark, d):
    rows, found = _checked(spark, d)
    return L.validated(rows.select("id"), "id", found)


@query("""WITH k AS (SELECT o_custkey AS k, bit_or(1 << (o_orderkey % 7)::INT) AS mask, min(o_orderkey % 5) AS low, max(o_orderkey % 11) AS high, bool_or(o_totalprice > 300000) AS funded FROM orders GROUP BY 1)
SELECT CAST(c_nationkey AS BIGINT) AS lat, CAST(c_custkey % 40 AS BIGINT) AS lon, count(*) AS n, min(c_custkey) AS "first", CAST(bit_or(coalesce(mask, 0)) AS INT) AS mask, min(low) AS low, max(high) AS high, bool_or(coalesce(funded, false)) AS funded
FROM customer LEFT JOIN k ON k = c_custkey WHERE c_custkey % 17 <> 0 GROUP BY 1, 2""")
def map_features(spark, d):
    k = c("o_orderkey")
    care = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), F.expr("shiftleft(1, int(o_orderkey % 7))").alias("bit"), (k % 5).alias("low"), (k % 11).alias("high"), (c("o_totalprice") > 300000).alias("funded"))
    places = table(spark, d, "customer").select("c_custkey", F.when(c("c_custkey") % 17 != 0, c("c_nationkey").cast("long")).alias("lat"), (c("c_custkey") % 40).cast("long").alias("lon"))
    return L.map_features(care, places, "c_custkey", "lat", "lon")


_FEES = """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END AS band, CASE WHEN l_linenumber <> 2 THEN l_quantity / 4 END AS hour, CASE WHEN l_linenumber <> 4 THEN l_quantity END AS morning,
 CASE WHEN l_linenumber = 5 THEN l_quantity ELSE l_quantity + 1 END AS afternoon, CASE WHEN l_linenumber = 1 THEN 2 * l_quantity END AS day, CASE WHEN l_quantity < 20 THEN l_linenumber - 3 ELSE 3 END AS session, CASE WHEN l_linenumber = 6 THEN 50 END AS daily FROM lineitem"""


@query(f"""WITH f AS (SELECT *, row_number() OVER () AS r FROM ({_FEES})), x AS (
SELECT r, k, n, 0 AS place, 'Per hour' AS label, printf('£%.2f', hour::DOUBLE) AS "value" FROM f WHERE band IS NULL AND hour > 0
UNION ALL SELECT r, k, n, 1, 'Per session', CASE WHEN session = 0 THEN 'Free' ELSE printf('£%.2f', session::DOUBLE) END FROM f WHERE band IS NULL AND session >= 0
UNION ALL SELECT r, k, n, 2, 'Per day', printf('£%.2f', daily::DOUBLE) FROM f WHERE band IS NULL AND daily > 0
UNION ALL SELECT r, k, n, 3, band, printf('£%.2f', hour::DOUBLE) || ' per hour' FROM f WHERE band IS NOT NULL AND hour IS NOT NULL
UNION ALL SELECT r, k, n, 4, band || ' AM', printf('£%.2f', morning::DOUBLE) FROM f WHERE band IS NOT NULL AND morning IS NOT NULL
UNION ALL SELECT r, k, n, 5, band || ' PM', printf('£%.2f', afternoon::DOUBLE) FROM f WHERE band IS NOT NULL AND afternoon IS DISTINCT FROM morning
UNION ALL SELECT r, k, n, 6, band || ' full day', printf('£%.2f', day::DOUBLE) FROM f WHERE band IS NOT NULL AND day IS NOT NULL
UNION ALL SELECT r, k, n, 7, band, printf('£%.2f', session::DOUBLE) || ' per session' FROM f WHERE band IS NOT NULL AND session IS NOT NULL
UNION ALL SELECT r, k, n, 8, band, printf('£%.2f', daily::DOUBLE) || ' per day' FROM f WHERE band IS NOT NULL AND daily IS NOT NULL)
SELECT k, n, CAST(row_number() OVER (PARTITION BY r ORDER BY place) - 1 AS INT) AS line, label, "value" FROM x""")
def fee_lines(spark, d):
    f = spark.sql(_FEES.replace("FROM lineitem", "FROM {rows}"), rows=table(spark, d, "lineitem"))
    lines = L.fee_lines(c("band"), c("hour"), c("morning"), c("afternoon"), c("day"), c("session"), c("daily"))
    return f.select("k", "n", F.posexplode(lines).alias("line", "x")).select("k", "n", "line", "x.*")


_NONE = "no_recourse_to_public_funds"


@query(f"""WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '{_NONE}' ELSE 'citizen' END AS own, CASE WHEN c_custkey % 3 = 0 THEN '{_NONE}' WHEN c_custkey % 3 = 1 THEN 'citizen' END AS other, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS x FROM customer)
SELECT id, CASE WHEN id % 7 = 1 THEN 'universal_credit' WHEN id % 7 = 2 THEN 'x' ELSE '' END AS benefits, CASE WHEN own = '{_NONE}' AND coalesce(other, '{_NONE}') = '{_NONE}' THEN coalesce(x, 0) ELSE 0 END AS income_under,
 CASE WHEN own = '{_NONE}' AND coalesce(other, '{_NONE}') = '{_NONE}' THEN 9 ELSE 0 END AS savings_under, id % 7 = 1 AND id % 4 = 0 AS credit_below FROM f""")
def resolved_forms(spark, d):
    k = c("c_custkey")
    forms = table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 2 == 0, _NONE).otherwise("citizen").alias("residency"), F.when(k % 3 == 0, _NONE).when(k % 3 == 1, "citizen").alias("partner_residency"),
        F.when(k % 5 != 0, c("c_nationkey")).alias("income_under"), F.lit(9).alias("savings_under"), F.when(k % 4 == 0, True).alias("credit_below"),
        F.when(k % 7 == 1, F.array(F.lit("universal_credit"))).when(k % 7 == 2, F.array(F.lit("x"))).alias("benefits"),
    )
    return L.resolved_form(forms).select("id", F.array_join("benefits", ",").alias("benefits"), "income_under", "savings_under", "credit_below")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority ELSE 'Child ' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS name FROM orders")
def named_children(spark, d):
    name = F.when(c("o_orderkey") % 2 == 1, c("o_orderpriority")).when(c("o_orderkey") % 4 == 0, "  ")
    return L.named_children(table(spark, d, "orders").select("o_custkey", "o_orderkey", name.alias("name")), "o_custkey", "o_orderkey", "name")


_PARENTS = """SELECT o_custkey AS family, o_orderkey AS i, CASE o_orderkey % 3 WHEN 0 THEN '16-17' WHEN 1 THEN '18-20' ELSE '21+' END AS bracket, o_orderkey % 5 < 3 AS studying,
 CASE o_orderkey % 4 WHEN 0 THEN 'school_sixth_form' WHEN 1 THEN 'further_education' ELSE 'higher_education' END AS level, o_orderkey % 7 = 0 AS apprentice, o_totalprice > 100000 AS funded,
 o_orderkey % 11 < 4 AS full_time, o_orderkey % 13 < 6 AS finance, o_orderkey % 17 <> 0 AS resident, o_custkey % 6 <> 0 AS in_england FROM orders"""


@query(f"""WITH p AS ({_PARENTS}), y AS (SELECT family, arg_min(funded AND resident, i) AS ok FROM p WHERE studying AND bracket <> '21+' AND level <> 'higher_education' AND NOT apprentice GROUP BY 1)
SELECT family, coalesce(any_value(ok), false) AND bool_or(in_england) AS care_to_learn, bool_or(studying AND bracket <> '16-17' AND level = 'further_education') AS learner_support,
 bool_or(studying AND level = 'higher_education' AND full_time AND finance) AND bool_or(in_england) AS childcare_grant FROM p LEFT JOIN y USING (family) GROUP BY 1""")
def study_support(spark, d):
    return L.study_support(spark.sql(_PARENTS.replace("FROM orders", "FROM {rows}"), rows=table(spark, d, "orders")), "family", "i")


@query("""SELECT c_custkey, c_custkey % 20 < CASE WHEN c_custkey % 3 = 0 THEN 17 ELSE 15 END AS young, round(16 * CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 = 0 THEN 8.0 WHEN c_custkey % 4 = 1 THEN 10.85 WHEN c_custkey % 4 = 2 THEN 12.71 END::DOUBLE
 * CASE c_nationkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 52.0 / 12 WHEN 2 THEN 13 ELSE 52 END::DOUBLE, 2) AS wage FROM customer""")
def minimum_wages(spark, d):
    k, p = c("c_custkey"), c("c_nationkey") % 4
    bracket = F.when(k % 4 == 0, "16-17").when(k % 4 == 1, "18-20").when(k % 4 == 2, "21+")
    period = F.when(p == 0, "week").when(p == 1, "month").when(p == 2, "quarter").otherwise("year")
    return table(spark, d, "customer").select("c_custkey", L.grant_age(k % 20, k % 3 == 0).alias("young"), L.minimum_wage(bracket, k % 5 == 0, period).alias("wage"))


@query(f"""SELECT id, CASE a % 3 WHEN 0 THEN 'Nursery' WHEN 1 THEN CASE kind WHEN 0 THEN 'School' WHEN 2 THEN 'School' ELSE 'Day Nursery' END END AS label, CASE kind WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'success' WHEN 3 THEN 'partial' ELSE 'not_published' END AS status FROM ({_PARTS})""")
def layers_and_reports(spark, d):
    p = _parts(spark, d, "concat('Oak ', a, ' Primary School')", "'Little Stars'", "'St Mary Academy'", "' '")
    label = L.layer_label(c("a") % 3, c("t"), {0: "Nursery", 1: "School"}, {1: "Day Nursery"}, r"(?i)\b(school|academy)\b")
    return p.select("id", label.alias("label"), L.report_status(c("t"), F.when(c("kind").isin(0, 2, 3), c("name"))).alias("status"))


@query("SELECT p_partkey, code, s_name FROM (SELECT p_partkey, p_partkey % 7 AS k, CASE WHEN p_size % 3 = 0 THEN 'X' WHEN p_size % 3 = 1 THEN 'E' ELSE 'S' END || (10000000 + p_partkey) AS code FROM part) JOIN supplier ON s_suppkey = k WHERE left(code, 1) IN ('E', 'S')")
def indexed_features(spark, d):
    code = F.concat(F.when(c("p_size") % 3 == 0, "X").when(c("p_size") % 3 == 1, "E").otherwise("S"), (c("p_partkey") + 10000000).cast("string"))
    features = table(spark, d, "part").select("p_partkey", (c("p_partkey") % 7).alias("k"), code.alias("code"))
    return L.indexed_features(features, table(spark, d, "supplier").select(c("s_suppkey").alias("k"), "s_name"), "k", "code").drop("k")


@query("""WITH b AS (SELECT DISTINCT CASE WHEN c_custkey % 9 <> 0 THEN c_name ELSE 'unknown' END AS code FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 10 = 0 OR c_custkey % 11 = 0)
SELECT 'non_empty' AS "check", 'PASS' AS status, 0 AS n, '' AS sample UNION ALL SELECT 'complete', 'WARN', count(*), (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT code FROM b ORDER BY code LIMIT 5)) FROM b""")
def boundary_checks(spark, d):
    k = c("c_custkey")
    rows = table(spark, d, "customer").select(F.when(k % 9 != 0, c("c_name")).otherwise(" ").alias("code"), F.when(k % 10 != 0, c("c_name")).alias("name"), F.when(k % 11 != 0, c("c_mktsegment")).alias("shape"))
    return L.boundary_checks(rows, "code", "name", "shape")


@query(f"""SELECT id, CASE kind WHEN 0 THEN 'fee' WHEN 1 THEN 'school' WHEN 2 THEN 'school' ELSE 'pair' END AS kind, CASE kind WHEN 0 THEN '£' || a || '.00 (Day)' WHEN 1 THEN 'Oak ' || a || ' - Leeds' WHEN 2 THEN 'Elm – Bath' WHEN 3 THEN 'yes' END AS text FROM ({_PARTS})""")
def triaged_entries(spark, d):
    p = _parts(spark, d, "concat('£', a, '.00')", "concat('Oak ', a)", "'Elm'", "'Meals'")
    follows = F.when(c("kind") == 0, "(Day):").when(c("kind") == 1, "- Leeds").when(c("kind") == 2, "– Bath").when(c("kind") == 3, "yes")
    return p.select("id", L.triaged(c("t"), follows).alias("x")).select("id", "x.*")


_SCOPED = """SELECT c_custkey AS id, c_nationkey AS area, c_mktsegment AS name, 50 + CAST(c_custkey * 37 % 997 AS DOUBLE) / 500 AS lat, CAST(c_custkey * 53 % 991 AS DOUBLE) / 500 AS lon FROM customer"""
_SITES = """SELECT o_orderkey AS id, o_custkey % 25 AS area, CASE o_orderkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'none' END AS name, 50 + CAST(o_orderkey * 41 % 997 AS DOUBLE) / 500 AS lat, CAST(o_orderkey * 59 % 991 AS DOUBLE) / 500 AS lon FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 250000"""


@query(f"""WITH l AS ({_SCOPED}), r AS ({_SITES}), p AS (SELECT l.id, r.id AS match_id, 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(r.lat - l.lat) / 2), 2) + cos(radians(l.lat)) * cos(radians(r.lat)) * pow(sin(radians(r.lon - l.lon) / 2), 2)))) AS km FROM l JOIN r USING (area, name))
SELECT id, arg_min(match_id, (km, match_id)) AS match_id, round(min(km), 3) AS km FROM p WHERE km <= 40 GROUP BY 1""")
def nearest_of_same_name(spark, d):
    left = spark.sql(_SCOPED.replace("FROM customer", "FROM {rows}"), rows=table(spark, d, "customer"))
    right = spark.sql(_SITES.replace("FROM orders", "FROM {rows}"), rows=table(spark, d, "orders"))
    return linkage.near_in_scope(left, right, "area", 40.0, 1.0).withColumn("km", F.round("km", 3))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN printf('%.1f', low) ELSE printf('%.1f', low) || '-' || printf('%.1f', low + 433) END AS shown FROM (SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DOUBLE) * 216.5, 2) AS low FROM lineitem)""")
def monthly_costs(spark, d):
    low = c("l_quantity").cast("double")
    high = F.when(c("l_linenumber") == 1, low).otherwise(low + 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", household.monthly_display(low, high).alias("shown"))


_ENTRIES = """SELECT c_custkey AS id, c_mktsegment || CAST(c_custkey % 90 AS STRING) AS name, 'q' || CAST(c_custkey % 70 AS STRING) AS core, CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_nationkey * 40 + c_custkey % 40 AS STRING) END AS postcode FROM customer"""
_SCHOOLS = """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'AUTOMOBILE' END || CAST(s_suppkey % 60 AS STRING) AS name, 'q' || CAST(s_suppkey % 50 AS STRING) AS core, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_nationkey * 40 + s_suppkey % 40 AS STRING) END AS postcode FROM supplier"""


@query(f"""WITH l AS ({_ENTRIES}), r AS ({_SCHOOLS}),
p AS (SELECT l.id, r.id AS match_id, 0 AS tier FROM l JOIN r ON l.name = r.name AND l.postcode = r.postcode UNION ALL SELECT l.id, r.id, 1 FROM l JOIN r ON l.name = r.name
 UNION ALL SELECT l.id, r.id, 2 FROM l JOIN r ON l.core = r.core AND (l.postcode = r.postcode OR l.postcode IS NULL OR r.postcode IS NULL)
 UNION ALL SELECT l.id, r.id, 4 FROM l JOIN (SELECT postcode, min(id) AS id FROM r GROUP BY 1 HAVING count(*) = 1) r ON l.postcode = r.postcode),
b AS (SELECT id, min((tier, match_id)) AS x FROM (SELECT id, tier, match_id FROM p) GROUP BY 1), f AS (SELECT l.id, x[2] AS match_id, x[1] AS tier FROM l LEFT JOIN (SELECT id, [x[1], x[2]] AS x FROM b) b USING (id))
SELECT id, match_id, CASE tier WHEN 0 THEN 'exact_name_postcode' WHEN 1 THEN 'exact_name' WHEN 2 THEN 'core_name_postcode' WHEN 4 THEN 'sole_postcode_match' END AS method, CASE tier WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.92 WHEN 4 THEN 0.85 END::DOUBLE AS confidence FROM f""".replace("AS STRING", "AS VARCHAR"))
def matched_schools(spark, d):
    """Cores are codes here, which are alike or not: the pass by similarity is set to find none."""
    left = spark.sql(_ENTRIES.replace("FROM customer", "FROM {rows}"), rows=table(spark, d, "customer"))
    right = spark.sql(_SCHOOLS.replace("FROM supplier", "FROM {rows}"), rows=table(spark, d, "supplier"))
    return linkage.match_schools(left, right, gate=1.01)


@query(f"""SELECT id, 'name' AS path, name AS "value" FROM ({_PARTS}) UNION ALL SELECT id, 'ages.low', a::VARCHAR FROM ({_PARTS}) UNION ALL SELECT id, 'ages.days[1]', 'mon' FROM ({_PARTS})
UNION ALL SELECT id, 'ages.days[2].open', 'true' FROM ({_PARTS})""")
def json_leaves(spark, d):
    p = _parts(spark, d).withColumn("t", F.expr("""concat('{"name": "', name, '", "none": null, "empty": "", "ages": {"low": ', a, ', "days": [null, "mon", {"open": true, "at": []}]}}')"""))
    return p.select("id", F.explode(records.json_leaves(c("t"))).alias("x")).select("id", "x.*")
