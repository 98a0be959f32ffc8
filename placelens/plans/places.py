"""Stripped names, locations, areas, links, session tables, prefix look-ups, audits and typed backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import names as N
from placelens.operators import places as P
from placelens.operators import scratch
from placelens.plans.base import from_sql, table
from placelens.plans.records import _PARTS, _parts
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query(f"SELECT id, CASE kind WHEN 0 THEN 'Oak ' || a || ' Primary School' WHEN 1 THEN 'Little Stars Nursery' WHEN 2 THEN 'Elm Academy' WHEN 3 THEN 'Ash ' || a END AS bare FROM ({_PARTS})")
def without_care(spark, d):
    p = _parts(spark, d, "concat('Oak ', a, ' Primary School Nursery - Breakfast Club')", "'Little Stars Nursery'", "'Elm Academy nursery Wraparound care - before & after school care '", "concat('Ash ', a, ' childminders and childcare providers')")
    return p.select("id", N.without_care(c("t")).alias("bare"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'Oak ' || a WHEN 1 THEN 'Elm' WHEN 3 THEN 'Fir' END AS bare FROM ({_PARTS})")
def unqualified_names(spark, d):
    return _parts(spark, d, "concat('Oak ', a, ' (Leeds)')", "'Elm - Pre-School (am)'", "'Ash School'", "'Fir OOS'", "'(x)'").select("id", N.unqualified(c("t")).alias("bare"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'oak ' || a WHEN 1 THEN 'st mary s' WHEN 2 THEN '' WHEN 3 THEN 'bathe ends' END AS merged FROM ({_PARTS})")
def merge_names(spark, d):
    return _parts(spark, d, "concat(' The Oak ', a, ' Nursery School Ltd')", "'St. Mary''s Pre-School'", "'THE NURSERY'", "'Bathe/Ends'").select("id", N.merge_name(c("t")).alias("merged"))


@query(f"SELECT id, CASE kind WHEN 0 THEN a || ' High St' WHEN 1 THEN 'la_scrape' WHEN 2 THEN 'la_extract:phone' WHEN 3 THEN 'gias:' || a END AS label FROM ({_PARTS})")
def source_labels(spark, d):
    p = _parts(spark, d, "concat('Address:  ', a, ' High St')", "concat('la_scrape:', n)", "concat('la_extract:', n, ':phone')", "concat('gias:', a)")
    return p.select("id", N.source_label(N.address_text(c("t"))).alias("label"))


_PLACES = """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS urn, CAST(c_nationkey AS VARCHAR) AS postcode FROM customer"""
_FINER = "CASE WHEN n_nationkey % 3 = 0 THEN 'district' ELSE 'street' END"


@query(f"""WITH p AS ({_PLACES}), s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal END AS x FROM supplier),
f AS (SELECT CASE WHEN n_regionkey < 4 THEN CAST(n_nationkey AS VARCHAR) END AS postcode, {_FINER} AS geo_type, n_name AS geo_code FROM nation),
b AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'district' ELSE 'sector' END AS geo_type, s_name AS geo_code FROM supplier),
j AS (SELECT id, u.x AS ux, v.x AS vx, b.geo_type AS bt, b.geo_code AS bc, f.geo_type AS ft, f.geo_code AS fc, b.geo_type = 'district' AND f.geo_type = 'street' AS gives
 FROM p LEFT JOIN s u ON u.k = p.urn LEFT JOIN s v ON v.k = p.id AND v.k % 3 = 0 LEFT JOIN b ON b.k = p.id LEFT JOIN f ON f.postcode = p.postcode)
SELECT id, CAST(coalesce(ux, vx) AS DOUBLE) AS lat, CAST(coalesce(ux, vx) AS DOUBLE) AS lon,
 CASE WHEN ux IS NOT NULL THEN 'register' WHEN vx IS NOT NULL THEN 'geocoded' WHEN gives THEN 'bbox:postcode' WHEN bt IS NOT NULL THEN 'bbox:geocoded' WHEN ft IS NOT NULL THEN 'bbox:postcode' END AS location_source,
 CASE WHEN coalesce(ux, vx) IS NULL THEN CASE WHEN gives OR bt IS NULL THEN ft ELSE bt END END AS geo_type,
 CASE WHEN coalesce(ux, vx) IS NULL THEN CASE WHEN gives OR bt IS NULL THEN fc ELSE bc END END AS geo_code FROM j""")
def resolved_locations(spark, d):
    p = from_sql(spark, d, _PLACES.replace("VARCHAR", "STRING"), "customer")
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    x = F.when(c("s_suppkey") % 5 != 0, c("s_acctbal").cast("double"))
    place = lambda key: s.select(c("s_suppkey").alias(key), x.alias("lat"), x.alias("lon"))
    boxes = s.select(c("s_suppkey").alias("id"), F.when(c("s_suppkey") % 2 == 0, "district").otherwise("sector").alias("geo_type"), c("s_name").alias("geo_code"))
    finer = n.select(F.when(c("n_regionkey") < 4, c("n_nationkey").cast("string")).alias("postcode"), F.expr(_FINER).alias("geo_type"), c("n_name").alias("geo_code"))
    found = P.located(p, [("register", "urn", place("urn")), ("geocoded", "id", place("id").withColumn("id", F.when(c("id") % 3 == 0, c("id"))))], [("geocoded", "id", boxes)], "postcode", finer, ["district"])
    return found.drop("urn", "postcode")


@query("""SELECT c_custkey, coalesce(a.n_name, b.n_name, c_mktsegment) AS area, CASE WHEN a.n_name IS NOT NULL THEN 'postcode_lookup' WHEN b.n_name IS NOT NULL THEN 'coords_lookup' WHEN c_custkey % 2 = 0 THEN 'unresolved' ELSE 'scraper_assigned' END AS source
FROM customer LEFT JOIN (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN n_name END AS n_name FROM nation) a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_custkey % 40""")
def resolved_areas(spark, d):
    n = table(spark, d, "nation")
    a = n.select(c("n_nationkey").alias("c_nationkey"), F.when(c("n_regionkey") == 1, c("n_name")).alias("a"))
    b = n.select(c("n_nationkey").alias("place"), c("n_name").alias("b"))
    rows = table(spark, d, "customer").withColumn("place", c("c_custkey") % 40).join(a, "c_nationkey", "left").join(b, "place", "left")
    return rows.select("c_custkey", P.resolved_area(c("a"), c("b"), c("c_mktsegment"), c("c_custkey") % 2 == 0).alias("x")).select("c_custkey", "x.*")


@query("""SELECT o_custkey, o_orderpriority, nullif(link, own) AS link FROM (SELECT o_custkey, o_orderpriority, 'site/' || o_orderkey AS link, 'site/' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS own,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def care_links(spark, d):
    own = F.concat(F.lit("site/"), F.when(c("o_orderkey") % 2 == 0, c("o_orderkey").cast("string")).otherwise(""))
    rows = table(spark, d, "orders").withColumn("link", F.concat(F.lit("site/"), "o_orderkey")).withColumn("own", own)
    return P.own_links(rows, ["o_custkey", "o_orderpriority"], "link", c("o_totalprice"), "o_orderkey", "own")


@query("""WITH f AS (SELECT l_orderkey, l_linestatus, l_returnflag, CAST(l_quantity AS BIGINT) AS q FROM lineitem), k AS (SELECT l_orderkey FROM f GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)
SELECT l_orderkey, l_linestatus, '£' || min(q) FILTER (l_returnflag = 'A') || '.00' AS am, '£' || min(q) FILTER (l_returnflag = 'N') || '.00' AS pm, '£' || min(q) FILTER (l_returnflag = 'R') || '.00' AS full_day FROM f JOIN k USING (l_orderkey) GROUP BY 1, 2""")
def session_fee_table(spark, d):
    fees = table(spark, d, "lineitem").withColumn("q", c("l_quantity").cast("long"))
    return P.session_table(fees, "l_orderkey", "l_linestatus", "l_returnflag", "q", ["A", "N", "R"]).withColumnsRenamed({"A": "am", "N": "pm", "R": "full_day"})


@query("""WITH q AS (SELECT p_partkey, CASE WHEN p_size > 1 THEN substr(p_brand, 1, 3) || ' ' || substr(p_brand, 4, p_partkey % 5) ELSE ' ' END AS prefix FROM part), k AS (SELECT DISTINCT upper(p_brand) AS code FROM part)
SELECT p_partkey, prefix, code FROM q JOIN k ON replace(prefix, ' ', '') <> '' AND starts_with(code, replace(upper(prefix), ' ', ''))""")
def prefix_search(spark, d):
    p = table(spark, d, "part")
    split = F.concat(F.substring("p_brand", 1, 3), F.lit(" "), F.substr("p_brand", F.lit(4), (c("p_partkey") % 5).cast("int")))
    q = p.select("p_partkey", F.when(c("p_size") > 1, split).otherwise(" ").alias("prefix"))
    return P.by_prefix(q, "prefix", p.select(F.upper("p_brand").alias("code")), "code")


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'E' || c_nationkey ELSE 'W' || c_nationkey END AS area, c_custkey % 3 <> 0 OR c_custkey % 4 = 1 AS working, c_custkey % 5 NOT IN (0, 1) AS receives_benefits,
 CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE least(c_custkey % 6, 3) END AS INT) AS child_count, CASE WHEN c_custkey % 6 > 0 AND c_custkey % 100 < 60 THEN '0-4' ELSE '5+' END AS youngest_band, 'nursery,' || lower(c_mktsegment) AS care_types FROM customer""".replace("'nursery,' || lower(c_mktsegment)", "CASE WHEN lower(c_mktsegment) < 'nursery' THEN lower(c_mktsegment) || ',nursery' ELSE 'nursery,' || lower(c_mktsegment) END"))
def visit_properties(spark, d):
    k = c("c_custkey")
    status = lambda n, r: F.when(k % n != r, "employed").otherwise("not_working")
    areas = F.array(F.concat(F.lit("W"), "c_nationkey"), F.concat(F.when(c("c_nationkey") % 3 == 0, "E").otherwise("S"), c("c_nationkey").cast("string")))
    partner = F.when(k % 4 == 1, "self_employed").when(k % 4 == 2, "not_working")
    benefits = F.when(k % 5 == 0, F.array(F.lit("x"), F.lit("none"))).when(k % 5 > 1, F.array(F.lit("x")))
    ages = F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), 1, (k % 6).cast("int")), lambda x: x + (k % 100).cast("int"))
    sought = F.array(F.lit("nursery"), F.lower("c_mktsegment"), F.lit(None).cast("string"), F.lit("nursery"))
    x = P.visit_properties(areas, status(3, 0), partner, benefits, ages, sought)
    return table(spark, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", "x.*").withColumn("care_types", F.array_join("care_types", ","))


@query("""SELECT 'lazy_number' AS "check", count(*) FILTER (c_name LIKE '%000' OR c_name LIKE '%99') AS n FROM customer UNION ALL SELECT 'suspicious_balance', count(*) FILTER (c_acctbal < 0 OR c_acctbal > 9000) FROM customer
UNION ALL SELECT 'unusual_segment', count(*) FILTER (c_mktsegment NOT LIKE '%E' AND c_mktsegment NOT LIKE '%Y') FROM customer UNION ALL SELECT 'equal_bounds', count(*) FILTER (c_nationkey = c_custkey % 25) FROM customer""")
def audit_counts(spark, d):
    checks = {
        "lazy_number": c("c_name").like("%000") | c("c_name").like("%99"),
        "suspicious_balance": ~c("c_acctbal").between(0, 9000),
        "unusual_segment": ~c("c_mktsegment").rlike("[EY]$"),
        "equal_bounds": c("c_nationkey") == c("c_custkey") % 25,
    }
    return P.audit(table(spark, d, "customer"), checks)


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders, max(o_orderkey) AS last FROM orders GROUP BY 1")
def restored_backup(spark, d):
    """Lists and structs go through a backup and come back with their types."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("orders"), F.struct(F.max("o_orderkey").alias("last")).alias("ends"))
    path = scratch.shared_path(spark, "backup")
    P.backup(rows, path)
    return P.restore(spark, path).select("o_custkey", F.array_join(F.transform("orders", lambda x: x.cast("string")), ",").alias("orders"), "ends.last")
