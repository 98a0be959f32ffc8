"""Fields of records over texts made from the test tables; the SQL tells what they mean from the same numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import records as R
from placelens.functions import text
from placelens.plans.base import from_sql, table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col

#: A part's key, a kind of text, and two numbers. n has six digits.
_PARTS = "SELECT p_partkey AS id, p_partkey % 5 AS kind, p_size AS a, 100000 + p_partkey % 900000 AS n, p_name AS name FROM part"


def _parts(spark, d, *texts: str):
    """Parts with a text t by kind; a kind without a text has null."""
    cases = " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts))
    return from_sql(spark, d, _PARTS, "part").withColumn("t", F.expr(f"CASE kind {cases} END" if cases else "string(null)"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'AB' || a || ' 2CD' WHEN 1 THEN 'M1 1AE' WHEN 2 THEN 'ZZ' WHEN 3 THEN '' END AS postcode, kind = 1 AS valid FROM ({_PARTS})")
def postcode_variants(spark, d):
    p = _parts(spark, d, "concat('a b', a, '2c d ')", "'m11ae'", "' zz'", "''")
    known = lambda *xs: F.array(*map(F.lit, xs))
    return p.select("id", R.spaced_postcode(c("t")).alias("postcode"), R.valid_postcode(c("t"), known("M1", "SW1A"), known("1AE", "9ZZ")).alias("valid"))


@query(f"SELECT id, CAST(CASE kind WHEN 0 THEN a WHEN 1 THEN a + 2 WHEN 2 THEN a END AS INT) AS children FROM ({_PARTS})")
def registered_children(spark, d):
    return _parts(spark, d, "concat('Places 9; Admissions: ', a)", "concat(a + 2, ' children, age 3')", "concat('admissions:', a, ' of 99')", "'none'").select("id", R.registered_children(c("t")).alias("children"))


@query(f"SELECT id, CASE kind WHEN 0 THEN '2024-03-0' || (a % 9 + 1) WHEN 1 THEN 'n/a' WHEN 2 THEN '31/02/2024' WHEN 3 THEN '2020-12-31' END AS day, CASE a % 6 WHEN 1 THEN 'Outstanding' WHEN 2 THEN 'Good' WHEN 3 THEN 'Requires improvement' WHEN 4 THEN 'Inadequate' END AS grade FROM ({_PARTS})")
def inspection_fields(spark, d):
    p = _parts(spark, d, "concat('0', a % 9 + 1, '/03/2024')", "'n/a'", "'31/02/2024'", "'31/12/2020'")
    return p.select("id", R.iso_date(c("t")).alias("day"), R.grade_label(c("a") % 6).alias("grade"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'bristol|bristol, city of' WHEN 1 THEN 'hull' WHEN 2 THEN 'stoke-on-trent|stoke on trent' WHEN 3 THEN 'bath & avon|bath and avon' ELSE '' END AS some FROM ({_PARTS})")
def area_name_variants(spark, d):
    p = _parts(spark, d, "'Bristol, City of'", "' Hull'", "'Stoke-on-Trent'", "'Bath & Avon'", "''")
    return p.select("id", F.array_join(R.area_name_variants(c("t")), "|").alias("some"))


@query("SELECT o_orderkey, CASE WHEN m < 1 THEN '<1mi' WHEN m < 3 THEN '1-3mi' WHEN m < 5 THEN '3-5mi' WHEN m < 10 THEN '5-10mi' WHEN m IS NULL THEN 'unknown' ELSE '10+mi' END AS band FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 20000 END AS m FROM orders)")
def distance_bands(spark, d):
    return table(spark, d, "orders").select("o_orderkey", R.distance_band(F.when(c("o_orderstatus") != "P", c("o_totalprice") / 20000)).alias("band"))


@query("SELECT o_orderkey, CASE WHEN k = 0 THEN '' WHEN bool_or(months < 60) AND bool_or(months >= 60) THEN '0-4|5+' WHEN bool_or(months < 60) THEN '0-4' ELSE '5+' END AS bands FROM (SELECT o_orderkey, o_orderkey % 4 AS k, unnest([o_custkey % 120, o_orderkey % 90, 59 + o_orderkey % 2]) AS months FROM orders) GROUP BY o_orderkey, k")
def child_age_bands(spark, d):
    ages = F.when(c("o_orderkey") % 4 != 0, F.array(c("o_custkey") % 120, c("o_orderkey") % 90, 59 + c("o_orderkey") % 2)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(R.age_bands(ages), "|").alias("bands"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'Oak School|Elm Primary ' || a WHEN 1 THEN 'Ash|Fir Green' WHEN 2 THEN 'Yew' ELSE '' END AS places FROM ({_PARTS})")
def place_names(spark, d):
    p = _parts(spark, d, """concat('["oak school", "ELM primary ', a, '", "Oak School"]')""", "'ash and fir green; ASH'", "' yew ,'", "''")
    return p.select("id", F.array_join(R.place_names(c("t")), "|").alias("places"))


@query(f"SELECT id, CASE kind WHEN 0 THEN '01234' || n WHEN 1 THEN '01234' || n || '|07000' || n WHEN 2 THEN '01234' || n || '|0117900900' ELSE '' END AS phones FROM ({_PARTS})")
def phone_lists(spark, d):
    p = _parts(spark, d, "concat('01234 ', n, ' / (01234) ', n)", "concat('call 01234-', n, ' or 07000 ', n)", "concat('01234', n, '0117900900')", "'0800 1'")
    return p.select("id", F.array_join(F.coalesce(R.phone_list(c("t")), F.array().cast("array<string>")), "|").alias("phones"))


@query(f"SELECT id, CASE kind WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN n || 'x' WHEN 2 THEN '' WHEN 3 THEN n || 'ab' || n || 'ac' END AS once FROM ({_PARTS})")
def undoubled_phones(spark, d):
    return _parts(spark, d, "concat(n, n)", "concat(n, 'x')", "''", "concat(n, 'ab', n, 'ac')").select("id", R.undoubled(c("t")).alias("once"))


@query(f"""SELECT id, CASE kind WHEN 0 THEN a || ' High St' WHEN 1 THEN CAST(NULL AS VARCHAR) WHEN 2 THEN 'Hall' END AS line1, CASE kind WHEN 0 THEN 'Old Town' WHEN 2 THEN 'Back Lane' END AS line2, CASE kind WHEN 0 THEN 'Leeds' WHEN 1 THEN 'York' WHEN 2 THEN 'Hull' END AS town, CASE kind WHEN 0 THEN 'LS1 4AP' WHEN 2 THEN 'HU1 1AA' END AS postcode,
 CASE kind WHEN 0 THEN 'Leeds' WHEN 2 THEN 'Hull' END AS town_of_three FROM ({_PARTS})""")
def address_parts(spark, d):
    p = _parts(spark, d, "concat(a, ' High St, Old Town, , Leeds, LS1 4AP')", "'York'", "'Hall, Back Lane, hu11aa, Hull'")
    return p.select("id", R.address_parts(c("t")).alias("x"), R.address_parts(c("t"), 3)["town"].alias("town_of_three")).select("id", "x.*", "town_of_three")


@query(f"SELECT id, CASE kind WHEN 0 THEN 'EY' || n WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN 'CA12' END AS reference, CASE kind WHEN 3 THEN CAST(n AS VARCHAR) END AS linked FROM ({_PARTS})")
def reference_numbers(spark, d):
    p = _parts(spark, d, "concat('see ey', n, '.')", "concat('URN: ', n)", "'(CA12)'", "concat('https://reports.example/provider/16/', n, '?x')", "'12345678'")
    return p.select("id", F.when(c("kind") != 3, R.reference_number(c("t"))).alias("reference"), R.number_in_link(c("t")).alias("linked"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'Smith' || a || ', Ann' WHEN 1 THEN 'Smith, Ann' WHEN 2 THEN 'Little Stars Nursery' WHEN 3 THEN 'Ng, Ann May' WHEN 4 THEN 'Cher' END AS person, CASE kind WHEN 3 THEN 'Ann May Ng' END AS extra FROM ({_PARTS})")
def person_names(spark, d):
    p = _parts(spark, d, "concat('Ann Smith', a)", "'Smith, Ann'", "'Little Stars Nursery'", "'Ann May Ng'", "'Cher'")
    return p.select("id", R.surname_first(c("t")).alias("person"), R.quarantined(c("t"), c("t").contains("May"))["extra"].alias("extra"))


@query(f"SELECT id, CASE kind WHEN 0 THEN 'Oak - North ' || a WHEN 1 THEN 'Elm' END AS name, CASE kind WHEN 0 THEN 'Day nursery' END AS type FROM ({_PARTS})")
def names_and_types(spark, d):
    return _parts(spark, d, "concat('Oak - North ', a, ' - Day nursery')", "'Elm'").select("id", R.name_and_type(c("t")).alias("x")).select("id", "x.*")


@query(f"SELECT id, CASE kind WHEN 0 THEN 'nursery|club|minder' WHEN 1 THEN 'club|minder' ELSE 'minder' END AS labels FROM ({_PARTS})")
def label_classes(spark, d):
    known = {"day nursery": "nursery", "nursery": "nursery", "after school club": "club", "childminder": "minder"}
    p = _parts(spark, d, "'Nursery / Day Nursery; after school club, unknown'", "'After School Club'")
    return p.select("id", F.array_join(R.with_labels(R.classes(c("t"), known), F.array(F.lit("minder"))), "|").alias("labels"))


@query(f"""SELECT id, CASE kind WHEN 0 THEN '{{"a":"1","b":"' || a || '"}}' WHEN 1 THEN '{{"b":"' || a || '"}}' ELSE '{{"b":"' || a || '"}}' END AS merged, CASE kind WHEN 2 THEN 2 ELSE 0 END AS n_listed FROM ({_PARTS})""")
def merged_json(spark, d):
    p = _parts(spark, d, """'{"a":"1","b":"0"}'""", "'no json'", """'["x","y"]'""")
    return p.select("id", R.merged_json(c("t"), F.concat(F.lit('{"b":"'), c("a"), F.lit('"}'))).alias("merged"), F.size(R.json_list(F.when(c("kind") == 2, c("t")))).alias("n_listed"))


@query("SELECT id, CASE k WHEN 0 THEN '£' || a || '.50' WHEN 1 THEN '£1,' || (a + 200) WHEN 2 THEN '£' || (a + 11) END AS shown FROM (SELECT c_custkey AS id, c_custkey % 3 AS k, c_custkey % 9 AS a FROM customer)")
def shown_currency(spark, d):
    p = from_sql(spark, d, "SELECT c_custkey AS id, c_custkey % 3 AS k, c_custkey % 9 AS a FROM customer", "customer")
    return p.select("id", text.currency(F.when(c("k") == 0, c("a") + 0.5).when(c("k") == 1, c("a") + 1200.2).otherwise(c("a") + 10.5)).alias("shown"))


@query("SELECT c_custkey AS id, c_custkey % 3 <> 2 AS alike, CASE c_custkey % 2 WHEN 0 THEN 'County of Kent' ELSE 'Kent' END AS area, 'name' || c_nationkey AS source, 'x' AS head, c_nationkey || ':y' AS rest FROM customer")
def word_and_label_rules(spark, d):
    cust, k = table(spark, d, "customer"), c("c_custkey")
    other = F.when(k % 3 == 0, F.lit("oak")).when(k % 3 == 1, F.lit("oak tree house")).otherwise(F.lit("oak house hill"))
    head, rest = text.split_first(F.concat(F.lit("x:"), c("c_nationkey"), F.lit(":y")))
    return cust.select(k.alias("id"), text.words_subset(F.lit("oak tree"), other).alias("alike"), text.name_inversion(F.when(k % 2 == 0, "Kent, County of").otherwise("Kent")).alias("area"), text.last_segment(F.concat(F.lit("la_extract:7:name"), c("c_nationkey"))).alias("source"), head.alias("head"), rest.alias("rest"))
