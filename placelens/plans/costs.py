"""Scores, rates, entitlements and household costs over made columns of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import decisions, household, quality, scoring
from placelens.plans.base import from_sql, table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col


@query("""WITH x AS (SELECT p_partkey, p_partkey % 5 AS f, ['Outstanding', 'Good', 'Requires Improvement', 'Inadequate'][1 + p_partkey % 4] AS r, ['Outstanding', 'Good', 'Requires Improvement', 'Inadequate'][1 + p_size % 4] AS s, p_partkey % 3 = 0 AS flag FROM part)
SELECT p_partkey, round(CASE f WHEN 0 THEN CASE r WHEN 'Outstanding' THEN 9 WHEN 'Good' THEN 6 WHEN 'Requires Improvement' THEN 3 ELSE 0 END + (CASE s WHEN 'Outstanding' THEN 1 WHEN 'Good' THEN 0.67 WHEN 'Requires Improvement' THEN 0.33 ELSE 0 END + CASE r WHEN 'Outstanding' THEN 1 WHEN 'Good' THEN 0.67 WHEN 'Requires Improvement' THEN 0.33 ELSE 0 END) / 2 - CASE WHEN flag THEN 0 ELSE 1 END
 WHEN 1 THEN (CASE s WHEN 'Outstanding' THEN 10 WHEN 'Good' THEN 6.67 WHEN 'Requires Improvement' THEN 3.33 ELSE 0 END + CASE r WHEN 'Outstanding' THEN 10 WHEN 'Good' THEN 6.67 WHEN 'Requires Improvement' THEN 3.33 ELSE 0 END) / 2 - CASE WHEN flag THEN 0 ELSE 1 END
 WHEN 2 THEN -10 - CASE WHEN flag THEN 0 ELSE 1 END WHEN 3 THEN -10 ELSE CASE WHEN p_partkey % 2 = 0 THEN 4.5 ELSE -10 END END, 4)::DOUBLE AS score FROM x""")
def inspection_score(spark, d):
    grades = F.array(*map(F.lit, ("Outstanding", "Good", "Requires Improvement", "Inadequate")))
    r, s = F.get(grades, (c("p_partkey") % 4).cast("int")), F.get(grades, c("p_size") % 4)
    framework = F.get(F.array(*map(F.lit, ("legacy", "legacy_transition", "report_card", "other", None))), (c("p_partkey") % 5).cast("int"))
    score = scoring.inspection_score(framework, r, [s, r, F.lit(None).cast("string")], [F.lit(None).cast("string")], [c("p_partkey") % 3 == 0, F.lit(None).cast("boolean")], F.when(c("p_partkey") % 2 == 0, 4.5))
    return table(spark, d, "part").select("p_partkey", F.round(score, 4).alias("score"))


_FEE_SQL = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'all' ELSE 'under2' END AS band, CASE l_suppkey % 3 WHEN 0 THEN 'breakfast_club' WHEN 1 THEN 'after_school_club' ELSE 'nursery' END AS care_type,
 CASE WHEN l_partkey % 7 = 0 THEN l_extendedprice / 1000 END AS per_hour, CASE WHEN l_partkey % 5 = 0 THEN l_extendedprice / 100 END AS full_day, CASE WHEN l_partkey % 4 = 0 THEN l_extendedprice / 200 END AS morning,
 CASE WHEN l_partkey % 3 = 0 THEN l_extendedprice / 300 END AS per_session, CASE WHEN l_partkey % 2 = 0 THEN l_extendedprice / 150 END AS per_day, CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity / 5 END AS hours, CASE WHEN l_suppkey % 2 = 0 THEN 8.0E0 END AS day_hours FROM lineitem"""


@query(f"""WITH x AS ({_FEE_SQL}), h AS (SELECT *, CASE WHEN hours IS NULL OR hours <= 0 THEN NULL WHEN care_type = 'breakfast_club' THEN least(hours, 1.5) WHEN care_type = 'after_school_club' THEN least(hours, 3.0) ELSE hours END AS sh FROM x)
SELECT l_orderkey, l_linenumber, round(CASE WHEN per_hour IS NOT NULL THEN per_hour WHEN band <> 'all' AND full_day / day_hours IS NOT NULL THEN full_day / day_hours WHEN band <> 'all' AND morning IS NOT NULL THEN morning / 5
 WHEN per_session IS NOT NULL THEN per_session / sh WHEN hours > 0 THEN per_day / hours ELSE per_day / 10 END, 9) AS rate FROM h""")
def hourly_rate_waterfall(spark, d):
    x = from_sql(spark, d, _FEE_SQL, "lineitem")
    none = F.lit(None).cast("double")
    fee = {"per_hour": c("per_hour"), "full_day": c("full_day"), "morning_session": c("morning"), "afternoon_session": none, "per_session": c("per_session"), "per_day": c("per_day")}
    session = {"full_day": c("day_hours"), "morning": F.lit(5.0), "afternoon": none}
    return x.select("l_orderkey", "l_linenumber", F.round(scoring.hourly_rate(c("band"), fee, session, c("care_type"), c("hours")), 9).alias("rate"))


_CHILD_SQL = """SELECT o_orderkey AS child_id, year(o_orderdate) + 27 AS birth_year, month(o_orderdate) AS birth_month, o_custkey % 2 = 0 AS has_partner, o_custkey % 3 <> 0 AS user_works, o_custkey % 4 <> 0 AS partner_works,
 o_custkey % 9 = 0 AS user_exempt, o_custkey % 8 = 0 AS partner_exempt, o_custkey % 5 <> 0 AS earns_enough, o_totalprice > 250000 AS over_100k, o_custkey % 7 <> 0 AS in_england, o_custkey % 11 <> 0 AS public_funds, o_custkey % 13 <> 0 AS ni_number,
 o_orderkey % 17 = 0 AS fostered, o_orderkey % 19 = 0 AS disabled, o_custkey % 6 = 0 AS low_income, o_custkey % 6 < 2 AS on_uc, o_orderkey % 10 = 0 AS has_send, o_custkey % 6 < 3 AS benefit FROM orders"""
_AT = "DATE '2026-06-15'"
_TERM = "CASE WHEN birth_month >= 9 THEN make_date(birth_year + {n} + 1, 1, 1) WHEN birth_month >= 4 THEN make_date(birth_year + {n}, 9, 1) ELSE make_date(birth_year + {n}, 4, 1) END"
_SEPT = "make_date(birth_year + {n} + CASE WHEN birth_month >= 9 THEN 1 ELSE 0 END, 9, 1)"


def _scheme(name: str, **tests: str) -> str:
    failed = ", ".join(f"CASE WHEN NOT ({t}) THEN '{k}' END" for k, t in tests.items())
    return f"SELECT child_id, '{name}' AS scheme, list_filter([{failed}], lambda x: x IS NOT NULL) AS f FROM y"


_SCHEMES = " UNION ALL ".join((
    _scheme("30_hours_working_families", age="age >= 9", pre_school="pre", work="works", earnings="NOT works OR earns_enough", income="NOT over_100k", england="in_england", funds="public_funds", ni="ni_number"),
    _scheme("15_hours_universal", age=f"{_AT} >= {_TERM.format(n=3)}", pre_school="pre", england="in_england"),
    _scheme("15_hours_2_year_olds", england="in_england", age=f"{_AT} >= {_TERM.format(n=2)} AND {_AT} < {_TERM.format(n=3)}", circumstances="fostered OR disabled OR low_income"),
    _scheme("tax_free_childcare", age=f"{_AT} < CASE WHEN disabled THEN {_SEPT.format(n=16)} ELSE {_SEPT.format(n=11)} END", work="works", earnings="NOT works OR earns_enough", income="NOT over_100k", uc="NOT on_uc", fostered="NOT fostered"),
    _scheme("universal_credit_childcare", age=f"{_AT} < {_SEPT.format(n=16)}", uc="on_uc", work="works"),
    _scheme("wraparound", school="NOT pre", age="floor(age / 12) <= CASE WHEN has_send THEN 18 ELSE 14 END"),
    _scheme("breakfast_club", school="NOT pre", age="floor(age / 12) <= 11"),
    _scheme("holiday_activities", school="NOT pre", age="floor(age / 12) <= 16", benefit="benefit"),
))


@query(f"""WITH x AS ({_CHILD_SQL}), y AS (SELECT *, (2026 - birth_year) * 12 + 6 - birth_month AS age, (2026 - birth_year) * 12 + 6 - birth_month < 48 OR {_AT} < {_SEPT.format(n=4)} AS pre,
 CASE WHEN NOT has_partner THEN user_works ELSE user_works AND partner_works OR user_works AND partner_exempt OR partner_works AND user_exempt END AS works FROM x)
SELECT child_id, scheme, len(f) = 0 AS eligible, array_to_string(f, ',') AS failed FROM ({_SCHEMES})""")
def entitlements(spark, d):
    return scoring.entitlements(from_sql(spark, d, _CHILD_SQL, "orders"), F.lit("2026-06-15").cast("date"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 15 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 30 - CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 15 ELSE 0 END WHEN o_custkey % 7 = 0 THEN 15 ELSE 0 END AS INT) AS hours FROM orders")
def funded_hours(spark, d):
    k, o = c("o_custkey"), c("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", scoring.funded_hours(o % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("hours"))


@query("SELECT o_orderkey, round(least(o_totalprice / 20 * 0.2, CASE WHEN o_orderkey % 3 = 0 THEN 4000 ELSE 2000 END), 4) AS tax_free FROM orders")
def tax_free_support(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(scoring.tax_free_support(c("o_totalprice") / 20, c("o_orderkey") % 3 == 0), 4).alias("tax_free"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, e, floor(least(sum(e) OVER w / 12 * 0.85, CASE WHEN count(*) OVER w = 1 THEN 1031.88 ELSE 1768.94 END) * 12 * 100 + 0.5) / 100 AS award, sum(e) OVER w AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS last
 FROM (SELECT o_custkey, o_orderkey, floor(o_totalprice / 10) AS e FROM orders) WINDOW w AS (PARTITION BY o_custkey)), p AS (SELECT *, CASE WHEN t > 0 THEN floor(award * e / t * 100 + 0.5) / 100 ELSE 0 END AS part FROM a)
SELECT o_custkey, o_orderkey, award, round(CASE WHEN last THEN award - sum(CASE WHEN last THEN 0 ELSE part END) OVER (PARTITION BY o_custkey) ELSE part END, 2) AS credit FROM p""")
def credit_support(spark, d):
    own = table(spark, d, "orders").withColumn("e", F.floor(c("o_totalprice") / 10).cast("double"))
    return scoring.credit_support(own, "o_custkey", "o_orderkey", "e").select("o_custkey", "o_orderkey", "award", "credit")


@query("""SELECT k, rule FROM (SELECT p_partkey AS k, unnest([CASE WHEN NOT (o BETWEEN 5.5 AND 17.5) THEN 'open_range' END, CASE WHEN NOT (e BETWEEN 7.5 AND 19) THEN 'close_range' END, CASE WHEN NOT (e - o BETWEEN 0.75 AND 12) THEN 'duration' END, CASE WHEN p_size % 8 < 1 THEN 'no_day' END]) AS rule
 FROM (SELECT p_partkey, p_size, CAST(p_size AS DOUBLE) / 2 AS o, CAST(p_size + p_partkey % 20 AS DOUBLE) / 2 AS e FROM part)) WHERE rule IS NOT NULL""")
def opening_hours_quality(spark, d):
    p = table(spark, d, "part").select(c("p_partkey").alias("k"), "p_size", (c("p_size").cast("double") / 2).alias("o"), ((c("p_size") + c("p_partkey") % 20).cast("double") / 2).alias("e"))
    return quality.violations(p, "k", quality.opening_hours_rules(c("o"), c("e"), c("p_size") % 8))


@query("""SELECT p_partkey, CASE WHEN a AND b AND far THEN 'success_postcode_override' WHEN a THEN 'success' WHEN b THEN 'success_postcode_fallback' WHEN p_size % 2 = 0 THEN 'api_error' ELSE 'no_results' END AS status, CASE WHEN a AND NOT (b AND far) THEN 51.0E0 WHEN b THEN 51.0E0 + CAST(p_size AS DOUBLE) / 500 END AS lat
 FROM (SELECT p_partkey, p_size, p_partkey % 3 <> 0 AS a, p_partkey % 4 <> 0 AS b, p_size * 6371.0 * pi() / 180 / 500 > 5 AS far FROM part)""")
def geocode_arbitration(spark, d):
    k, s = c("p_partkey"), c("p_size")
    g = decisions.arbitrate_geocode(F.when(k % 3 != 0, 51.0), F.when(k % 3 != 0, -1.0), F.when(k % 4 != 0, 51.0 + s.cast("double") / 500), F.when(k % 4 != 0, -1.0), s % 2 == 0)
    return table(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.status", "g.lat")


@query("SELECT p_partkey, CASE WHEN hi IS NULL THEN NULL WHEN mm IS NULL AND my IS NULL THEN 0 ELSE mm END AS min_months, CASE WHEN hi IS NOT NULL THEN my END AS min_years FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS mm, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS my, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS hi FROM part)")
def age_repair(spark, d):
    k, s = c("p_partkey"), c("p_size")
    months, years = decisions.repair_ages(F.when(k % 3 == 0, s), F.when(k % 4 == 0, s), F.when(k % 5 != 0, s))
    return table(spark, d, "part").select("p_partkey", months.alias("min_months"), years.alias("min_years"))


@query("""SELECT p_partkey, coalesce(b, a, z) AS value, CASE WHEN b IS NOT NULL THEN 'census' WHEN a IS NOT NULL THEN 'local' WHEN z IS NOT NULL THEN 'base' END AS source,
 array_to_string(list_filter([CASE WHEN z <> a THEN 'base:' || z END, CASE WHEN coalesce(a, z) <> b THEN CASE WHEN a IS NOT NULL THEN 'local:' ELSE 'base:' END || coalesce(a, z) END], lambda x: x IS NOT NULL), ',') AS conflicts
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS z, CASE WHEN p_partkey % 3 = 0 THEN p_size % 10 END AS a, CASE WHEN p_partkey % 5 = 0 THEN p_size % 7 END AS b FROM part)""")
def layered_values(spark, d):
    k, s = c("p_partkey"), c("p_size")
    v = decisions.layered(F.when(k % 2 == 0, s), ("local", F.when(k % 3 == 0, s % 10)), ("census", F.when(k % 5 == 0, s % 7)))
    return table(spark, d, "part").select("p_partkey", v.alias("v")).select("p_partkey", "v.value", "v.source", F.array_join("v.conflicts", ",").alias("conflicts"))


@query("SELECT p_partkey, CASE WHEN a AND b AND s THEN 'LA + Ofsted + School' WHEN a AND b THEN 'LA + Ofsted' WHEN a THEN 'LA only' WHEN b AND s THEN 'Ofsted + School' WHEN b THEN 'Ofsted only' ELSE 'Other' END AS tier FROM (SELECT p_partkey, p_partkey % 2 = 0 AS a, p_partkey % 3 = 0 AS b, p_partkey % 5 = 0 AS s FROM part)")
def source_tiers(spark, d):
    k = c("p_partkey")
    sources = F.array_compact(F.array(F.when(k % 2 == 0, "la_scrape"), F.when(k % 3 == 0, "ofsted"), F.when(k % 5 == 0, "school_census")))
    return table(spark, d, "part").select("p_partkey", decisions.source_tier(sources).alias("tier"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'L:' || p_brand WHEN 1 THEN 'T' WHEN 2 THEN 'R:' || array_to_string(list_sort([p_size % 5, p_size % 3]), '') || CASE WHEN p_size % 2 = 0 THEN 'Y' ELSE 'N' END || '-' END AS code FROM part""")
def inspection_codes(spark, d):
    framework = F.get(F.array(*map(F.lit, ("legacy", "legacy_transition", "report_card", None))), (c("p_partkey") % 4).cast("int"))
    code = decisions.inspection_code(framework, c("p_brand"), [c("p_size") % 5, c("p_size") % 3, F.lit(None).cast("int")], [c("p_size") % 2 == 0, F.lit(None).cast("boolean")])
    return table(spark, d, "part").select("p_partkey", code.alias("code"))


_CARE = "(CASE l_partkey % 6 WHEN 0 THEN 'private_nursery' WHEN 1 THEN 'childminder' WHEN 2 THEN 'breakfast_club' WHEN 3 THEN 'holiday_club' WHEN 4 THEN 'free_breakfast_club' ELSE 'school_based_nursery' END)"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CARE} AS care, l_linenumber % 3 AS m, l_linenumber % 2 AS f, l_quantity AS h, l_extendedprice / 100 AS fee, CASE WHEN l_suppkey % 2 = 0 THEN 38 ELSE 50 END AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN care LIKE '%nursery' THEN (m * fee + f * fee * 2) * w WHEN care = 'childminder' THEN h * fee * w WHEN care = 'breakfast_club' THEN m * fee * 38 WHEN care = 'holiday_club' THEN h * fee ELSE 0 END, 4) AS total,
 CAST(CASE WHEN care = 'holiday_club' THEN h WHEN care = 'childminder' THEN CASE WHEN m > 0 THEN m ELSE least(5, ceil(h / 6)) END * w WHEN care LIKE '%nursery' THEN greatest(m, f) * w ELSE m * 38 END AS DOUBLE) AS days FROM x""")
def gross_fees(spark, d):
    x = table(spark, d, "lineitem").withColumn("care", F.expr(_CARE)).withColumn("fee", c("l_extendedprice") / 100)
    m, f, h = c("l_linenumber") % 3, c("l_linenumber") % 2, c("l_quantity")
    w = F.when(c("l_suppkey") % 2 == 0, 38).otherwise(50)
    none = F.lit(None).cast("int")
    fees = {"morning": c("fee"), "afternoon": none, "full_day": c("fee") * 2, "per_hour": c("fee"), "per_session": c("fee"), "per_day": c("fee")}
    gross = household.gross_fee(c("care"), {"morning": m, "afternoon": none, "full_day": f}, fees, h, m, h, w)
    nursery = c("care").isin(*household.NURSERIES)
    days = household.attendance_days(c("care"), [F.when(nursery, m), F.when(nursery, f)], h, m, h, w)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(gross["total"], 4).alias("total"), days.cast("double").alias("days"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 256 & 8 <> 0 THEN o_custkey % 256 | 64 ELSE o_custkey % 256 END AS BIGINT) AS mask, coalesce(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 40 END <= 24, true) AND coalesce(CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 60 END >= 12, true) AS fits FROM orders")
def masks_and_age_overlap(spark, d):
    k = c("o_custkey")
    mask = decisions.expand_mask(k % 256, 3, 6)
    fits = decisions.age_overlap(F.when(k % 3 != 0, k % 40), F.when(k % 5 != 0, k % 60), F.lit(12), F.lit(24))
    return table(spark, d, "orders").select("o_orderkey", mask.cast("long").alias("mask"), fits.alias("fits"))


@query("""WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag = 'A' AND l_partkey % 2 = 0 AS moved, CASE WHEN l_returnflag = 'A' AND l_partkey % 2 = 0 THEN 'R' ELSE l_returnflag END AS kind, l_partkey * 1000 + l_suppkey AS tie FROM lineitem)
SELECT l_orderkey, kind, min(tie) AS tie FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, kind ORDER BY moved DESC, tie) AS r FROM m) WHERE r = 1 GROUP BY l_orderkey, kind""")
def reassigned_kinds(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", c("l_returnflag").alias("kind"), (c("l_partkey") * 1000 + c("l_suppkey")).alias("tie"))
    return decisions.reassign_and_dedupe(x, "l_orderkey", "kind", "A", "R", c("l_partkey") % 2 == 0, "tie").select("l_orderkey", "kind", "tie")
