"""Timelines of schemes and support of families over orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import answers, resolve, scratch, support, timeline
from placelens.plans.base import from_sql, table
from placelens.plans.costs import _AT, _CHILD_SQL, _SCHEMES, _SEPT
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col

#: Spells of work: always; with a gap that no first of a month falls into; two that overlap; two far apart.
_SPELLS = {0: [("2000-01-01", "2100-01-01")], 1: [("2026-01-01", "2026-09-10"), ("2026-09-20", "2027-01-15")], 2: [("2026-01-01", "2026-10-05"), ("2026-10-01", "2100-01-01")], 3: [("2026-09-01", "2026-09-30"), ("2027-02-02", "2027-04-01")]}
_WORKS_THEN = "CASE child_id % 4 " + " ".join(f"WHEN {k} THEN " + " OR ".join(f"at_date >= DATE '{a}' AND at_date < DATE '{b}'" for a, b in v) for k, v in _SPELLS.items()) + " END"


@query(f"""WITH dates AS (SELECT k, CASE WHEN k = 0 THEN {_AT} ELSE CAST(DATE '2026-06-01' + to_months(CAST(k AS INT)) AS DATE) END AS at_date FROM range(13) t(k)), x AS ({_CHILD_SQL}),
y AS (SELECT *, (year(at_date) - birth_year) * 12 + month(at_date) - birth_month AS age, (year(at_date) - birth_year) * 12 + month(at_date) - birth_month < 48 OR at_date < {_SEPT.format(n=4)} AS pre,
 CASE WHEN NOT has_partner THEN user_works ELSE user_works AND partner_works OR user_works AND partner_exempt OR partner_works AND user_exempt END AS works FROM x, dates),
e AS (SELECT child_id, k, at_date, scheme, len(f) = 0 AND (scheme NOT IN {timeline.WORKING} OR {_WORKS_THEN}) AS eligible FROM ({_SCHEMES.replace(_AT, 'at_date').replace('SELECT child_id,', 'SELECT child_id, k, at_date,')})),
b AS (SELECT child_id, scheme, eligible AS base FROM e WHERE k = 0)
SELECT child_id, scheme, CASE WHEN base THEN 'loss' ELSE 'gain' END AS direction, min(at_date) AS at FROM e JOIN b USING (child_id, scheme) WHERE k > 0 AND eligible <> base GROUP BY 1, 2, 3""")
def scheme_timeline(spark, d):
    """The SQL evaluates every scheme at 13 dates; the query reads borders."""
    children = scratch.dealt(from_sql(spark, d, _CHILD_SQL, "orders"), "child_id", rows=60_000)
    spell = F.array(*(F.array(*(F.struct(F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("stop")) for a, b in v)) for v in _SPELLS.values()))
    spells = children.select("child_id", F.explode(F.get(spell, (c("child_id") % 4).cast("int"))).alias("s")).select("child_id", "s.*")
    intervals = timeline.joined(timeline.cut(timeline.scheme_intervals(children), spells, timeline.WORKING))
    return timeline.transitions(intervals, F.lit("2026-06-15").cast("date"))


_FAMILY_SQL = """SELECT l_orderkey AS family, l_linenumber AS child, l_orderkey % 3 <> 0 OR l_linenumber % 2 = 0 AS tfc_eligible, l_orderkey % 5 <> 0 AND l_linenumber % 4 <> 0 AS uc_eligible, l_orderkey % 7 = 0 AS disabled, l_orderkey % 2 = 0 AS on_uc,
 CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber * 10.5 AS DOUBLE) END AS charges, CAST(l_quantity * 100 AS DOUBLE) AS fees_lower, CAST(l_quantity * 200 AS DOUBLE) AS fees_mean, CAST(l_quantity * 700 AS DOUBLE) AS fees_upper,
 CAST(l_quantity * 10 AS DOUBLE) AS saved_lower, CAST(l_quantity * 11 AS DOUBLE) AS saved_mean, CAST(l_quantity * 12 AS DOUBLE) AS saved_upper FROM lineitem"""
_TWO = "floor({x} * 100 + 0.5) / 100"


def _support_sql(choose: str) -> str:
    return f"""WITH f AS ({_FAMILY_SQL}), s AS (SELECT *, fees - saved AS cost FROM (SELECT family, child, tfc_eligible, uc_eligible, disabled, on_uc, charges, 'lower' AS variant, fees_lower AS fees, saved_lower AS saved FROM f
 UNION ALL SELECT family, child, tfc_eligible, uc_eligible, disabled, on_uc, charges, 'mean', fees_mean, saved_mean FROM f UNION ALL SELECT family, child, tfc_eligible, uc_eligible, disabled, on_uc, charges, 'upper', fees_upper, saved_upper FROM f)),
t AS (SELECT *, CASE WHEN tfc_eligible THEN {_TWO.format(x="least(cost * (0.25 / 1.25), CASE WHEN disabled THEN 4000 ELSE 2000 END)")} ELSE 0 END AS own_tfc, sum(CASE WHEN uc_eligible THEN cost END) OVER w AS costs, count(CASE WHEN uc_eligible THEN 1 END) OVER w AS n,
 max(CASE WHEN uc_eligible THEN child END) OVER w AS last FROM s WINDOW w AS (PARTITION BY family, variant)),
u AS (SELECT *, sum(own_tfc) OVER (PARTITION BY family, variant) AS tfc_total, CASE WHEN n > 0 THEN {_TWO.format(x="(least(costs / 12 * 0.85, CASE WHEN n = 1 THEN 1031.88 ELSE 1768.94 END) * 12)")} ELSE 0 END AS uc_total FROM t),
v AS (SELECT *, CASE WHEN {choose} THEN 'uc' ELSE 'tfc' END AS kind, CASE WHEN uc_eligible AND child <> last THEN {_TWO.format(x="(uc_total * (cost / costs))")} ELSE 0 END AS part FROM u),
k AS (SELECT *, CASE WHEN kind = 'tfc' THEN own_tfc ELSE 0 END AS tfc, CASE WHEN kind <> 'uc' THEN 0 WHEN uc_eligible AND child = last THEN {_TWO.format(x="(uc_total - sum(part) OVER (PARTITION BY family, variant))")} ELSE part END AS uc FROM v)
"""


@query(_support_sql("on_uc") + "SELECT family, child, variant, kind, round(tfc, 2) AS tfc, round(uc, 2) AS uc FROM k")
def support_by_child(spark, d):
    rows = support.by_child(from_sql(spark, d, _FAMILY_SQL, "lineitem"))
    return rows.select("family", "child", "variant", "kind", F.round("tfc", 2).alias("tfc"), F.round("uc", 2).alias("uc"))


@query(_support_sql("uc_total > tfc_total") + """SELECT family, round(sum(left_over) FILTER (variant = 'lower'), 2) AS lower, round(sum(left_over) FILTER (variant = 'mean'), 2) AS mean, round(sum(left_over) FILTER (variant = 'upper'), 2) AS upper,
 round(sum(tfc + uc) FILTER (variant = 'mean'), 2) AS support, max(kind) FILTER (variant = 'mean') AS kind FROM (SELECT *, fees + coalesce(charges, 0) - saved - tfc - uc AS left_over FROM k) GROUP BY family""")
def family_range(spark, d):
    """Each family has the support that pays more, in each variant for itself."""
    return support.family_range(support.by_child(from_sql(spark, d, _FAMILY_SQL, "lineitem"), support.better()))


_STATUS = ("not_working", "income_over_100k", "earning_above_nmw", "earning_above_apprentice_nmw", "earning_below")
_RESIDENCY = ("settled_status", "no_recourse_to_public_funds", "other", "british_irish_citizen")


def _person(k: str, who: str) -> str:
    cases = lambda values, by: f"CASE {k} % {len(values)} {' '.join(f'WHEN {n} THEN {v!r}' for n, v in enumerate(values))} END".replace(k, by)
    return (
        f"{cases(_STATUS, k)} AS {who}_status, {k} % 2 = 0 AS {who}_apprentice, {k} % 3 > 0 AS {who}_first, {k} % 4 = 0 AS {who}_self, {k} % 8 < 5 AS {who}_new, {k} % 3 = 0 AS {who}_allowance, {cases(_RESIDENCY, f'({k} + 1)')} AS {who}_residency, {k} % 10 > 0 AS {who}_ni"
    )


_FAMILIES = f"""SELECT c_custkey AS id, c_custkey % 3 <> 0 AS has_partner, {_person('c_custkey', 'u')}, {_person('(c_custkey // 5)', 'p')}, CASE c_custkey % 4 WHEN 0 THEN 'E09000001' WHEN 1 THEN 'W06000001' ELSE 'E06000001' END AS area,
 CASE c_custkey % 7 WHEN 0 THEN 'universal_credit' WHEN 1 THEN 'esa' WHEN 2 THEN 'other' END AS benefit, c_custkey % 14 = 0 AS uc_low, c_custkey % 3 + 1 AS n_children, CASE c_custkey % 5 WHEN 0 THEN 38600 WHEN 1 THEN 34500 WHEN 2 THEN 30600 WHEN 3 THEN 26500 END AS income, CASE WHEN c_custkey % 2 = 0 THEN 16000 END AS savings FROM customer"""
_EARNS = "({0}_status IN ('income_over_100k', 'earning_above_nmw') OR {0}_status = 'earning_above_apprentice_nmw' AND {0}_apprentice AND {0}_first)"
_OPEN = "{0}_residency IN ('settled_status', 'british_irish_citizen')"


@query(f"""WITH f AS ({_FAMILIES}), t AS (SELECT *, u_status <> 'not_working' AS user_works, has_partner AND p_status <> 'not_working' AS partner_works, {_EARNS.format('u')} AS u_earns, {_EARNS.format('p')} AS p_earns, u_self AND u_new AS u_starts, p_self AND p_new AS p_starts,
 {_OPEN.format('u')} AS u_open, has_partner AND {_OPEN.format('p')} AS p_open, u_residency = 'no_recourse_to_public_funds' AND (NOT has_partner OR p_residency = 'no_recourse_to_public_funds') AS closed,
 coalesce(income = CASE WHEN area LIKE 'E09%' THEN CASE WHEN n_children >= 2 THEN 38600 ELSE 34500 END ELSE CASE WHEN n_children >= 2 THEN 30600 ELSE 26500 END END, false) AS low, savings IS NOT NULL AS saved FROM f),
w AS (SELECT *, CASE WHEN NOT has_partner THEN user_works ELSE user_works AND (partner_works OR p_allowance) OR partner_works AND u_allowance END AS able FROM t)
SELECT id, user_works, partner_works, NOT (user_works AND NOT u_earns AND NOT u_starts) AND NOT (partner_works AND NOT p_earns AND NOT p_starts) AS earns_enough, u_status = 'income_over_100k' OR has_partner AND p_status = 'income_over_100k' AS over_100k, area LIKE 'E%' AS in_england,
 u_open OR p_open AS public_funds, u_ni AND (NOT has_partner OR p_ni) AS ni_number, coalesce(benefit = 'universal_credit' AND uc_low, false) OR closed AND low AND saved OR coalesce(benefit = 'esa', false) AS low_income,
 concat_ws(',', CASE WHEN has_partner AND user_works AND NOT partner_works AND p_allowance THEN 'partner_carers_allowance_exemption' END, CASE WHEN has_partner AND NOT user_works AND partner_works AND u_allowance THEN 'user_carers_allowance_exemption' END,
  CASE WHEN able AND NOT u_earns AND u_starts THEN 'user_self_employed_startup' END, CASE WHEN able AND partner_works AND NOT p_earns AND p_starts THEN 'partner_self_employed_startup' END, CASE WHEN u_open <> p_open AND has_partner THEN 'apply_with_public_funds_parent' END,
  CASE WHEN closed AND NOT low THEN 'nrpf_income_above_threshold' END, CASE WHEN closed AND NOT saved THEN 'nrpf_savings_above_limit' END) AS caveats FROM w""")
def family_tests(spark, d):
    rows = spark.sql(_FAMILIES.replace("FROM customer", "FROM {rows}").replace("//", "div"), rows=table(spark, d, "customer"))
    person = lambda w: F.struct(*(c(f"{w}_{a}").alias(b) for a, b in (("status", "status"), ("apprentice", "apprentice"), ("first", "first_year"), ("self", "self_employed"), ("new", "under_a_year"), ("allowance", "allowance"), ("residency", "residency"), ("ni", "ni"))))
    families = rows.select("id", "has_partner", person("u").alias("user"), F.when(c("has_partner"), person("p")).alias("partner"), F.array("area").alias("areas"), F.array_compact(F.array("benefit")).alias("benefits"), c("uc_low").alias("uc_income_low"), "n_children", c("income").alias("income_limit"), c("savings").alias("savings_limit"))
    return answers.family_tests(families).select("id", "user_works", "partner_works", "earns_enough", "over_100k", "in_england", "public_funds", "ni_number", "low_income", F.array_join("caveats", ",").alias("caveats"))


@query("""SELECT id, CASE k WHEN 0 THEN 'postcode' WHEN 1 THEN 'postcode_district' WHEN 2 THEN 'postcode_district' WHEN 3 THEN 'local_authority' WHEN 4 THEN 'county' WHEN 5 THEN 'local_authority' END AS geo_type,
 CASE k WHEN 0 THEN 'AB' || id % 90 || ' 1XY' WHEN 1 THEN 'BT' || id % 90 WHEN 2 THEN 'CD' || id % 90 WHEN 3 THEN 'E0' || n WHEN 4 THEN 'E10' || n WHEN 5 THEN 'E06' || n END AS geo_code,
 CASE k WHEN 0 THEN 'bbox_postcode' WHEN 1 THEN 'bbox_postcode_district' WHEN 2 THEN 'bbox_postcode_district' WHEN 3 THEN 'bbox_local_authority' WHEN 4 THEN 'bbox_county' WHEN 5 THEN 'bbox_local_authority' END AS status
FROM (SELECT c_custkey AS id, c_custkey % 7 AS k, c_nationkey AS n FROM customer)""")
def box_tiers(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_custkey % 7 AS k", "c_nationkey AS n")
    places = rows.selectExpr("id", "CASE k WHEN 0 THEN concat(' ab', id % 90, ' 1xy') WHEN 1 THEN concat('BT', id % 90, ' 9ZZ') WHEN 2 THEN concat('cd', id % 90) WHEN 3 THEN 'QQ1 1QQ' WHEN 4 THEN ' ' END AS postcode", "CASE WHEN k = 3 THEN concat('E0', n) WHEN k = 4 THEN 'X' END AS area", "CASE k WHEN 4 THEN concat('County ', n) WHEN 5 THEN concat(' Area ', n) WHEN 6 THEN 'Nowhere' ELSE 'County 1' END AS area_name")
    boxes = rows.selectExpr("explode(array(struct('postcode', concat('AB', id % 90, ' 1XY')), struct('postcode_district', concat('BT', id % 90)), struct('postcode_district', concat('CD', id % 90)), struct('local_authority', concat('E0', n)))) AS b").selectExpr("b.col1 AS geo_type", "b.col2 AS geo_code")
    names = rows.selectExpr("n").distinct().selectExpr("explode(array(struct(concat('County ', n), 'county', concat('E10', n)), struct(concat('Area ', n), 'local_authority', concat('E06', n)))) AS b").selectExpr("b.col1 AS name", "b.col2 AS geo_type", "b.col3 AS geo_code")
    return resolve.box_tier(places, boxes, names).select("id", "geo_type", "geo_code", "status")
