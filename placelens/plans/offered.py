"""Claims of care by six sources made of customers, suppliers and parts, and what they come to."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import offerings as O
from placelens.plans.base import table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


def _sql(spark, d, name, sql):
    return spark.sql(sql.replace(f"FROM {name}", "FROM {rows}"), rows=table(spark, d, name))


_POSTCODE = "concat('AB', {k} % 90 + 10, ' ', {k} % 10, 'XY')"


def _sources(spark, d):
    """Listings, inspections, census, scheme, agency and clubs. Numbers are the keys of customers (c) or suppliers (s)."""
    listings = _sql(spark, d, "customer", f"""SELECT concat('E0', c_nationkey) AS area, CAST(c_custkey AS STRING) AS provider_id, CASE c_custkey % 5 WHEN 0 THEN array('private_nursery', 'after_school_club', 'private_nursery') WHEN 1 THEN NULL WHEN 2 THEN array() WHEN 3 THEN array('childminder') ELSE array('x') END AS classes,
      CASE WHEN c_custkey % 5 = 0 THEN array('Nursery', 'Club') END AS labels, CASE WHEN c_custkey % 5 = 1 THEN 'Oak Breakfast Club' ELSE 'Oak' END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE {_POSTCODE.format(k='c_custkey')} END AS postcode FROM customer""")
    links = _sql(spark, d, "customer", "SELECT concat('E0', c_nationkey) AS area, CASE WHEN c_custkey % 5 <> 4 THEN CAST(c_custkey AS STRING) END AS provider_id, CASE WHEN c_custkey % 5 = 3 THEN concat('s', c_custkey) END AS urn, CAST(NULL AS STRING) AS school_urn FROM customer")
    inspections = _sql(spark, d, "supplier", f"""SELECT concat('s', s_suppkey) AS urn, CASE WHEN s_suppkey % 8 = 0 THEN 'Childminder' WHEN s_suppkey % 8 = 7 THEN 'Other' ELSE 'Childcare on non-domestic premises' END AS kind,
      CASE s_suppkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Out-of-school day care' WHEN 6 THEN 'New kind' WHEN 7 THEN '' ELSE 'Full day care' END AS subkind, concat('Area ', s_nationkey) AS authority,
      CASE s_suppkey % 8 WHEN 2 THEN 'Sunny Holiday Camp' WHEN 4 THEN 'Kids ASC' WHEN 6 THEN 'REDACTED' WHEN 7 THEN 'REDACTED' ELSE 'Kids' END AS name, CASE WHEN s_suppkey % 8 = 6 THEN 'REDACTED' ELSE {_POSTCODE.format(k='s_suppkey')} END AS postcode,
      CASE WHEN s_suppkey % 8 IN (1, 2, 3) THEN 'CCR-VCR' WHEN s_suppkey % 8 = 4 THEN 'VCR only' WHEN s_suppkey % 8 = 5 THEN 'CCR only' ELSE 'EYR' END AS register FROM supplier""")
    scraped = _sql(spark, d, "supplier", f"SELECT CASE WHEN s_suppkey % 8 = 6 THEN concat('s', s_suppkey) END AS urn, 'Scraped' AS name, {_POSTCODE.format(k='s_suppkey')} AS postcode, CASE WHEN s_suppkey % 16 = 6 THEN 'success' ELSE 'failed' END AS status FROM supplier")
    consented = _sql(spark, d, "supplier", "SELECT CASE WHEN s_suppkey % 8 = 6 THEN concat('s', s_suppkey) END AS urn, 'Consented' AS name, 'zz1 1zz' AS postcode FROM supplier")
    areas = _sql(spark, d, "nation", "SELECT concat('Area ', n_nationkey) AS name, concat(CASE WHEN n_nationkey % 5 = 0 THEN 'E100' ELSE 'E0' END, n_nationkey) AS code FROM nation")
    districts = _sql(spark, d, "supplier", f"SELECT DISTINCT {_POSTCODE.format(k='s_suppkey')} AS postcode, CASE WHEN s_suppkey % 90 < 60 THEN concat('E07', s_suppkey % 90) END AS district FROM supplier")
    census = _sql(spark, d, "customer", f"""SELECT concat('c', c_custkey) AS urn, concat('School ', c_custkey) AS name, {_POSTCODE.format(k='c_custkey')} AS postcode, concat('E0', c_nationkey) AS area, CASE c_custkey % 6 WHEN 0 THEN 'State-funded nursery' WHEN 4 THEN 'Pupil referral unit' ELSE 'State-funded primary' END AS phase,
      CASE c_custkey % 6 WHEN 1 THEN '12' WHEN 5 THEN 'c' ELSE '0' END AS n_nursery FROM customer""")
    register = _sql(spark, d, "customer", "SELECT concat('c', c_custkey) AS urn, CASE WHEN c_custkey % 6 IN (0, 2) THEN 'Has Nursery Classes' ELSE 'No' END AS provision FROM customer")
    scheme = _sql(spark, d, "customer", "SELECT CASE WHEN c_custkey % 4 <> 3 THEN concat(CASE WHEN c_custkey % 4 = 2 THEN 'x' ELSE 'c' END, c_custkey) END AS urn, concat('Member ', c_custkey) AS name, concat('Area ', c_nationkey) AS authority, CASE WHEN c_custkey % 4 = 0 THEN 'Special_AP' ELSE 'Primary' END AS kind FROM customer")
    feed = _sql(spark, d, "supplier", f"SELECT concat('s', s_suppkey) AS urn, 'Agency Kids' AS name, {_POSTCODE.format(k='s_suppkey')} AS postcode, CASE WHEN s_suppkey % 3 = 0 THEN concat('Area ', s_nationkey) END AS authority, CASE WHEN s_suppkey % 2 = 0 THEN 'open' ELSE 'closed' END AS status FROM supplier")
    clubs = _sql(spark, d, "customer", f"SELECT concat('c', c_custkey) AS school_urn, concat('School ', c_custkey) AS name, {_POSTCODE.format(k='c_custkey')} AS postcode, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 3 END AS before_spaces, CASE WHEN c_custkey % 14 = 7 THEN 5 END AS after_spaces FROM customer")
    return O.claims(O.listed(listings, links), O.inspected(inspections, scraped, consented, areas, districts), O.schools(census, register), O.members(scheme, census, areas), O.agency(feed, areas, districts), O.wraparound(clubs, "E06000023"))


def _code(p: str) -> str:
    return f"'AB' || ({p} % 90 + 10) || ' ' || {p} % 10 || 'XY'"


_AREA = "CASE WHEN {n} % 5 = 0 THEN 'E100' ELSE 'E0' END || {n}"
_CLAIMS = f"""
SELECT 'la_scrape' AS source, 'E0' || c_nationkey || ':' || c_custkey AS source_id, 'E0' || c_nationkey AS area, x.care AS care_type, x.label AS label, x.method AS method, CASE WHEN c_custkey % 5 = 1 THEN 'Oak Breakfast Club' ELSE 'Oak' END AS name,
 CASE WHEN c_custkey % 3 <> 0 THEN {_code('c_custkey')} END AS postcode, CASE WHEN c_custkey % 5 = 3 THEN 's' || c_custkey END AS urn, NULL AS school_urn, NULL AS phase, 0 AS rank
FROM (SELECT *, unnest(CASE c_custkey % 5 WHEN 0 THEN [{{'care': 'private_nursery', 'label': 'Nursery', 'method': 'structured'}}, {{'care': 'after_school_club', 'label': 'Club', 'method': 'structured'}}]
  WHEN 1 THEN [{{'care': 'breakfast_club', 'label': 'Oak Breakfast Club', 'method': 'inferred_from_name'}}] WHEN 2 THEN [{{'care': NULL, 'label': NULL, 'method': 'none'}}] WHEN 3 THEN [{{'care': 'childminder', 'label': NULL, 'method': 'structured'}}] END) AS x FROM customer WHERE c_custkey % 5 <> 4)
UNION ALL SELECT 'ofsted', 's' || s_suppkey, CASE WHEN s_nationkey % 5 = 0 AND NOT (k = 6 AND s_suppkey % 16 <> 6) AND s_suppkey % 90 < 60 THEN 'E07' || s_suppkey % 90 ELSE {_AREA.format(n='s_nationkey')} END,
 CASE k WHEN 0 THEN 'childminder' WHEN 1 THEN 'after_school_club' WHEN 2 THEN 'holiday_club' WHEN 4 THEN 'after_school_club' WHEN 6 THEN 'private_nursery' END,
 CASE k WHEN 0 THEN 'Childminder' WHEN 1 THEN 'Childcare on non-domestic premises — Out-of-school day care' WHEN 6 THEN 'Childcare on non-domestic premises — New kind' WHEN 7 THEN 'Other' ELSE 'Childcare on non-domestic premises — Full day care' END,
 CASE WHEN k IN (0, 1, 2, 4, 6) THEN 'registration_type_map' END, CASE WHEN k = 2 THEN 'Sunny Holiday Camp' WHEN k = 4 THEN 'Kids ASC' WHEN k = 6 AND s_suppkey % 16 = 6 THEN 'Scraped' WHEN k = 6 THEN 'Consented' WHEN k <> 7 THEN 'Kids' END,
 CASE WHEN k = 6 AND s_suppkey % 16 <> 6 THEN 'ZZ1 1ZZ' ELSE {_code('s_suppkey')} END, 's' || s_suppkey, NULL, NULL, 1 FROM (SELECT *, s_suppkey % 8 AS k FROM supplier) WHERE k <> 5
UNION ALL SELECT 'school_census', 'c' || c_custkey, 'E0' || c_nationkey, CASE WHEN k < 3 THEN 'school_based_nursery' END, phase, CASE k WHEN 0 THEN 'phase_type' WHEN 1 THEN 'census_nursery_pupils' WHEN 2 THEN 'gias_nursery_provision' END, 'School ' || c_custkey, {_code('c_custkey')}, NULL, 'c' || c_custkey, phase, 2
FROM (SELECT *, c_custkey % 6 AS k, CASE WHEN c_custkey % 6 = 0 THEN 'State-funded nursery' ELSE 'State-funded primary' END AS phase FROM customer) WHERE k <> 4
UNION ALL SELECT 'free_breakfast', CASE WHEN k = 2 THEN 'x' ELSE 'c' END || c_custkey, CASE WHEN k = 2 THEN {_AREA.format(n='c_nationkey')} ELSE 'E0' || c_nationkey END, 'free_breakfast_club', 'Free breakfast club scheme', CASE WHEN k = 2 THEN 'scheme_membership' ELSE 'scheme_membership_census_enriched' END, 'Member ' || c_custkey,
 CASE WHEN k <> 2 THEN {_code('c_custkey')} END, NULL, CASE WHEN k = 2 THEN 'x' ELSE 'c' END || c_custkey, CASE WHEN k <> 2 THEN CASE c_custkey % 6 WHEN 0 THEN 'State-funded nursery' WHEN 4 THEN 'Pupil referral unit' ELSE 'State-funded primary' END END, 3 FROM (SELECT *, c_custkey % 4 AS k FROM customer) WHERE k IN (1, 2)
UNION ALL SELECT 'tiney', 's' || s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN {_AREA.format(n='s_nationkey')} WHEN s_suppkey % 90 < 60 THEN 'E07' || s_suppkey % 90 END, 'childminder', 'Tiney CMA childminder', 'source_feed', 'Agency Kids', {_code('s_suppkey')}, 's' || s_suppkey, NULL, NULL, 4 FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'bristol_wraparound', 'c' || c_custkey, 'E06000023', care, CASE care WHEN 'breakfast_club' THEN 'Wraparound childcare (before school)' ELSE 'Wraparound childcare (after school)' END, 'council_wraparound_directory', 'School ' || c_custkey, {_code('c_custkey')}, NULL, 'c' || c_custkey, NULL, 5
FROM customer, (VALUES ('breakfast_club'), ('after_school_club')) v(care) WHERE c_custkey % 7 = 0 AND CASE care WHEN 'breakfast_club' THEN c_custkey % 3 > 0 ELSE c_custkey % 2 = 1 END"""


@query(_CLAIMS)
def offering_claims(spark, d):
    return _sources(spark, d)


@query(f"""WITH o AS (SELECT coalesce(urn, school_urn, source_id) AS place, * FROM ({_CLAIMS}) WHERE care_type IS NOT NULL), w AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY place, care_type ORDER BY rank, source_id) = 1)
SELECT w.place, w.care_type, w.source, w.area, w.name, coalesce((SELECT string_agg(DISTINCT o.source || '/' || coalesce(o.area, '') || '/' || o.name, ';' ORDER BY o.source || '/' || coalesce(o.area, '') || '/' || o.name) FROM o WHERE o.place = w.place AND o.care_type = w.care_type AND o.rank > w.rank AND (o.area IS DISTINCT FROM w.area OR o.name IS DISTINCT FROM w.name)), '') AS conflicts FROM w""")
def settled_offerings(spark, d):
    rows = O.settled(_sources(spark, d))
    said = F.array_join(F.array_sort(F.transform("conflicts", lambda x: F.concat_ws("/", x["source"], F.coalesce(x["area"], F.lit("")), x["name"]))), ";")
    return rows.select("place", "care_type", "source", "area", "name", said.alias("conflicts"))


@query(f"""WITH s AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 5 = 0 THEN [0, 1, 2] ELSE [] END AS parts FROM nation) SELECT o.source_id, o.care_type, coalesce('E07' || n || '_' || part, area) AS area
FROM ({_CLAIMS}) o LEFT JOIN (SELECT 'E100' || n AS county, n, unnest(parts) AS part FROM s) c ON c.county = o.area WHERE source IN ('ofsted', 'free_breakfast')""")
def offerings_by_district(spark, d):
    """A county stands for its three districts."""
    counties = _sql(spark, d, "nation", "SELECT concat('E100', n_nationkey) AS county, concat('E07', n_nationkey, '_', part) AS district FROM nation LATERAL VIEW explode(array(0, 1, 2)) AS part WHERE n_nationkey % 5 = 0")
    return O.by_district(_sources(spark, d).where("source in ('ofsted', 'free_breakfast')"), counties).select("source_id", "care_type", "area")
