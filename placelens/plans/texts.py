"""Text, date and parser functions over the test tables. Where SQL cannot state a grammar, tests hold it against cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import numbers, parse, text
from placelens.functions.similarity import similarity
from placelens.operators import linkage
from placelens.plans.base import from_sql, table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()
c = F.col

# Made names and contacts: formulas over keys that SQL states alike.
_NAMES_SQL = """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'The St Mary''s C of E Prim. School Ltd' WHEN 1 THEN 'Little  Stars Nursery & Pre-School (UK)' WHEN 2 THEN 'R.C. Acad. of Holy Trinity'
 WHEN 3 THEN 'J I & N School, ' || c_mktsegment WHEN 4 THEN NULL ELSE 'Kids Club at ' || c_name || ' Primary School' END AS name FROM customer"""
_CONTACTS_SQL = """SELECT c_custkey AS id,
 CASE c_custkey % 6 WHEN 0 THEN '+44 1234 567 ' || CAST(100 + c_custkey % 900 AS VARCHAR) WHEN 1 THEN '01234 56789 or 07000 000000' WHEN 2 THEN '.07763356262/01234' WHEN 3 THEN 'n/a' WHEN 4 THEN '12345' ELSE '(0113) 496-0' || CAST(100 + c_custkey % 900 AS VARCHAR) END AS phone,
 CASE c_custkey % 6 WHEN 0 THEN ' a.b@example..org ' WHEN 1 THEN '//x@y.org,uk; z@z.com' WHEN 2 THEN 'www.site.com' WHEN 3 THEN 'nobody' WHEN 4 THEN 'm@n.co.uk.' ELSE 'u' || CAST(c_custkey AS VARCHAR) || '@h.net' END AS email,
 CASE c_custkey % 7 WHEN 0 THEN 'www.my site.co.uk' WHEN 1 THEN 'https://facebook.com/' WHEN 2 THEN 'http://facebook.com/page' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN 'https://google.com' WHEN 4 THEN 'https://example.co.ukOut of School' WHEN 5 THEN 'no web' ELSE 'http://a.b.org/x?y=1.' END AS website,
 CASE c_custkey % 5 WHEN 0 THEN ' sw1a1aa' WHEN 1 THEN 'M1 1AE' WHEN 2 THEN 'ZZ' WHEN 3 THEN 'je2 3ab' ELSE NULL END AS postcode FROM customer"""


def _made(spark, d, sql):
    return from_sql(spark, d, sql.replace("''", "\\'").replace("AS VARCHAR", "AS STRING"), "customer")


def _nested(patterns: list[tuple[str, str]], start: str) -> str:
    for pattern, full in patterns:
        start = f"regexp_replace({start}, '{pattern}', '{full}', 'g')"
    return start


_NORMAL = "trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(" + _nested(list(text.ABBREVIATIONS), "trim(lower(name))") + rf", '^the\s+', ''), '\b({text.LEGAL_FORMS})\b', '', 'g'), '''', ''), '&', ' and '), '[\-,.()/]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT id, coalesce({_NORMAL}, '') AS normal FROM ({_NAMES_SQL})")
def normalised_names(spark, d):
    return _made(spark, d, _NAMES_SQL).select("id", text.normalise_name(c("name")).alias("normal"))


@query(rf"""WITH p AS ({_CONTACTS_SQL}), a AS (SELECT id, CASE WHEN lower(trim(phone)) IN ('none', '-', 'not available', 'n/a', 'contact details withheld') THEN NULL ELSE trim(split_part(split_part(split_part(regexp_replace(trim(phone), '^\.', ''), ' or ', 1), '/', 1), ';', 1)) END AS s FROM p)
SELECT id, CASE WHEN length(x) >= 10 AND x LIKE '0%' THEN substr(x, 1, 11) END AS phone FROM (SELECT id, regexp_replace(regexp_replace(s, '^\+?44\s*', '0'), '[^0-9]', '', 'g') AS x FROM a)""")
def clean_phones(spark, d):
    return _made(spark, d, _CONTACTS_SQL).select("id", text.clean_phone(c("phone")).alias("phone"))


@query(r"""SELECT id, CASE k WHEN 0 THEN 'a.b@example.org' WHEN 1 THEN 'x@y.org.uk' WHEN 4 THEN 'm@n.co.uk' WHEN 5 THEN 'u' || id || '@h.net' END AS email FROM (SELECT c_custkey AS id, c_custkey % 6 AS k FROM customer)""")
def clean_emails(spark, d):
    return _made(spark, d, _CONTACTS_SQL).select("id", text.clean_email(c("email")).alias("email"))


@query("""SELECT id, CASE k WHEN 2 THEN 'http://facebook.com/page' || id WHEN 4 THEN 'https://example.co.uk' WHEN 6 THEN 'http://a.b.org/x?y=1' END AS website FROM (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer)""")
def clean_websites(spark, d):
    return _made(spark, d, _CONTACTS_SQL).select("id", text.clean_website(c("website")).alias("website"))


@query(rf"""WITH p AS ({_CONTACTS_SQL}) SELECT id, coalesce(CASE WHEN regexp_matches(postcode, '{text.POSTCODE}') THEN upper(regexp_extract(postcode, '{text.POSTCODE}', 1) || ' ' || regexp_extract(postcode, '{text.POSTCODE}', 2)) ELSE upper(trim(postcode)) END, '') AS postcode,
 CASE WHEN trim(postcode) LIKE '% %' THEN upper(split_part(trim(postcode), ' ', 1)) WHEN length(trim(postcode)) >= 5 THEN upper(substr(trim(postcode), 1, length(trim(postcode)) - 3)) ELSE upper(trim(postcode)) END AS outward, regexp_matches(upper(trim(postcode)), '^(JE|GY|IM|BF)') AS crown FROM p""")
def postcodes(spark, d):
    p = _made(spark, d, _CONTACTS_SQL)
    return p.select("id", text.normalise_postcode(c("postcode")).alias("postcode"), text.outward_code(c("postcode")).alias("outward"), text.is_crown_dependency(c("postcode")).alias("crown"))


@query(f"SELECT id, trim(regexp_extract(name, '(?i)\\bat\\s+(.+(?:school|academy|primary|infants?|juniors?|college|centre|church)\\b.*)', 1)) AS venue FROM ({_NAMES_SQL}) WHERE regexp_matches(name, '(?i)\\bat\\s+.+school')")
def venues(spark, d):
    return _made(spark, d, _NAMES_SQL).select("id", text.extract_venue(c("name")).alias("venue")).where("venue is not null")


@query("SELECT p_partkey, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w NOT IN ('', 'the', 'of', 'and', 'a'))), ' ') AS core FROM part")
def core_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", text.core_tokens(c("p_name")).alias("core"))


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'now' WHEN lower(o_orderpriority) LIKE '%high%' THEN 'soon' WHEN lower(o_orderpriority) LIKE '%low%' THEN 'late' END AS class FROM orders")
def first_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.first_label(c("o_orderpriority"), {"urgent": "now", "high": "soon", "low": "late"}).alias("class"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CASE WHEN url LIKE 'https%' THEN 'secure' ELSE 'plain' END AS scheme, split_part(regexp_extract(url, '^https?://([^/]+)', 1), '.', 1) AS first_part FROM pages""")
def url_classifier(spark, d):
    host = F.expr("parse_url(url, 'HOST')")
    return table(spark, d, "pages").select("page_id", host.alias("host"), F.when(c("url").startswith("https"), "secure").otherwise("plain").alias("scheme"), F.substring_index(host, ".", 1).alias("first_part"))


@query("""SELECT o_orderkey, (2026 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) AS months, CAST(floor(((2026 - year(o_orderdate)) * 12 + 6 - month(o_orderdate)) / 12) AS INT) AS years,
 CASE WHEN month(o_orderdate) >= 9 THEN make_date(year(o_orderdate) + 1, 1, 1) WHEN month(o_orderdate) >= 4 THEN make_date(year(o_orderdate), 9, 1) ELSE make_date(year(o_orderdate), 4, 1) END AS term,
 (2026 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) < 48 OR DATE '2026-06-15' < make_date(year(o_orderdate) + 4 + CASE WHEN month(o_orderdate) >= 9 THEN 1 ELSE 0 END, 9, 1) AS pre_school FROM (SELECT o_orderkey, o_orderdate + INTERVAL 25 YEAR AS o_orderdate FROM orders)""")
def ages_and_terms(spark, d):
    o = table(spark, d, "orders").withColumn("at", c("o_orderdate") + F.expr("interval 25 years"))
    y, m, at = F.year("at"), F.month("at"), F.lit("2026-06-15").cast("date")
    return o.select("o_orderkey", numbers.age_months(y, m, at).cast("long").alias("months"), numbers.age_years(y, m, at).alias("years"), numbers.next_term_start(y, m).alias("term"), numbers.is_pre_school(y, m, at).alias("pre_school"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS half_up, floor(l_extendedprice / 10 + 0.5) * 10 AS tens FROM lineitem")
def rounding(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_half_up(c("l_extendedprice") * c("l_discount")).alias("half_up"), numbers.round_to_ten(c("l_extendedprice")).cast("double").alias("tens"))


# Made texts of ages and fees from a part's numbers; the SQL states what they mean by arithmetic, not by a grammar.
_AGE_PARTS = "SELECT p_partkey, p_partkey % 6 AS kind, p_size % 11 + 1 AS a, p_size % 7 + 2 AS b FROM part"


@query(f"""SELECT p_partkey, CAST(CASE kind WHEN 0 THEN a WHEN 3 THEN 0 WHEN 4 THEN 0 END AS INT) AS min_months, CAST(CASE WHEN kind IN (1, 2) THEN b END AS INT) AS min_years,
 CAST(CASE kind WHEN 0 THEN b WHEN 2 THEN b + 4 WHEN 3 THEN b WHEN 4 THEN 18 END AS INT) AS max_years FROM ({_AGE_PARTS})""")
def parsed_age_ranges(spark, d):
    rows = from_sql(spark, d, _AGE_PARTS, "part")
    texts = ("concat(a, ' Months to ', b, ' years')", "concat('From ', b, ' years ', a, ' months')", "concat(b, ' - ', b + 4)", "concat('Up to ', b, ' years')", "'All ages'", "'adults'")
    raw = F.expr(f"CASE kind {' '.join(f'WHEN {k} THEN {t}' for k, t in enumerate(texts))} END")
    return rows.select("p_partkey", parse.parse_age_range(raw).alias("r")).select("p_partkey", "r.*")


_HOURS = ("Mon-Fri 08:00-18:00; Sat 9am to 1pm", "Monday to Thursday: 7.30 - 6", "Tue, Thu 15:15-17:45", "closed", "")


@query()
def parsed_opening_hours(spark, d):
    raw = F.element_at(F.array(*map(F.lit, _HOURS)), (c("p_partkey") % len(_HOURS) + 1).cast("int"))
    slots = table(spark, d, "part").select("p_partkey", F.explode(parse.parse_opening_hours(raw)).alias("s"))
    return slots.select("p_partkey", "s.days", "s.open", "s.close", numbers.decimal_hours(c("s.close")).alias("until"))


@query(f"""SELECT p_partkey, age_band, period, amount FROM (SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [{{'age_band': 'all', 'period': 'per_hour', 'amount': a + 0.5}}, {{'age_band': 'under2', 'period': 'full_day', 'amount': b * 10.0}}]
 WHEN 1 THEN [{{'age_band': 'all', 'period': 'morning_session', 'amount': b * 1.0}}, {{'age_band': 'all', 'period': 'afternoon_session', 'amount': a + 0.25}}, {{'age_band': 'age3to4', 'period': 'per_hour', 'amount': a * 1.0}}] END, recursive := true) FROM ({_AGE_PARTS}))""")
def parsed_fees(spark, d):
    rows = from_sql(spark, d, _AGE_PARTS, "part")
    raw = F.expr(r"""CASE p_partkey % 3 WHEN 0 THEN concat('£', a, '.50 per hour; under 2s £', b * 10, ' full day; £99 hourly') WHEN 1 THEN concat('Morning session £', b, '\n', 'Afternoon £', a, '.25', '\n', '3-4 years £ ', a, ' hourly') ELSE 'free' END""")
    return rows.select("p_partkey", F.explode(parse.parse_fees(raw)).alias("f")).select("p_partkey", "f.*")


@query()
def name_similarity(spark, d):
    """Similarity of each part's name to its type, by difflib's measure."""
    return table(spark, d, "part").select("p_partkey", F.round(similarity("p_name", "p_type"), 6).alias("ratio"))


@query()
def record_linkage(spark, d):
    """Customers linked to suppliers by number, by name at the same address, by name in the area, and by unique names."""
    cust, supp = table(spark, d, "customer"), table(spark, d, "supplier")
    left = cust.select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 4 == 0, c("c_custkey")).alias("urn"), text.normalise_name(F.regexp_replace("c_name", "#0+", " ")).alias("name"), (c("c_custkey") % 50).alias("postcode"), c("c_nationkey").alias("area"))
    right = supp.select(c("s_suppkey").alias("id"), c("s_suppkey").alias("urn"), text.normalise_name(F.regexp_replace("s_name", "Supplier#0+", "Customer ")).alias("name"), (c("s_suppkey") % 50).alias("postcode"), c("s_nationkey").alias("area"))
    return linkage.link(left, right)
