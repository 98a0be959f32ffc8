"""Link cascades over customers, where each tier wins for some: their names, addresses and places go by the key, and SQL states who wins.

A customer's counterpart has the same key and mostly its postcode. Ratios that are not 1 are stated as 2M/T of the names at hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import cascade, resolve
from placelens.plans.base import table
from placelens.plans.registry import registry
from placelens.functions.similarity import similarity

QUERIES, ORACLE_SQL, query = registry()
c = F.col


def _by_kind(texts: dict[int, str], kinds: int, other: str = "NULL"):
    """A column by key modulo kinds, each an SQL expression over k."""
    return F.expr(f"CASE k % {kinds} {' '.join(f'WHEN {n} THEN {t}' for n, t in texts.items())} ELSE {other} END")


def _keys(spark, d):
    return table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_custkey").alias("k"), c("c_nationkey").alias("nation"))



@query("""SELECT id, CASE k WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 'EY' || id END AS match_id, CASE k WHEN 0 THEN 'urn_exact' WHEN 1 THEN 'postcode_name' WHEN 2 THEN 'postcode_name_stripped' WHEN 3 THEN 'postcode_ofsted_venue'
 WHEN 4 THEN 'postcode_address' WHEN 5 THEN 'postcode_name' WHEN 6 THEN 'unmatched' WHEN 7 THEN 'not_applicable' END AS method,
 CASE k WHEN 1 THEN round(2 * 16 / 39, 4) WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 1.0 END AS confidence FROM (SELECT c_custkey AS id, c_custkey % 8 AS k FROM customer)""")
def inspection_links(spark, d):
    rows = _keys(spark, d)
    name = {0: "'Any'", 1: "'Oakfield Primary - Childcare providers'", 2: "'Moonbeams Out of School Club (Northern Quarter)'", 3: "'Hilltop Academy'", 4: "'Sunny Days'", 5: "'Ann Smith'", 6: "'Sunny Days'"}
    left = rows.select(
        "id", F.expr("concat(CASE WHEN k % 8 = 7 THEN 'S' ELSE 'E' END, nation)").alias("area"), F.expr("CASE WHEN k % 8 = 0 THEN concat('EY', k, ' Link to report') WHEN k % 8 = 1 THEN '0' END").alias("urn"), _by_kind(name, 8, "'Any'").alias("name"),
        F.expr("concat('p', k)").alias("postcode"), _by_kind({4: "'12 St Marys Rd.'", 6: "'1 Elm Way'"}, 8).alias("address"),
    )
    listed = {1: "'Oakfield Primary School'", 2: "'Moonbeams'", 3: "'Fun Days Team @ Hilltop Academy'", 4: "'Bright Futures'", 5: "'Tall Trees Childminding'", 6: "'Sunset'"}
    right = rows.select(
        F.expr("concat('EY', k)").alias("urn"), _by_kind(listed, 8, "'Other'").alias("name"), _by_kind({5: "'Ann Smith'"}, 8).alias("registered_name"), F.expr("concat(' P', k)").alias("postcode"), _by_kind({4: "'12, Saint Marys Rd'", 6: "'99 Long Road'"}, 8).alias("address"),
    )
    return cascade.inspection_links(left, right)


_SCHOOL_CASE = "SELECT c_custkey AS id, c_custkey % 17 AS k, 50 + CAST(c_custkey % 997 AS DOUBLE) / 100 AS lat, c_custkey // 997 AS band FROM customer"
_METRES = "1000 * 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat + 0.002 - lat) / 2), 2)))"


@query(f"""SELECT id, CASE WHEN k IN (10, 11, 14, 15) THEN NULL ELSE 's' || id END AS match_id,
 CASE k WHEN 0 THEN 'urn_exact' WHEN 1 THEN 'postcode_name' WHEN 2 THEN 'postcode_name_venue' WHEN 3 THEN 'postcode_name_subset' WHEN 4 THEN 'postcode_addr_name' WHEN 5 THEN 'postcode_addr_prefix' WHEN 6 THEN 'postcode_address'
  WHEN 7 THEN 'la_name' WHEN 8 THEN 'national_name' WHEN 9 THEN 'coord_proximity' WHEN 10 THEN 'unmatched' WHEN 11 THEN 'not_applicable' WHEN 12 THEN 'postcode_name_venue' WHEN 13 THEN 'urn_exact' WHEN 16 THEN 'la_name' END AS method,
 CASE k WHEN 1 THEN round(2 * 16 / 39, 4) WHEN 3 THEN round(2 * 13 / 32, 4) WHEN 9 THEN round(1 - {_METRES} / 500, 4) WHEN 10 THEN NULL WHEN 11 THEN NULL WHEN 14 THEN NULL WHEN 15 THEN NULL ELSE 1.0 END AS confidence,
 k IN (0, 13) AS breakfast FROM ({_SCHOOL_CASE})""")
def school_links(spark, d):
    """Kinds by key modulo 17: one each for a tier, then no match, elsewhere, other kinds of providers (venue, number, nothing, an inspected number), and a club's venue in its area."""
    rows = _keys(spark, d).withColumn("lat", 50 + (c("k") % 997).cast("double") / 100).withColumn("lon", F.floor(c("k") / 997).cast("double") / 10 + 1)
    own = "concat('Q', k, ' ', k, ' R', k, ' ', k)"  # names that are unlike those of other keys
    name = {
        0: "'Any'", 1: "'Oakfield Primary - Nursery'", 2: "'Fun Days Club @ Hillside Academy - Breakfast Club'", 3: "'Meadow Infant'", 4: "'Kids Zone'", 5: "'Kids Zone'", 6: "'Kids Zone'", 7: own, 8: own,
        9: "'Bright Sparks School'", 10: "'Bright Sparks School'", 12: "'Fun Days Club at Hillside Academy'", 16: f"concat('Busy Bees Club @ ', {own})",
    }
    kind = F.expr("CASE WHEN k % 17 IN (2, 16) THEN 'breakfast_club' WHEN k % 17 IN (3, 12, 13, 14, 15) THEN 'day_nursery' ELSE 'school_based_nursery' END")
    address = {4: "'Riverside Primary'", 5: "'St Johns Primary, Long Road, Town'", 6: "'77 Harbour Street'"}
    left = rows.select(
        "id", F.expr("concat(CASE WHEN k % 17 = 11 THEN 'W' WHEN k % 17 = 8 THEN 'EX' ELSE 'E' END, nation)").alias("area"), kind.alias("kind"), F.expr("CASE WHEN k % 17 IN (0, 13, 15) THEN concat('s', k) END").alias("urn"), _by_kind(name, 17, "'Nothing Alike'").alias("name"),
        F.expr("CASE WHEN k % 17 NOT IN (7, 8, 9, 16) THEN concat('p', k) WHEN k % 17 = 16 THEN concat('none', k) END").alias("postcode"), _by_kind(address, 17).alias("address"), F.expr("CASE WHEN k % 17 IN (9, 10) THEN lat END").alias("lat"), "lon",
    )
    listed = {
        1: "'Oakfield Primary School'", 2: "'Hillside Academy'", 3: "'Meadow Green Infant'", 4: "'Riverside Primary'", 5: "'St Johns Primary'", 6: "'Quayside College'", 7: own, 8: own, 9: "'Bright Stars Primary School'", 10: "'Bright Stars Primary School'",
        12: "'Hillside Academy'", 16: own,
    }
    schools = rows.select(
        F.expr("concat('s', k)").alias("urn"), _by_kind(listed, 17, "'Zebra House'").alias("name"), F.expr("concat('P', k)").alias("postcode"), _by_kind({6: "'77, Harbour Street'"}, 17).alias("address"), F.expr("concat('E', nation)").alias("area"),
        (c("lat") + F.when(c("k") % 17 == 10, 0.005).otherwise(0.002)).alias("lat"), F.expr("CASE WHEN k % 17 IN (9, 10) THEN lon END").alias("lon"),
    )
    links = cascade.school_links(left, schools, rows.select(F.expr("CASE WHEN k % 17 = 15 THEN concat('s', k) END").alias("urn")))
    listed_numbers = rows.select(F.expr("CASE WHEN k % 17 IN (0, 13, 14) THEN concat('s', k) END").alias("urn"))
    return cascade.listed_in(links, listed_numbers, ["match_id"]).withColumnRenamed("listed", "breakfast")


@query("""SELECT id, CASE WHEN k <> 3 THEN 's' || id END AS match_id, CAST(CASE WHEN k = 0 THEN 1 WHEN k <> 3 THEN 2 END AS INT) AS level FROM (SELECT c_custkey AS id, c_custkey % 4 AS k FROM customer) WHERE k <> 3""")
def named_at_postcode(spark, d):
    """The same URL first, else a name of 0.85 or more at the postcode: 'little acorn' and 'little acorns' have 24/25, 'oak tree' and 'oak trees' 16/17, 'elm' and 'fir' nothing."""
    rows = _keys(spark, d)
    left = rows.select("id", _by_kind({1: "'little acorn'", 2: "'oak trees'"}, 4, "'elm'").alias("name"), F.expr("concat('p', k)").alias("postcode"), F.expr("CASE WHEN k % 4 = 0 THEN concat('https://x.org/', k) END").alias("url"))
    right = rows.select(F.expr("concat('s', k)").alias("match_id"), _by_kind({1: "'little acorns'", 2: "'oak tree'"}, 4, "'fir'").alias("match_name"), F.expr("concat('p', k)").alias("postcode"), F.expr("concat('https://x.org/', k)").alias("url"))
    return resolve.two_level_match(left, right, "url", "postcode", similarity("name", "match_name"), 0.85)
