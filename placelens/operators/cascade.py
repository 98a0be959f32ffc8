"""Cascades that link listed providers to inspected ones and to schools: the first tier that finds a match wins.

Tiers that compare texts at one postcode go through one q-gram index, where the
tier is a part of the block, and only rows that exact tiers left are compared.
In a tier the greatest ratio wins, of equals the least number of the other side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions import geo, names, text
from placelens.operators import scratch
from placelens.operators.linkage import unique_names
from placelens.operators.similar import similar_pairs

# Kinds of providers that are linked to schools, clubs among them, and first letters of areas without these registers.
SCHOOL_KINDS = ("school_based_nursery", "breakfast_club", "after_school_club", "holiday_club")
CLUB_KINDS = ("after_school_club", "breakfast_club", "holiday_club")
ELSEWHERE = ("S", "W", "N")
# Thresholds.
AT_POSTCODE, ADDRESS_PREFIX, LEAST_PREFIX, IN_AREA, NEAR_M, NEAR_RATIO = 0.80, 0.85, 10, 0.92, 500.0, 0.40
# Words that most schools have in their names.
COMMON_WORDS = (
    "school", "academy", "primary", "infant", "junior", "first", "middle", "infants", "juniors", "nursery", "secondary", "high", "college", "cofe", "ce", "rc", "va", "vc",
    "voluntary", "aided", "controlled", "community", "church", "england", "catholic", "saint", "st", "the", "of", "and",
)

c = F.col


def _in_area(lad: Column) -> Column:
    return ~reduce(lambda a, b: a | b, (F.coalesce(lad, F.lit("")).startswith(x) for x in ELSEWHERE))


def _first(candidates: DataFrame) -> DataFrame:
    """Of (id, match_id, tier, ratio): the least tier, then the greatest ratio, then the least match_id."""
    best = F.min(F.struct("tier", (-c("ratio")).alias("less"), "match_id")).alias("b")
    return candidates.groupBy("id").agg(best).select("id", c("b.match_id").alias("match_id"), c("b.tier").alias("tier"), (-c("b.less")).alias("ratio"))


def _tiers(df: DataFrame, *tiers: tuple[int, Column, Column | None], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per tier (number, text, condition) with a text: id, postcode, tier, n (0), text and the kept columns."""
    each = [F.when((F.lit(True) if when is None else when) & (own != ""), F.struct(F.lit(k).alias("tier"), own.alias("text"))) for k, own, when in tiers]
    out = df.where("postcode <> ''").select("id", "postcode", *keep, F.explode(F.array_compact(F.array(*each))).alias("t"))
    return out.select("id", "postcode", *keep, "t.tier", F.lit(0).alias("n"), "t.text")


def _compared(left: DataFrame, right: DataFrame, threshold: float, where: Column) -> DataFrame:
    """(id, match_id, tier, ratio) of the best of each tier; blocks are postcode, tier and n."""
    block = ["postcode", "tier", "n"]
    first = right.groupBy(*block, c("text").alias("match_text")).agg(F.min("id").alias("match_id"))
    pairs = similar_pairs(left, right, block, threshold).where(where).join(first, [*block, "match_text"])
    best = pairs.groupBy(*block, "text").agg(F.min(F.struct((-c("ratio")).alias("less"), "match_id")).alias("b"))
    return left.join(best, [*block, "text"]).select("id", c("b.match_id").alias("match_id"), "tier", (-c("b.less")).alias("ratio"))


def _labelled(left: DataFrame, found: DataFrame, labels: dict[int, str]) -> DataFrame:
    label = F.coalesce(*(F.when(c("tier") == k, v) for k, v in labels.items()))
    return left.join(found, "id", "left").select(left["*"], "match_id", label.alias("method"), F.round("ratio", 4).alias("confidence"))


def inspection_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match_id, method, confidence) of providers against a register of inspected ones.

    left: id, area (code), urn, name, postcode, address, as listed; right: urn, name, registered_name, postcode, address.
    Tiers: the number; at the postcode the name (or the registered one); the name without qualifiers, if that
    changes it; the name against the venue of "operator @ venue"; the address. Areas elsewhere are not_applicable.
    """
    bare = names.without_category(c("name"))
    normal, stripped = text.normalise_name(bare), text.normalise_name(names.unqualified(bare))
    # names are few bytes and much work: both sides are spread and normalised once
    rows = scratch.spread(left.where(_in_area(c("area")))).select("id", text.clean_urn(c("urn")).alias("urn"), text.normalise_postcode(c("postcode")).alias("postcode"), normal.alias("normal"), stripped.alias("stripped"), text.normalise_name(c("address")).alias("address"))
    rows = scratch.written(rows)
    by_number = right.where("urn <> ''").groupBy("urn").agg(F.min("urn").alias("match_id"))
    sure = scratch.written(rows.join(by_number, "urn").select("id", "match_id", F.lit(0).alias("tier"), F.lit(1.0).alias("ratio")))
    rest = rows.join(sure.select("id"), "id", "left_anti")
    own = _tiers(rest, (1, c("normal"), None), (2, c("stripped"), c("stripped") != c("normal")), (3, c("normal"), None), (4, c("address"), None))
    plain = {"name": c("name"), "registered": c("registered_name"), "venue": names.after_at(c("name")), "address": c("address")}
    other = scratch.written(scratch.spread(right).select(c("urn").alias("id"), text.normalise_postcode(c("postcode")).alias("postcode"), *(text.normalise_name(v).alias(k) for k, v in plain.items())))
    other = _tiers(other, (1, c("name"), None), (1, c("registered"), None), (2, c("name"), None), (2, c("registered"), None), (3, c("venue"), None), (4, c("address"), None))
    found = _first(sure.unionByName(_compared(own, other, AT_POSTCODE, F.lit(True))))
    labels = {0: "urn_exact", 1: "postcode_name", 2: "postcode_name_stripped", 3: "postcode_ofsted_venue", 4: "postcode_address"}
    out = _labelled(left.select("id", "area"), found, labels)
    return out.select("id", "match_id", F.when(~_in_area(c("area")), "not_applicable").otherwise(F.coalesce("method", F.lit("unmatched"))).alias("method"), "confidence")


def school_links(left: DataFrame, schools: DataFrame, inspected: DataFrame) -> DataFrame:
    """(id, match_id, method, confidence) of providers against schools.

    left: id, area, kind, urn, name, postcode, address, lat, lon; schools: urn, name, postcode, address, area,
    lat, lon; inspected: urn. Providers of every kind are linked by a number that is a school's and not an
    inspected one's, by the venue in their name, and by a name whose words are all in the other's. Those of
    school kinds go on: number; name without the care it ends in; venue; the address as a name; the start of
    the address, as long as the school's name; address. Where no school has their postcode: the name in the area,
    then a name that one school in all has. At last the nearest school of the area within 500 m, if what is left
    of the names without common words is alike; its confidence falls with the distance. A coordinate 0 counts as missing.
    Other kinds without a match have no method.
    """
    plain = lambda x: F.coalesce(text.normalise_name(names.without_care(x)), F.lit(""))
    venue, schooled, club = text.extract_venue(c("name")), c("kind").isin(*SCHOOL_KINDS), c("kind").isin(*CLUB_KINDS)
    # names are few bytes and much work: both sides are spread and normalised once
    rows = scratch.spread(left.where(_in_area(c("area")))).select(
        "id", "area", "urn", "lat", "lon", F.coalesce(schooled, F.lit(False)).alias("schooled"), text.normalise_postcode(c("postcode")).alias("postcode"), plain(c("name")).alias("plain"), plain(venue).alias("venue"),
        plain(c("address")).alias("place"), text.normalise_name(c("address")).alias("address"), plain(F.when(club & venue.isNotNull(), venue).otherwise(c("name"))).alias("text"),
    )
    own = scratch.spread(schools).select(c("urn").alias("id"), "area", "lat", "lon", text.normalise_postcode(c("postcode")).alias("postcode"), text.normalise_name(c("name")).alias("name"), text.normalise_name(c("address")).alias("address"))
    rows, own = scratch.written(rows), scratch.written(own)
    numbers = own.where("id <> ''").select(c("id").alias("urn")).distinct()
    numbered = rows.where("urn <> ''").join(numbers, "urn")
    by_number = numbered.where("schooled").unionByName(numbered.where("not schooled").join(inspected.select("urn").distinct(), "urn", "left_anti"))
    found = scratch.written(by_number.select("id", c("urn").alias("match_id"), F.lit(0).alias("tier"), F.lit(1.0).alias("ratio")))

    rest = rows.join(found.select("id"), "id", "left_anti")
    mine = _tiers(rest, (1, c("plain"), c("schooled")), (2, c("venue"), None), (3, c("plain"), None), (4, c("place"), c("schooled")), (6, c("address"), c("schooled")))
    theirs = _tiers(own, *((k, c("name"), None) for k in (1, 2, 3, 4)), (6, c("address"), None))
    # the start of an address is as long as the name that it is held against: blocks by length
    long_names = own.where((F.length("name") >= LEAST_PREFIX) & (c("postcode") != "")).select("id", "postcode", F.lit(5).alias("tier"), F.length("name").alias("n"), c("name").alias("text"))
    lengths = long_names.select("postcode", "n").distinct()
    starts = rest.where("schooled and postcode <> ''").join(lengths, "postcode").where(F.length("place") > c("n")).select("id", "postcode", F.lit(5).alias("tier"), "n", F.left("place", c("n")).alias("text"))
    where = F.when(c("tier") == 3, text.words_subset(c("text"), c("match_text"))).when(c("tier") == 5, c("ratio") >= ADDRESS_PREFIX).otherwise(True)
    found = scratch.written(found.unionByName(_first(_compared(mine.unionByName(starts), theirs.unionByName(long_names), AT_POSTCODE, where))))

    rest = scratch.written(rows.where("schooled").join(found.select("id"), "id", "left_anti"))
    far = rest.join(own.where("postcode <> ''").select("postcode").distinct(), "postcode", "left_anti")  # no postcode, or one without schools
    block = lambda df, t: df.where(c("area").isNotNull()).select("id", c("area").alias("postcode"), F.lit(7).alias("tier"), F.lit(0).alias("n"), c(t).alias("text"))
    in_area = _compared(block(far, "text"), block(own, "name"), IN_AREA, F.lit(True))
    once = unique_names(own.where("name <> ''").select("id", "name")).select(c("name").alias("text"), c("id").alias("match_id"))
    alone = far.join(once, "text").select("id", "match_id", F.lit(8).alias("tier"), F.lit(1.0).alias("ratio"))
    near = nearest_within(rest.where("lat <> 0 and lon <> 0"), own, NEAR_M)
    gated = names.without_words(c("text"), COMMON_WORDS) != ""
    named = near.join(rest.select("id", "text"), "id").where(gated).join(own.select(c("id").alias("match_id"), "name"), "match_id")
    close = names.similar_without(c("text"), c("name"), COMMON_WORDS) >= NEAR_RATIO
    by_place = named.where(close).select("id", "match_id", F.lit(9).alias("tier"), (1 - c("metres") / NEAR_M).alias("ratio"))
    found = found.unionByName(_first(in_area.unionByName(alone).unionByName(by_place)))

    labels = {0: "urn_exact", 1: "postcode_name", 2: "postcode_name_venue", 3: "postcode_name_subset", 4: "postcode_addr_name", 5: "postcode_addr_prefix", 6: "postcode_address", 7: "la_name", 8: "national_name", 9: "coord_proximity"}
    out = _labelled(left.select("id", "area", schooled.alias("schooled")), found, labels)
    none = F.when(c("schooled"), F.when(_in_area(c("area")), "unmatched").otherwise("not_applicable"))
    return out.select("id", "match_id", F.coalesce("method", none).alias("method"), "confidence")


def nearest_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """(id, match_id, metres) of the nearest row of right in the same area, where one is near enough; of equals the least.

    Both: id, area, lat, lon. Rows meet on cells as high as the distance; a row of left looks up the
    cells that a circle around it may touch, more of them by longitude towards the poles.
    """
    high = metres / 1000 / (2 * 3.14159265 * geo.EARTH_KM / 360) * 1.001
    cell = lambda x: F.floor(x / high)
    reach = F.least(high / F.greatest(F.cos(F.radians(F.least(F.abs(c("lat")) + high, F.lit(90.0)))), F.lit(1e-6)), F.lit(180.0))
    looked = left.where("lat is not null and lon is not null").select("id", "area", "lat", "lon", F.explode(F.sequence(cell(c("lat") - high), cell(c("lat") + high))).alias("gy"), reach.alias("reach"))
    looked = looked.withColumn("gx", F.explode(F.sequence(cell(c("lon") - c("reach")), cell(c("lon") + c("reach")))))
    other = right.where("lat is not null and lon is not null").select("area", c("id").alias("match_id"), c("lat").alias("r_lat"), c("lon").alias("r_lon"), cell(c("lat")).alias("gy"), cell(c("lon")).alias("gx"))
    met = looked.join(other, ["area", "gy", "gx"]).withColumn("m", 1000 * geo.haversine_km(c("lat"), c("lon"), c("r_lat"), c("r_lon"))).where(c("m") <= metres)
    best = met.groupBy("id").agg(F.min(F.struct("m", "match_id")).alias("b"))
    return best.select("id", c("b.match_id").alias("match_id"), c("b.m").alias("metres"))


def listed_in(links: DataFrame, numbers: DataFrame, columns: list[str]) -> DataFrame:
    """links with listed: any of the columns holds a number (column urn) of the list."""
    has = numbers.select(c("urn").alias("_urn")).where("_urn is not null").distinct()
    long = links.select("id", F.explode(F.array_compact(F.array(*columns))).alias("_urn"))
    hit = long.join(has, "_urn").select("id").distinct().withColumn("listed", F.lit(True))
    return links.join(hit, "id", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
