"""Record linkage: tiers of blocked matches, first tier wins, best candidate within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import scratch
from placelens.operators.similar import best_similar, similar_pairs


def best_match(candidates: DataFrame) -> DataFrame:
    """Of (id, match_id, tier, ratio): the least tier, then the greatest ratio, then the least match_id."""
    w = Window.partitionBy("id").orderBy("tier", F.desc("ratio"), "match_id")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_names(df: DataFrame) -> DataFrame:
    """Rows whose name occurs once in all."""
    once = df.groupBy("name").agg(F.count("*").alias("_n")).where("_n = 1").select("name")
    return df.join(once, "name", "left_semi")


def nearest_by_cells(rows: DataFrame, sites: DataFrame, keys: list[str], max_km: float, few: int = 16, steps: int = 8) -> DataFrame:
    """(id, match_id, km) of the nearest site with the same keys, where one is within max_km; of equals the least.

    rows: id, keys, lat, lon; sites: match_id, keys, r_lat, r_lon. Rows meet sites on cells as high as a radius, which
    starts where a cell holds few sites and is four times as long in each step, up to max_km. A row that finds a site
    within the radius is done, so that dense places cost no more. Sites at one place are one. Cells widen towards the poles.
    """
    c = F.col
    sites = scratch.written(sites.where("r_lat is not null and r_lon is not null").groupBy(*keys, "r_lat", "r_lon").agg(F.min("match_id").alias("match_id")))
    rest = scratch.written(scratch.spread(rows.where("lat is not null and lon is not null").select("id", *keys, "lat", "lon"), "id"))
    round_ = lambda lon: F.pmod(lon + 180, F.lit(360.0))
    far = max_km / (2 * 3.14159265 * geo.EARTH_KM / 360) * 1.001

    def wide(high: float) -> Column:
        edge = F.least(F.greatest(F.abs(c("gy")), F.abs(c("gy") + 1)) * high, F.lit(90.0))
        return F.least(high / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6)), F.lit(360.0))

    def celled(high: float) -> DataFrame:
        return sites.withColumn("gy", F.floor(c("r_lat") / high)).withColumn("gx", F.floor(round_(c("r_lon")) / wide(high)))

    step = 0
    while step < steps:
        most = celled(far / 4**step).groupBy(*keys, "gy", "gx").count().agg(F.max("count")).first()[0]
        if (most or 0) <= few:
            break
        step += 1
    out = None
    for k in range(step, -1, -1):
        high = far / 4**k
        reach = F.least(high / F.greatest(F.cos(F.radians(F.least(F.abs(c("lat")) + high, F.lit(90.0)))), F.lit(1e-6)), F.lit(180.0))
        looked = rest.withColumn("gy", F.explode(F.sequence(F.floor((c("lat") - high) / high), F.floor((c("lat") + high) / high)))).withColumn("reach", reach).withColumn("x", round_(c("lon")))
        turns = F.array_compact(F.array(c("x"), F.when(c("x") < c("reach"), c("x") + 360), F.when(c("x") + c("reach") >= 360, c("x") - 360)))
        looked = looked.withColumn("x", F.explode(turns)).withColumn("gx", F.explode(F.sequence(F.floor((c("x") - c("reach")) / wide(high)), F.floor((c("x") + c("reach")) / wide(high)))))
        met = looked.join(scratch.merged(celled(high)), [*keys, "gy", "gx"]).withColumn("km", geo.haversine_km(c("lat"), c("lon"), c("r_lat"), c("r_lon"))).where(c("km") <= max_km / 4**k)
        found = scratch.written(met.groupBy("id").agg(F.min(F.struct("km", "match_id")).alias("b")))
        out = found if out is None else out.unionByName(found)
        if k:
            rest = scratch.written(rest.join(scratch.merged(found), "id", "left_anti"))
    return out.groupBy("id").agg(F.min("b").alias("b")).select("id", c("b.match_id").alias("match_id"), c("b.km").alias("km"))


def near_in_scope(left: DataFrame, right: DataFrame, scope: str, max_km: float, name_gate: float) -> DataFrame:
    """The nearest record in scope within max_km whose name passes the gate. Names are compared once per scope and pair of texts, records meet on cells."""
    left, right = (scratch.written(df.where("name is not null").select(scope, "id", "name", "lat", "lon")) for df in (left, right))
    own, other = (df.select(scope, F.col("name").alias("text")).distinct() for df in (left, right))
    if name_gate > 0:  # empty names are alike, and like no others
        named = similar_pairs(own, other, [scope], name_gate).select(scope, "text", "match_text")
        if name_gate <= 1:
            named = named.unionByName(own.where("text = ''").withColumn("match_text", F.lit("")))
    else:
        named = own.join(other.withColumnRenamed("text", "match_text"), scope)
    rows = left.join(scratch.written(named.withColumnRenamed("text", "name")), [scope, "name"]).select("id", scope, "match_text", "lat", "lon")
    sites = right.select(F.col("id").alias("match_id"), scope, F.col("name").alias("match_text"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return nearest_by_cells(rows, sites, [scope, "match_text"], max_km)


def link(left: DataFrame, right: DataFrame, thresholds: tuple[float, float] = (0.80, 0.92), skip: Column | None = None) -> DataFrame:
    """Tiers: same reference number; similar name at the same postcode; similar name in the same area; a name that occurs once.

    Columns of both: id, urn, name (normalised), postcode, area. Returns one row per
    record of left: id, match_id, method, confidence. A later tier is computed only
    for records that earlier tiers left unmatched, whose matches are written.
    """
    methods = ("urn_exact", "postcode_name", "area_name", "unique_name")
    left, right = scratch.written(left), scratch.written(right)  # each is read for every tier
    rest = left if skip is None else left.where(~skip)
    found = rest.where("urn is not null").join(right.where("urn is not null").groupBy("urn").agg(F.min("id").alias("match_id")), "urn").select("id", "match_id", F.lit(0).alias("tier"), F.lit(1.0).alias("ratio"))
    for tier, (block, threshold) in enumerate(((["postcode"], thresholds[0]), (["area"], thresholds[1])), 1):
        rest = rest.join(found.select("id"), "id", "left_anti")
        named = lambda df: df.select("id", *block, F.col("name").alias("text"))
        found = scratch.written(found.unionByName(best_similar(named(rest), named(right), block, threshold).withColumn("tier", F.lit(tier))))
    rest = rest.join(found.select("id"), "id", "left_anti")
    once = unique_names(right).select("name", F.col("id").alias("match_id"))
    found = found.unionByName(rest.join(once, "name").select("id", "match_id", F.lit(3).alias("tier"), F.lit(1.0).alias("ratio")))
    method = F.when(F.col("tier").isNotNull(), F.get(F.array(*map(F.lit, methods)), F.col("tier")))
    joined = left.select("id").join(found, "id", "left")
    return joined.select("id", "match_id", F.coalesce(method, F.lit("unmatched")).alias("method"), F.round("ratio", 4).alias("confidence"))


def match_schools(left: DataFrame, right: DataFrame, gate: float = 0.75) -> DataFrame:
    """(id, match_id, method, confidence) by five passes, the first that finds one wins; null where none does.

    Columns of both: id, name, core (the name's core), postcode. Passes: name and
    postcode; name; core, unless both postcodes are known and differ; the most
    similar core at the postcode from the gate on; the only record at the postcode.
    Of equals the least id. Each side of a join has one row per key but in the
    fourth pass, which compares cores at one postcode for records still unmatched;
    records without a postcode take no part in it.
    """
    c = F.col
    least = lambda df, *keys: df.groupBy(*keys).agg(F.min("id").alias("match_id"))
    known, placed = right.where("postcode is not null"), left.where("postcode is not null")
    found = lambda df, tier, ratio: df.select("id", "match_id", F.lit(tier).alias("tier"), F.lit(ratio).alias("ratio"))
    exact = found(placed.join(least(known, "name", "postcode"), ["name", "postcode"]), 0, 1.0).unionByName(found(left.join(least(right, "name"), "name"), 1, 0.95))
    cores = placed.join(least(known, "core", "postcode"), ["core", "postcode"]).select("id", "match_id")
    cores = cores.union(placed.join(least(right.where("postcode is null"), "core"), "core").select("id", "match_id"))
    cores = cores.union(left.where("postcode is null").join(least(right, "core"), "core").select("id", "match_id"))
    sure = scratch.written(exact.unionByName(found(cores, 2, 0.92)))
    rest = placed.join(sure.select("id").distinct(), "id", "left_anti")
    named = lambda df: df.select("id", "postcode", c("core").alias("text"))
    near = best_similar(named(rest), named(known), ["postcode"], gate).withColumn("tier", F.lit(3))
    sole = known.groupBy("postcode").agg(F.count("*").alias("n"), F.min("id").alias("match_id")).where("n = 1")
    best = best_match(sure.unionByName(near.select(*sure.columns)).unionByName(found(rest.join(sole, "postcode"), 4, 0.85)))
    methods = F.array(*map(F.lit, ("exact_name_postcode", "exact_name", "core_name_postcode", "core_similarity", "sole_postcode_match")))
    return left.select("id").join(best, "id", "left").select("id", "match_id", F.get(methods, c("tier")).alias("method"), F.round("ratio", 3).alias("confidence"))
