"""Map-viewport search with a completeness guarantee, ranking, caps and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import relational, scratch

BOX = ("bbox_south", "bbox_west", "bbox_north", "bbox_east")


def distance_km(q: tuple[Column, Column]) -> Column:
    """To a point, or to the farthest corner of a box."""
    box = tuple(F.col(c) for c in BOX)
    return F.when(F.col("bbox_south").isNotNull(), geo.farthest_corner_km(*q, box)).otherwise(geo.haversine_km(*q, F.col("lat"), F.col("lon")))


def extent() -> tuple[Column, ...]:
    """A provider's box; a point is a box of no size."""
    return tuple(F.coalesce(F.col(b), F.col(p)) for b, p in zip(BOX, ("lat", "lon", "lat", "lon"), strict=True))


def matches_mask(mask: int, column: str = "care_type") -> Column:
    """Any of the mask's bits; 0 stands for all."""
    return F.lit(True) if mask == 0 else F.expr(f"(shiftleft(1, {column}) & {int(mask)}) <> 0")


#: Cells of level k are CELL * 4^k degrees wide; the last level's cover the globe.
CELL, LEVELS = 0.25, 7


def _cells(df: DataFrame, rect: tuple, every_level: bool) -> DataFrame:
    """df with a row for each grid cell (level, gy, gx) that its rectangle meets.

    A provider lies on the level whose cells are as wide as its longer side, so
    it is in four cells at most; a viewport looks up every level.
    """
    south, west, north, east = rect
    if every_level:
        levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))
    else:
        side = F.greatest(north - south, east - west, F.lit(CELL))
        levels = F.least(F.ceil(F.log(4.0, side / CELL) - 1e-9), F.lit(LEVELS)).cast("int")
    out = df.withColumn("_level", levels).withColumn("_size", CELL * F.pow(F.lit(4.0), F.col("_level")))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / F.col("_size")), F.floor(hi / F.col("_size"))))
    return out.withColumn("_gy", span(south, north)).withColumn("_gx", span(west, east)).drop("_size")


def _hits(providers: DataFrame, queries: DataFrame, rect: tuple, limit: int) -> DataFrame:
    """Both populations of each query, nearest first, cut at limit, with whether they had more. An equi-join on grid cells."""
    looked = _cells(queries, rect, every_level=True)
    joined = _cells(providers, extent(), every_level=False).join(looked, ["_level", "_gy", "_gx"]).where(geo.overlaps(extent(), rect))
    one = joined.dropDuplicates(["query_id", "provider_id"])  # hits only are shuffled, not all providers
    located = one.withColumn("is_box", F.col("bbox_south").isNotNull()).withColumn("km", distance_km((F.col("q_lat"), F.col("q_lon"))))
    return relational.top_k(located, ["query_id", "is_box"], [F.col("km"), F.col("provider_id")], limit).withColumnRenamed("overflow", "more")


def spatial_search(providers: DataFrame, queries: DataFrame, limit: int = 500, inflation: float = 1.0, mask: int = 0) -> DataFrame:
    """Providers for each viewport: query_id, provider_id, is_box, km, mode.

    providers: provider_id, care_type, lat, lon, bbox_*; queries: query_id, q_lat, q_lon, south, west, north, east.
    The inflated viewport is searched first. If the points overflow and a corner
    of the viewport is farther than the last point that is left, the answer would
    have holes, and the exact viewport is searched instead. Both sides meet on
    grid cells, so neither has to be small.
    """
    own = providers.where(matches_mask(mask)).where("lat is not null or bbox_south is not null").select("provider_id", "lat", "lon", *BOX)
    view = tuple(F.col(c) for c in ("south", "west", "north", "east"))
    wide = scratch.written(_hits(own, queries, geo.inflate(*view, inflation), limit).select("query_id", "provider_id", "is_box", "km", "more"))
    last = wide.where("not is_box and more").groupBy("query_id").agg(F.max("km").alias("radius"))
    short = queries.join(last, "query_id").where(~geo.box_within_circle(F.col("q_lat"), F.col("q_lon"), F.col("radius"), view)).select("query_id")
    exact = _hits(own, queries.join(short, "query_id", "left_semi"), view, limit).withColumn("mode", F.lit("exact"))
    kept = wide.join(short, "query_id", "left_anti").withColumn("mode", F.lit("inflated"))
    columns = ["query_id", "provider_id", "is_box", "km", "mode"]
    return kept.select(*columns).unionByName(exact.select(*columns))


def cost_column(ages_months: list[int]) -> Column:
    """The hourly cost that counts for children of these ages: the least of their bands, all without children."""
    bands = {"sort_cost_under2": lambda a: a < 24, "sort_cost_age2": lambda a: 24 <= a < 36, "sort_cost_age3to4": lambda a: 36 <= a < 60, "sort_cost_age5plus": lambda a: a >= 60}
    used = [c for c, test in bands.items() if any(test(a) for a in ages_months)]
    columns = [F.col(c) for c in used] or [F.col("sort_cost_all")]
    return F.least(*columns) if len(columns) > 1 else columns[0]


def age_eligible(ages_months: list[int]) -> Column:
    """Some child is within the row's limits; without children all are."""
    low = F.coalesce(F.col("min_months"), F.col("min_years") * 12, F.lit(0))
    high = F.coalesce((F.col("max_years") + 1) * 12 - 1, F.lit(999))
    return F.exists(F.array(*map(F.lit, ages_months)), lambda a: a.between(low, high)) if ages_months else F.lit(True)


def sort_value(mode: str, ages_months: list[int]) -> tuple[Column, bool]:
    """The column of one of the seven sort modes, and whether it ascends."""
    return {
        "distance": (F.col("km"), True),
        "lowest_cost": (cost_column(ages_months), True),
        "lowest_turnover": (F.col("turnover"), True),
        "most_graduate": (F.col("graduates"), False),
        "longest_daily": (F.col("daily_close") - F.col("daily_open"), False),
        "longest_annual": (F.col("annual_opening"), False),
        "best_ofsted": (F.col("inspection"), False),
    }[mode]


def filter_sort_dedupe(rows: DataFrame, mode: str, ages_months: list[int], funded_only: bool = False, keys: tuple[str, ...] = ("provider_id",)) -> DataFrame:
    """One row per provider (and viewport, if keys name it): the best eligible row by the mode, missing values (null, NaN, -1) last, then nearest."""
    value, ascending = sort_value(mode, ages_months)
    value = F.when(F.isnan(value.cast("double")) | (value == -1), None).otherwise(value)
    own = rows.where(age_eligible(ages_months)).where(F.col("funded") if funded_only else F.lit(True)).withColumn("sort_value", value.cast("double"))
    order = [F.col("sort_value").asc_nulls_last() if ascending else F.col("sort_value").desc_nulls_last(), F.col("km"), F.col("provider_id"), F.col("care_type")]
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return first.withColumn("miles", F.coalesce(geo.miles(F.col("km")), F.lit(0.0))).orderBy(*keys[:-1], *order)


def in_viewport(view: tuple[float, float, float, float]) -> Column:
    """A box that meets the viewport or a point inside it; unlocated rows are out."""
    return F.coalesce(geo.overlaps(extent(), tuple(map(F.lit, view))), F.lit(False))


def cap_boxes(rows: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    """Boxes beyond the farthest point go unless they lie whole in the viewport; without points all boxes go."""
    far = rows.agg(F.max(F.when(F.col("bbox_south").isNull(), F.col("km"))).alias("_far"))
    inside = (F.col("bbox_south") >= view[0]) & (F.col("bbox_west") >= view[1]) & (F.col("bbox_north") <= view[2]) & (F.col("bbox_east") <= view[3])
    return rows.crossJoin(F.broadcast(far)).where(F.col("bbox_south").isNull() | F.col("_far").isNotNull() & ((F.col("km") <= F.col("_far")) | inside)).drop("_far")


def needs_requery(queries: DataFrame) -> DataFrame:
    """For (query_id, cached answer, new viewport): whether the cached answer may lack providers.

    Columns: cached (boolean), mask, new_mask, same_postcode, inflated, hit_limit, radius, q_lat, q_lon, old_* and new viewport.
    """
    new = tuple(F.col(c) for c in ("south", "west", "north", "east"))
    old = tuple(F.col(f"old_{c}") for c in ("south", "west", "north", "east"))
    wide = geo.inflate(*old)
    moved = F.lit(False)
    for a, b in zip(new, old, strict=True):
        moved = moved | (a != b)
    within = (new[0] >= wide[0]) & (new[1] >= wide[1]) & (new[2] <= wide[2]) & (new[3] <= wide[3])
    holes = F.col("hit_limit") & ~geo.box_within_circle(F.col("q_lat"), F.col("q_lon"), F.col("radius"), new)
    return queries.select("query_id", F.when(~F.col("cached") | (F.col("mask") != F.col("new_mask")) | ~F.col("same_postcode"), True).when(~F.col("inflated"), moved).otherwise(~within | holes).alias("requery"))


def nearest(points: DataFrame, places: DataFrame, k: int = 1, cell: float = 0.25, rings: int = 2, scope: str | None = None) -> DataFrame:
    """The k nearest places of each point by degrees: id, place_id, rank, degrees.

    Points meet the places of their grid cell and the cells within `rings` of
    it. A point that has k places within rings * cell degrees is served; the
    others search a grid of cells four times as wide, until each is served or
    the grid covers the globe, so no place is too far. Equi-joins throughout.
    """
    on, out, rest = ["gy", "gx", *([scope] if scope else [])], None, points
    while True:
        grid = lambda c, size=cell: F.floor(F.col(c) / size)
        around = lambda c: F.explode(F.sequence(grid(c) - rings, grid(c) + rings))  # noqa: E731, B023
        near = rest.withColumn("gy", around("lat")).withColumn("gx", around("lon"))
        joined = near.join(places.withColumn("gy", grid("p_lat")).withColumn("gx", grid("p_lon")), on)
        degrees = F.sqrt(F.pow(F.col("lat") - F.col("p_lat"), 2) + F.pow(F.col("lon") - F.col("p_lon"), 2))
        last = cell * rings >= 720
        ranked = joined.withColumn("degrees", degrees).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("degrees", "place_id"))).where(F.col("rank") <= k)
        if not last:
            ranked = ranked.where(F.col("degrees") <= cell * rings)
        found = scratch.written(ranked.select("id", "place_id", F.col("rank").cast("long").alias("rank"), "degrees"))
        served = found if last else found.join(found.where(F.col("rank") == k).select("id"), "id", "left_semi")
        out = served if out is None else out.union(served)
        if last:
            return out
        rest = scratch.written(rest.join(found.where(F.col("rank") == k).select("id"), "id", "left_anti"))
        if not rest.take(1):
            return out
        cell *= 4
