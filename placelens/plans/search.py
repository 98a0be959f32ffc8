"""Spatial search and its client side over provider-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.functions import geo
from placelens.operators import indexed, scratch, spatial
from placelens.plans.base import PROVIDERS_SQL, VIEWPORTS_SQL, providers, viewports
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians({y} - q_lat) / 2), 2) + cos(radians(q_lat)) * cos(radians({y})) * pow(sin(radians({x} - q_lon) / 2), 2))))"
_FAR = "greatest(" + ", ".join(_KM.format(y=y, x=x) for y in ("{0}south", "{0}north") for x in ("{0}west", "{0}east")) + ")"
_DISTANCE = f"CASE WHEN bbox_south IS NOT NULL THEN {_FAR.replace('{0}', 'bbox_')} ELSE {_KM.format(y='lat', x='lon')} END"
_HITS = """SELECT *, row_number() OVER (PARTITION BY query_id, is_box ORDER BY km, provider_id) AS rank, count(*) OVER (PARTITION BY query_id, is_box) > {limit} AS more FROM (
  SELECT query_id, provider_id, q_lat, q_lon, south, west, north, east, bbox_south IS NOT NULL AS is_box, {km} AS km FROM p JOIN q
  ON coalesce(bbox_south, lat) <= {n} AND coalesce(bbox_north, lat) >= {s} AND coalesce(bbox_west, lon) <= {e} AND coalesce(bbox_east, lon) >= {w})"""
_SEARCH = f"""WITH p AS ({PROVIDERS_SQL}), q AS ({VIEWPORTS_SQL}),
wide AS (SELECT * FROM ({_HITS.format(limit="{limit}", km=_DISTANCE, s="south - (north - south) / 2", n="north + (north - south) / 2", w="west - (east - west) / 2", e="east + (east - west) / 2")}) WHERE rank <= {{limit}}),
exact AS (SELECT * FROM ({_HITS.format(limit="{limit}", km=_DISTANCE, s="south", n="north", w="west", e="east")}) WHERE rank <= {{limit}}),
short AS (SELECT query_id FROM (SELECT query_id, max(km) FILTER (WHERE more AND NOT is_box) AS radius, any_value({_FAR.replace("{0}", "")}) AS corner FROM wide GROUP BY 1) WHERE corner > radius),
found AS (SELECT query_id, provider_id, is_box, km, 'inflated' AS mode FROM wide WHERE query_id NOT IN (SELECT query_id FROM short)
 UNION ALL SELECT query_id, provider_id, is_box, km, 'exact' FROM exact WHERE query_id IN (SELECT query_id FROM short))
"""


@query(_SEARCH.format(limit=20) + "SELECT query_id, provider_id, is_box, round(km, 3) AS km, mode FROM found")
def spatial_search(spark, d):
    return spatial.spatial_search(providers(spark, d), viewports(spark, d), limit=20).withColumn("km", F.round("km", 3))


_VALUE = {
    "distance": ("km", ""), "lowest_cost": ("least(sort_cost_under2, sort_cost_age3to4)", ""), "lowest_turnover": ("turnover", ""), "most_graduate": ("graduates", "DESC"),
    "longest_daily": ("daily_close - daily_open", "DESC"), "longest_annual": ("CAST(annual_opening AS DOUBLE)", "DESC"), "best_ofsted": ("inspection", "DESC"),
}
_ELIGIBLE = "(SELECT bool_or(a BETWEEN coalesce(min_months, min_years * 12, 0) AND coalesce((max_years + 1) * 12 - 1, 999)) FROM unnest([14, 40]) t(a))"


def _ranked(mode: str):
    value, way = _VALUE[mode]
    sql = _SEARCH.format(limit=500) + f"""SELECT query_id, provider_id, round(v, 4) AS sort_value, row_number() OVER (PARTITION BY query_id ORDER BY v {way} NULLS LAST, km, provider_id) AS place FROM (
  SELECT query_id, provider_id, km, CASE WHEN v = -1 THEN NULL ELSE v END AS v FROM (SELECT query_id, p.provider_id, km, {value} AS v FROM found JOIN p ON found.provider_id = p.provider_id WHERE {_ELIGIBLE}))"""

    def run(spark, d):
        from pyspark.sql import Window

        own = providers(spark, d)
        found = spatial.spatial_search(own, viewports(spark, d))
        ranked = spatial.filter_sort_dedupe(found.join(own.drop("lat", "lon"), "provider_id"), mode, [14, 40], keys=("query_id", "provider_id"))
        order = F.col("sort_value").asc_nulls_last() if spatial.sort_value(mode, [])[1] else F.col("sort_value").desc_nulls_last()
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "km", "provider_id"))
        return ranked.select("query_id", "provider_id", F.round("sort_value", 4).alias("sort_value"), place.cast("long").alias("place"))

    run.__name__ = "spatial_search_ranked" if mode == "distance" else f"ranked_by_{mode}"
    query(sql)(run)


for _mode in _VALUE:
    _ranked(_mode)


@query(f"WITH p AS ({PROVIDERS_SQL}) SELECT provider_id FROM p WHERE coalesce(bbox_south, lat) <= 52.5 AND coalesce(bbox_north, lat) >= 51 AND coalesce(bbox_west, lon) <= -1 AND coalesce(bbox_east, lon) >= -3")
def viewport_filter(spark, d):
    return providers(spark, d).where(spatial.in_viewport((51.0, -3.0, 52.5, -1.0))).select("provider_id")


@query(f"""WITH p AS ({PROVIDERS_SQL}), k AS (SELECT *, {_DISTANCE} AS km FROM (SELECT * REPLACE (CASE WHEN lat < 53 AND lon < 0 THEN lat END AS lat), 52.0 AS q_lat, -2.0 AS q_lon FROM p) WHERE lat IS NOT NULL OR bbox_south IS NOT NULL), m AS (SELECT *, max(CASE WHEN bbox_south IS NULL THEN km END) OVER () AS far FROM k)
SELECT provider_id, bbox_south IS NOT NULL AS is_box FROM m WHERE bbox_south IS NULL OR km <= far OR bbox_south >= 51 AND bbox_west >= -3 AND bbox_north <= 54.9 AND bbox_east <= 1""")
def box_cap(spark, d):
    """Points north or east of the map have no place here, which leaves boxes that are farther than any point."""
    known = (F.col("lat") < 53) & (F.col("lon") < 0)
    own = providers(spark, d).withColumns({"lat": F.when(known, F.col("lat")), "lon": F.when(known, F.col("lon"))})
    rows = own.where("lat is not null or bbox_south is not null").withColumn("km", spatial.distance_km((F.lit(52.0), F.lit(-2.0))))
    return spatial.cap_boxes(rows, (51.0, -3.0, 54.9, 1.0)).select("provider_id", F.col("bbox_south").isNotNull().alias("is_box"))


@query(f"""WITH p AS ({PROVIDERS_SQL}), q AS ({VIEWPORTS_SQL}), a AS (SELECT q_lat AS lat, q_lon AS lon, query_id AS id FROM q), b AS (SELECT provider_id AS place_id, lat AS p_lat, lon AS p_lon FROM p WHERE lat IS NOT NULL)
SELECT id, place_id, rank, round(degrees, 6) AS degrees FROM (SELECT id, place_id, sqrt(pow(lat - p_lat, 2) + pow(lon - p_lon, 2)) AS degrees, row_number() OVER (PARTITION BY id ORDER BY sqrt(pow(lat - p_lat, 2) + pow(lon - p_lon, 2)), place_id) AS rank FROM a, b) WHERE rank <= 3""")
def three_nearest(spark, d):
    places = providers(spark, d).where("lat is not null").select(F.col("provider_id").alias("place_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    points = viewports(spark, d).select(F.col("query_id").alias("id"), F.col("q_lat").alias("lat"), F.col("q_lon").alias("lon"))
    return spatial.nearest(points, places, 3).withColumn("degrees", F.round("degrees", 6))


@query(f"""WITH q AS ({VIEWPORTS_SQL}), x AS (SELECT *, query_id % 4 <> 3 AS cached, query_id % 5 <> 0 AS same, query_id % 2 = 0 AS inflated, query_id % 3 = 0 AS hit, 40.0 AS radius, south + (query_id % 7) * 0.05 AS ns, north + (query_id % 7) * 0.05 AS nn FROM q)
SELECT query_id, CASE WHEN NOT cached OR NOT same THEN true WHEN NOT inflated THEN ns <> south OR nn <> north
 ELSE NOT (ns >= south - (north - south) / 2 AND nn <= north + (north - south) / 2) OR hit AND {_FAR.replace("{0}", "").replace("south", "ns").replace("north", "nn")} > radius END AS requery FROM x""")
def requery_decision(spark, d):
    q, k = viewports(spark, d), F.col("query_id")
    old = q.select("query_id", *(F.col(c).alias(f"old_{c}") for c in ("south", "west", "north", "east")))
    x = q.join(old, "query_id").withColumns({"cached": k % 4 != 3, "same_postcode": k % 5 != 0, "inflated": k % 2 == 0, "hit_limit": k % 3 == 0, "radius": F.lit(40.0), "mask": F.lit(0), "new_mask": F.lit(0), "south": F.col("south") + (k % 7) * 0.05, "north": F.col("north") + (k % 7) * 0.05})
    return spatial.needs_requery(x)


@query(f"WITH p AS ({PROVIDERS_SQL}) SELECT provider_id, care_type FROM p WHERE (1 << care_type) & 37 <> 0")
def care_type_mask(spark, d):
    return providers(spark, d).where(spatial.matches_mask(37)).select("provider_id", "care_type")


@query(f"WITH q AS ({VIEWPORTS_SQL}) SELECT query_id, round((south + north) / 2, 6) AS lat, round((west + east) / 2, 6) AS lon, round(south - (north - south) / 2, 6) AS s, round(east + (east - west) / 2, 6) AS e, round({_FAR.replace('{0}', '')}, 3) AS far FROM q")
def box_geometry(spark, d):
    box = tuple(F.col(c) for c in ("south", "west", "north", "east"))
    lat, lon = geo.centre(box)
    wide = geo.inflate(*box)
    return viewports(spark, d).select("query_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"), F.round(wide[0], 6).alias("s"), F.round(wide[3], 6).alias("e"), F.round(geo.farthest_corner_km(F.col("q_lat"), F.col("q_lon"), box), 3).alias("far"))


_BOX = (51.0, -3.5, 51.4, -3.0)


@query(f"""WITH p AS ({PROVIDERS_SQL}) SELECT provider_id, CAST(coalesce(min_months, -1) AS INT) AS min_months, round(coalesce(bbox_south, lat), 6) AS south, round(coalesce(bbox_east, lon), 6) AS east FROM p
WHERE coalesce(bbox_south, lat) <= {_BOX[2]} AND coalesce(bbox_north, lat) >= {_BOX[0]} AND coalesce(bbox_west, lon) <= {_BOX[3]} AND coalesce(bbox_east, lon) >= {_BOX[1]}""")
def indexed_viewport(spark, d):
    """Providers laid out along a curve in 16 files, of which the viewport reads those whose boxes it meets."""
    where = scratch.shared_path(spark, "index")
    indexed.write_index(providers(spark, d), where, 16)
    return indexed.read_viewport(spark, where, _BOX).select("provider_id", "min_months", F.round("south", 6).alias("south"), F.round("east", 6).alias("east"))


@query(f"""WITH p AS ({PROVIDERS_SQL}), q AS ({VIEWPORTS_SQL}) SELECT query_id, provider_id FROM p JOIN q ON coalesce(bbox_south, lat) <= north AND coalesce(bbox_north, lat) >= south AND coalesce(bbox_west, lon) <= east AND coalesce(bbox_east, lon) >= west""")
def indexed_viewports(spark, d):
    where = scratch.shared_path(spark, "index")
    indexed.write_index(providers(spark, d), where, 16)
    return indexed.read_viewports(spark, where, viewports(spark, d)).select("query_id", "provider_id")
