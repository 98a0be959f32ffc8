"""Resolving records against look-ups, areas and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(df: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """df with `value` and value_source: the first step's table (name, table, keys) that has the row's keys and a value.

    Tables are left-joined one after the other on their own keys; of equal keys in a table the least value counts.
    """
    out, found = df, []
    for k, (name, table, keys) in enumerate(steps):
        one = table.groupBy(*keys).agg(F.min(value).alias(f"_v{k}"))
        out = out.join(one, keys, "left")
        found.append(F.when(F.col(f"_v{k}").isNotNull(), F.struct(F.col(f"_v{k}").alias("v"), F.lit(name).alias("s"))))
    best = F.coalesce(*found)
    return out.withColumn(value, best["v"]).withColumn(f"{value}_source", best["s"]).drop(*(f"_v{k}" for k in range(len(steps))))


def remapped(rows: DataFrame, old: DataFrame, new: DataFrame, key: str, natural: list[str]) -> DataFrame:
    """rows with their surrogate key of table old replaced by that of table new, through the natural keys."""
    pairs = old.select(key, *natural).join(new.select(F.col(key).alias("_new"), *natural), natural).select(key, "_new")
    return rows.join(pairs, key).withColumn(key, F.col("_new")).drop("_new")


def onto_all(every: DataFrame, rows: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """A row for every key, with fill where rows has none."""
    return every.join(rows, keys, "left").fillna(fill)


def two_level_match(left: DataFrame, right: DataFrame, exact: str, block: str, similarity: Column, least: float) -> DataFrame:
    """(id, match_id, level) by an equal `exact` first, else within a block by similarity of at least `least`; the greatest, then the least id wins.

    Columns: left id, name and the keys; right match_id, match_name and the keys.
    """
    one = left.join(right, exact).groupBy("id").agg(F.min("match_id").alias("match_id")).select("id", "match_id", F.lit(1).alias("level"))
    rest = left.join(one.select("id"), "id", "left_anti")
    pairs = rest.drop(exact).join(right.drop(exact), block).withColumn("_s", similarity).where(F.col("_s") >= least)
    two = pairs.groupBy("id").agg(F.min_by("match_id", F.struct((-F.col("_s")).alias("s"), "match_id")).alias("match_id")).select("id", "match_id", F.lit(2).alias("level"))
    return one.unionByName(two)


def later_non_null(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per key the last non-null value of each column in the order given."""
    return df.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def fee(own: Column, fallback: Column, area: Column) -> Column:
    """struct(amount, source): the provider's fee, its fallback band's, the area's average, else zero."""
    options = [("provider", own), ("provider_band", fallback), ("area", area)]
    return F.coalesce(*(F.when(c.isNotNull(), F.struct(c.cast("double").alias("amount"), F.lit(s).alias("source"))) for s, c in options), F.struct(F.lit(0.0).alias("amount"), F.lit("none").alias("source")))


def inspection_framework(report_card: Column, grade: Column, early_years: Column, ungraded: Column) -> Column:
    """Which framework an inspection follows: report card, graded, early years, ungraded outcome, else transition where there was any inspection."""
    return F.when(report_card.isNotNull(), "report_card").when(grade.isNotNull(), "legacy").when(early_years.isNotNull(), "early_years").when(ungraded.isNotNull(), "ungraded").otherwise("legacy_transition")


def box_tier(places: DataFrame, boxes: DataFrame, names: DataFrame) -> DataFrame:
    """places with geo_type, geo_code and status of the first box that stands in for a missing point, null where none does.

    places: id, postcode, area (code), area_name; boxes: geo_type, geo_code; names: name, geo_type, geo_code. In turn: the
    postcode; its district, or the postcode itself taken as one; the area's code; its name, of a county or an authority.
    """
    from placelens.functions.text import outward_code

    c = F.col
    trimmed = lambda x: F.when(F.trim(c(x)) != "", F.trim(c(x)))
    code = F.upper(trimmed("postcode"))
    steps = [("postcode", code, "bbox_postcode"), ("postcode_district", F.nullif(outward_code(code), F.lit("")), "bbox_postcode_district"), ("postcode_district", code, "bbox_postcode_district"), ("local_authority", trimmed("area"), "bbox_local_authority")]
    options = F.array_compact(F.array(*(F.when(x.isNotNull(), F.struct(F.lit(k).alias("step"), F.lit(t).alias("geo_type"), x.alias("geo_code"), F.lit(s).alias("status"))) for k, (t, x, s) in enumerate(steps))))
    tried = places.select("id", F.explode(options).alias("o")).select("id", "o.*").join(boxes.select("geo_type", "geo_code").distinct(), ["geo_type", "geo_code"])
    status = F.when(c("geo_type") == "county", "bbox_county").otherwise("bbox_local_authority")
    by_name = places.select("id", trimmed("area_name").alias("name")).join(names.groupBy("name").agg(F.min(F.struct("geo_type", "geo_code")).alias("g")), "name")
    by_name = by_name.select("id", F.lit(len(steps)).alias("step"), "g.geo_type", "g.geo_code").withColumn("status", status)
    best = tried.select("id", "step", "geo_type", "geo_code", "status").unionByName(by_name).groupBy("id").agg(F.min(F.struct("step", "geo_type", "geo_code", "status")).alias("b"))
    return places.join(best, "id", "left").select(*places.columns, "b.geo_type", "b.geo_code", "b.status")
