"""Decision operators: which of several sources, places, classes or ages holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.functions import geo


def arbitrate_geocode(lat: Column, lon: Column, post_lat: Column, post_lon: Column, failed: Column, max_km: float = 5.0) -> Column:
    """struct(lat, lon, status): the query's place unless it is too far from its postcode's centre."""
    place = lambda y, x, s: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"), F.lit(s).alias("status"))
    found, posted = lat.isNotNull() & lon.isNotNull(), post_lat.isNotNull() & post_lon.isNotNull()
    far = geo.haversine_km(lat, lon, post_lat, post_lon) > max_km
    none = F.lit(None)
    return F.when(found & posted & far, place(post_lat, post_lon, "success_postcode_override")).when(found, place(lat, lon, "success")).when(posted, place(post_lat, post_lon, "success_postcode_fallback")).when(failed, place(none, none, "api_error")).otherwise(place(none, none, "no_results"))


def repair_ages(min_months: Column, min_years: Column, max_years: Column) -> tuple[Column, Column]:
    """An upper end without a lower one starts at 0; a lower end without an upper one is cleared."""
    fill = max_years.isNotNull() & min_months.isNull() & min_years.isNull()
    return F.when(max_years.isNull(), None).when(fill, 0).otherwise(min_months), F.when(max_years.isNotNull(), min_years)


def layered(base: Column, *layers: tuple[str, Column]) -> Column:
    """struct(value, source, conflicts): later layers overwrite where they have a value; other values that gave way are kept."""
    value, source = base, F.when(base.isNotNull(), "base")
    conflicts = F.array().cast("array<string>")
    for name, layer in layers:
        clash = value.isNotNull() & layer.isNotNull() & (value != layer)
        conflicts = F.when(clash, F.array_append(conflicts, F.concat_ws(":", source, value.cast("string")))).otherwise(conflicts)
        value, source = F.coalesce(layer, value), F.when(layer.isNotNull(), name).otherwise(source)
    return F.struct(value.alias("value"), source.alias("source"), conflicts.alias("conflicts"))


def mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def by_name(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """The class of the first pattern that fits."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(patterns):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def institution_type(phase: Column, school_phase: Column, registration: Column, name: Column, care_type: Column, has_school: Column, tables: dict[str, dict[str, str]], patterns: list[tuple[str, str]]) -> Column:
    """School phase, then school register, registration, the name of those without a school, and care type; else unknown."""
    return F.coalesce(F.when(has_school, F.coalesce(mapped(phase, tables["phase"]), mapped(school_phase, tables["school"]))), mapped(registration, tables["registration"]), F.when(~has_school, by_name(name, patterns)), mapped(care_type, tables["care"]), F.lit("unknown"))


def source_tier(sources: Column) -> Column:
    la, ofsted, school = (F.array_contains(sources, s) for s in ("la_scrape", "ofsted", "school_census"))
    return F.when(la & ofsted & school, "LA + Ofsted + School").when(la & ofsted, "LA + Ofsted").when(la, "LA only").when(ofsted & school, "Ofsted + School").when(ofsted, "Ofsted only").otherwise("Other")


def inspection_code(framework: Column, rating: Column, ranks: list[Column], flags: list[Column]) -> Column:
    """L:rating, T, or R: with sorted ranks and Y, N or - for each flag."""
    digits = F.array_join(F.transform(F.array_sort(F.filter(F.array(*ranks), lambda x: x.isNotNull())), lambda x: x.cast("string")), "")
    marks = F.concat(*(F.when(f, "Y").when(~f, "N").otherwise("-") for f in flags))
    return F.when((framework == "legacy") & rating.isNotNull(), F.concat(F.lit("L:"), rating)).when(framework == "legacy_transition", "T").when((framework == "report_card") & (digits != ""), F.concat(F.lit("R:"), digits, marks))


def reassign_and_dedupe(df: DataFrame, key: str, kind: str, from_kind: str, to_kind: str, condition: Column, tie: str) -> DataFrame:
    """from_kind becomes to_kind where the condition holds; of a key's rows of one kind the reassigned one stays, else the first."""
    moved = df.withColumn("_moved", condition & (F.col(kind) == from_kind)).withColumn(kind, F.when(F.col("_moved"), to_kind).otherwise(F.col(kind)))
    w = Window.partitionBy(key, kind).orderBy(F.desc("_moved"), F.asc(tie))
    return moved.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_moved")


def age_overlap(low: Column, high: Column, youngest: Column, oldest: Column) -> Column:
    """Ranges meet; a missing end passes."""
    return F.coalesce(low <= oldest, F.lit(True)) & F.coalesce(high >= youngest, F.lit(True))


def expand_mask(mask: Column, bit: int, also: int) -> Column:
    """Where a bit is set, another is set too."""
    return F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, mask.bitwiseOR(F.lit(1 << also))).otherwise(mask)


def first_match_by_pass(candidates: DataFrame, key: str, rank: str, match: str) -> DataFrame:
    """The candidate of the earliest pass, then the least match."""
    return candidates.groupBy(key).agg(F.min(F.struct(rank, match)).alias("_b")).select(key, F.col(f"_b.{match}").alias(match), F.col(f"_b.{rank}").alias(rank))
