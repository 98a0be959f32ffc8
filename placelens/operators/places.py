"""Where a provider is, which area it belongs to, what its pages and sessions are; look-ups by prefix; typed backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType


def located(df: DataFrame, points: list[tuple[str, str, DataFrame]], boxes: list[tuple[str, str, DataFrame]], postcode: str, finer: DataFrame, coarse: list[str]) -> DataFrame:
    """df with lat, lon, location_source, geo_type and geo_code from the first source that has them.

    points are (source, key, rows of key, lat, lon), boxes (source, key, rows of
    key, geo_type, geo_code), finer has rows of postcode, geo_type, geo_code. A
    point goes before any box. A box of a coarse type gives way to the postcode's,
    if that is not coarse; a provider without any has the postcode's box. Of rows
    of one key the least counts; keys that are null match nothing.
    """
    out, found, assigned = df, [], []
    for k, (source, key, rows) in enumerate(points):
        one = rows.where("lat is not null and lon is not null").groupBy(key).agg(F.min(F.struct("lat", "lon")).alias(f"_p{k}"))
        out = out.join(one, key, "left")
        found.append(F.when(F.col(f"_p{k}").isNotNull(), F.struct(F.col(f"_p{k}.lat"), F.col(f"_p{k}.lon"), F.lit(source).alias("location_source"), *(F.lit(None).cast("string").alias(x) for x in ("geo_type", "geo_code")))))
    at = lambda source, x: F.struct(*(F.lit(None).cast("double").alias(y) for y in ("lat", "lon")), F.lit(f"bbox:{source}").alias("location_source"), x["geo_type"].alias("geo_type"), x["geo_code"].alias("geo_code"))
    own = finer.groupBy(F.col("postcode").alias(postcode)).agg(F.min(F.struct("geo_type", "geo_code")).alias("_f"))
    out = out.join(own, postcode, "left")
    for k, (source, key, rows) in enumerate(boxes):
        out = out.join(rows.groupBy(key).agg(F.min(F.struct("geo_type", "geo_code")).alias(f"_b{k}")), key, "left")
        box = F.col(f"_b{k}")
        gives = box["geo_type"].isin(coarse) & F.col("_f").isNotNull() & ~F.col("_f.geo_type").isin(coarse)
        assigned.append(F.when(box.isNotNull(), F.when(gives, at("postcode", F.col("_f"))).otherwise(at(source, box))))
    last = F.when(F.col("_f").isNotNull(), at("postcode", F.col("_f")))
    return out.withColumn("_at", F.coalesce(*found, *assigned, last)).select(*df.columns, "_at.*")


def resolved_area(by_postcode: Column, by_place: Column, given: Column, shared: Column) -> Column:
    """struct(area, source): the postcode's area, else the place's, else the given one, which says little on a platform that areas share."""
    source = F.when(by_postcode.isNotNull(), "postcode_lookup").when(by_place.isNotNull(), "coords_lookup").when(F.coalesce(shared, F.lit(False)), "unresolved").otherwise("scraper_assigned")
    return F.struct(F.coalesce(by_postcode, by_place, given).alias("area"), source.alias("source"))


def own_links(rows: DataFrame, key: list[str], link: str, richness: Column, order: str, provider_link: str) -> DataFrame:
    """key and its richest row's link, ties to the least order; null if it is the provider's own link."""
    best = rows.where(F.col(link).isNotNull()).groupBy(*key).agg(F.min_by(F.struct(link, provider_link), F.struct(-richness, order)).alias("_x"))
    return best.select(*key, F.nullif(F.col(f"_x.{link}"), F.col(f"_x.{provider_link}")).alias(link))


def session_table(fees: DataFrame, key: str, band: str, session: str, amount: str, sessions: list[str]) -> DataFrame:
    """key, band and a column of shown amounts for each session, for keys that have amounts of two sessions or more."""
    known = fees.where(F.col(session).isin(sessions) & F.col(amount).isNotNull())
    several = known.groupBy(key).agg(F.count_distinct(session).alias("_n")).where("_n > 1").select(key)
    least = {s: F.min(F.when(F.col(session) == s, F.col(amount))).cast("double") for s in sessions}
    cells = [F.when(x.isNotNull(), F.format_string("£%.2f", x)).alias(s) for s, x in least.items()]
    return known.join(several, key, "left_semi").groupBy(key, band).agg(*cells)


def by_prefix(queries: DataFrame, prefix: str, codes: DataFrame, code: str) -> DataFrame:
    """queries and each code that starts with its prefix, in capitals without spaces; an empty prefix finds nothing.

    Codes are listed under each of their beginnings, so that this is an equi-join.
    """
    begins = codes.select(code).distinct().withColumn("_k", F.explode(F.transform(F.sequence(F.lit(1), F.length(code)), lambda n: F.substr(F.col(code), F.lit(1), n))))
    return queries.withColumn("_k", F.upper(F.regexp_replace(prefix, r"\s+", ""))).join(begins, "_k").drop("_k")


def visit_properties(areas: Column, user_status: Column, partner_status: Column, benefits: Column, ages_months: Column, sought: Column) -> Column:
    """What an event tells of a household: area, working, receives_benefits, child_count, youngest_band, care_types."""
    works = lambda x: F.coalesce(x != "not_working", F.lit(False))
    some = F.coalesce(benefits, F.array().cast("array<string>"))
    return F.struct(
        F.coalesce(F.get(F.filter(areas, lambda a: a.startswith("E")), F.lit(0)), F.get(areas, F.lit(0))).alias("area"),
        (works(user_status) | works(partner_status)).alias("working"),
        ((F.size(some) > 0) & ~F.array_contains(some, "none")).alias("receives_benefits"),
        F.greatest(F.least(F.size(ages_months), F.lit(3)), F.lit(1)).alias("child_count"),
        F.when(F.array_min(ages_months) < 60, "0-4").otherwise("5+").alias("youngest_band"),
        F.array_sort(F.array_distinct(F.filter(sought, lambda x: x.isNotNull()))).alias("care_types"),
    )


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, n): how many rows meet each condition, in one pass; null does not meet it."""
    sums = df.agg(*(F.count_if(ok).alias(n) for n, ok in checks.items()))
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*(F.col(f"`{n}`") for n in checks))))).toDF("check", "n")


def backup(df: DataFrame, path: str) -> None:
    """Write df with nested columns as JSON; the field's metadata keeps its type."""
    nested = {f.name: f.dataType.simpleString() for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    df.select(*(F.to_json(f.name).alias(f.name, metadata={"type": nested[f.name]}) if f.name in nested else F.col(f.name) for f in df.schema)).write.parquet(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """Read a backup with the types that it was made of."""
    df = spark.read.parquet(path)
    typed = lambda f: F.from_json(f.name, f.metadata["type"]).alias(f.name) if _kept(f) else F.col(f.name)
    return df.select(*map(typed, df.schema))


def _kept(f: StructField) -> bool:
    return "type" in (f.metadata or {})
