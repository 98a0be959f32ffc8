"""GeoJSON features as rows of rings, parsed by Spark's own JSON reader, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.operators import topology

_FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_features(spark: SparkSession, path: str, properties: list[str]) -> DataFrame:
    """One row per polygon feature: its properties, rings, and the polygon (from 0) that each ring is of.

    Features without a geometry or with one that is no Polygon or MultiPolygon are left out. The
    coordinates come as text from the reader, so either depth can be parsed by its own schema.
    """
    whole = spark.read.option("multiLine", True).schema(_FEATURES).json(path)
    f = whole.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.type", "f.geometry.coordinates")
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>"))).when(
        F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>")
    )
    rings = F.transform(F.flatten("polygons"), lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    part = F.flatten(F.transform("polygons", lambda rings, k: F.transform(rings, lambda _: k)))
    own = [F.col("properties")[p].alias(p) for p in properties]
    return f.withColumn("polygons", polygons).where("polygons is not null").select(*own, rings.alias("rings"), part.alias("part"))


def read_simplified(spark: SparkSession, path: str, key: str, properties: list[str], tolerance: float) -> DataFrame:
    """Features with simplified rings and their envelope; features without a key are left out. Neighbours keep common borders."""
    names = list(dict.fromkeys([key, *properties]))
    read = read_features(spark, path, names).where(F.coalesce(F.col(key), F.lit("")) != "")
    simple = topology.simplify(read.select(F.col(key).alias("id"), "rings"), tolerance).withColumnRenamed("rings", "_simple")
    out = read.drop("rings").join(simple, F.col(key) == F.col("id")).drop("id").withColumnRenamed("_simple", "rings")
    return out.withColumns(topology.envelope(F.col("rings")))


def feature(properties: list[str], rings: str = "rings", part: str = "part") -> Column:
    """A row as the text of a GeoJSON feature, to be written a line each."""
    r, p = F.col(rings), F.col(part)
    points = lambda ring: F.transform(ring, lambda x: F.array(x["x"], x["y"]))
    polygons = F.transform(F.sequence(F.lit(0), F.array_max(p)), lambda n: F.transform(F.filter(F.arrays_zip(r.alias("r"), p.alias("p")), lambda z: z["p"] == n), lambda z: points(z["r"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), polygons.alias("coordinates")).alias("geometry")))
