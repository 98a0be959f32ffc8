"""A Parquet layout for viewports: providers along a space-filling curve, boxes of files, and where each provider's rows lie.

Folder: rows (the table, a provider's rows together), files (a row per file: its
name, box and number of rows) and ranges (per provider: file, first row, rows).
Places near each other are near on the curve, so files have small boxes and a
viewport reads few of them. Unlocated providers lie at the end, in files
without a box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placelens.operators import scratch, spatial

#: Bits a side of the curve's grid, over the whole globe: cells of 0.003 by 0.005 degrees.
_BITS = 16
# What stands for a null in columns of small integers and of floats, and the kinds of both.
SMALL, FLOAT, SMALL_KINDS, FLOAT_KINDS = -1, float("nan"), ("tinyint", "smallint", "int"), ("float", "double")


def curve(lat: Column, lon: Column) -> Column:
    """The place on a Z-order curve, bits of both in turn; null where either is."""
    cell = lambda x, low, width: F.least(F.greatest(F.floor((x - low) / width * (1 << _BITS)), F.lit(0)), F.lit((1 << _BITS) - 1)).cast("long")
    spread = lambda x: sum((F.shiftleft(F.shiftright(x, k).bitwiseAND(F.lit(1)), 2 * k) for k in range(_BITS)), F.lit(0).cast("long"))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.shiftleft(spread(cell(lat, -90.0, 180.0)), 1) + spread(cell(lon, -180.0, 360.0)))


def with_sentinels(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nulls of small integers and floats as fixed values, but in the columns of keep."""
    kinds = dict(df.dtypes)
    fill = {k: F.coalesce(F.col(k), F.lit(SMALL).cast(t)) for k, t in kinds.items() if t in SMALL_KINDS and k not in keep}
    fill |= {k: F.coalesce(F.col(k), F.lit(FLOAT).cast(t)) for k, t in kinds.items() if t in FLOAT_KINDS and k not in keep}
    return df.withColumns(fill) if fill else df


def write_index(providers: DataFrame, where: str, files: int, key: str = "provider_id") -> DataFrame:
    """Lay providers (key, lat, lon, bbox_*, any more) out in about so many files; the table of files.

    A provider's rows go by its first place on the curve, so that they stay together.
    """
    south, west, north, east = spatial.extent()
    at = F.min(curve((south + north) / 2, (west + east) / 2)).over(Window.partitionBy(key))
    rows = with_sentinels(providers, keep=("lat", "lon", *spatial.BOX)).withColumns({"south": south, "west": west, "north": north, "east": east}).withColumn("_at", at)
    rows = scratch.written(rows)
    order = [F.col("_at").asc_nulls_last(), F.col(key)]
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("_at").write.parquet(f"{where}/rows")
    spark = providers.sparkSession
    placed = spark.read.parquet(f"{where}/rows").select(key, "south", "west", "north", "east", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed.groupBy(key, "file").agg(F.min("row").alias("first"), F.count("*").alias("n")).write.parquet(f"{where}/ranges")
    boxes = placed.groupBy("file").agg(F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"), F.count("*").alias("n"))
    boxes.coalesce(1).write.parquet(f"{where}/files")  # a row per file
    return spark.read.parquet(f"{where}/files")


def in_box(box: tuple[float, float, float, float]) -> Column:
    """Extents (south, west, north, east) that meet the box."""
    south, west, north, east = box
    return (F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west)


def read_viewport(spark: SparkSession, where: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows that meet the box (south, west, north, east), from the files whose boxes do; the rest is left to the files' statistics."""
    names = [r.file for r in spark.read.parquet(f"{where}/files").where(in_box(box)).select("file").collect()]  # as many as the viewport meets
    schema = spark.read.parquet(f"{where}/rows").schema
    rows = spark.read.schema(schema).parquet(*(f"{where}/rows/{n}" for n in names)) if names else spark.createDataFrame([], schema)
    return rows.where(in_box(box))


def read_viewports(spark: SparkSession, where: str, viewports: DataFrame) -> DataFrame:
    """query_id and rows for many viewports (query_id, south, west, north, east): only files that one of them meets are read."""
    v = viewports.select("query_id", *(F.col(k).alias(f"v_{k}") for k in ("south", "west", "north", "east")))
    meets = (F.col("south") <= F.col("v_north")) & (F.col("north") >= F.col("v_south")) & (F.col("west") <= F.col("v_east")) & (F.col("east") >= F.col("v_west"))
    wanted = spark.read.parquet(f"{where}/files").join(v, meets).select("query_id", "v_south", "v_west", "v_north", "v_east", "file")
    rows = spark.read.parquet(f"{where}/rows").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(wanted, "file").where(meets).drop("file", "v_south", "v_west", "v_north", "v_east")


def row_ranges(df: DataFrame, key: str) -> DataFrame:
    """(key, first, n): where the rows of each key lie in a table ordered by key, counted from 0.

    Counts are added up in ranges of keys at once, and ranges by their sums.
    """
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    dealt = scratch.written(n.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.sum("n").alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))  # a row per partition
    within = F.sum("n").over(Window.partitionBy("_part").orderBy(key)) - F.col("n")
    return dealt.withColumn("_in", within).join(before, "_part").select(key, (F.col("_before") + F.col("_in")).alias("first"), "n")
