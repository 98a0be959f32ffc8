"""Incremental event intake and session counts as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """New files since the last run; the checkpoint keeps the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key; rows later than the watermark are dropped and their keys forgotten."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions that a gap ends, once the watermark has passed them."""
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"), F.sum("value").alias("value")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "value")


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def load_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take all that is there into Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
