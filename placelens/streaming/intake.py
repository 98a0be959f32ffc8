"""Incremental intake of events with a stored cursor, each event once however often it comes.

A table is a folder with events/batch=N/day=D and cursor/batch=N. A batch takes
the events after the cursor, which is the greatest time loaded by earlier
batches (at the first load, some days before now). What comes with a time up to
the cursor is late: it is counted, and kept apart, not lost. Ids that are
loaded already count as repeated. Rows without an id or a time are left out.

A batch writes its own folders, events before the cursor. One that is run again
after a failure reads the cursor of the batches before it, so it finds the same
rows and writes the same folders over.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_LOG = "batch long, cursor timestamp, loaded long, late long, repeated long"


def _read(spark: SparkSession, where: str, schema: str) -> DataFrame:
    """The table's rows; none where nothing has been written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", where).parquet(where)


def log(spark: SparkSession, where: str) -> DataFrame:
    """One row per batch: cursor after it, and how many events were loaded, late and repeated."""
    return _read(spark, f"{where}/cursor", _LOG)


def stored(spark: SparkSession, where: str, schema: str, kind: str = "events") -> DataFrame:
    """Events that are loaded, or kind "late": those that came too late. schema: of the source."""
    return _read(spark, f"{where}/{kind}", f"{schema}, batch long, day date").drop("batch", "day")


def load_batch(batch: DataFrame, number: int, where: str, key: str, ts: str, now: dt.datetime, first_days: int = 30) -> None:
    """Load one batch; equal ids within it count once, the earliest time wins."""
    spark = batch.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    last = log(spark, where).where(F.col("batch") < number).agg(F.max("cursor")).first()[0]
    cursor = last or now - dt.timedelta(days=first_days)
    batch = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("day", F.to_date(ts)).persist()
    after = batch.where(F.col(ts) > F.lit(cursor))
    once = after.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.col(ts)).alias("_e")).select("_e.*")
    known = _read(spark, f"{where}/events", f"{schema}, batch long, day date").where(F.col("batch") < number).select(key)  # one column of the table
    new = once.join(known, key, "left_anti").persist()
    write = lambda df, kind: df.write.mode("overwrite").partitionBy("day").parquet(f"{where}/{kind}/batch={number}")
    write(new.select(batch.columns), "events")
    late = batch.where(F.col(ts) <= F.lit(cursor))
    write(late, "late")
    counts = new.agg(F.max(ts).alias("m"), F.count("*").alias("n")).first()
    n_late, n_after = late.count(), after.count()
    row = [(max(filter(None, (counts.m, last)), default=None), counts.n, n_late, n_after - counts.n)]
    spark.createDataFrame(row, "cursor timestamp, loaded long, late long, repeated long").coalesce(1).write.mode("overwrite").parquet(f"{where}/cursor/batch={number}")
    new.unpersist()
    batch.unpersist()


def pull(stream: DataFrame, where: str, key: str, ts: str, now: dt.datetime, first_days: int = 30) -> StreamingQuery:
    """Take all that the stream has into the table and stop; a later pull goes on where this one ended."""
    sink = lambda batch, number: load_batch(batch, number, where, key, ts, now, first_days)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start()
