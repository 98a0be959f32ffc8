"""Tables in the shared folder, which end lineage so that a lost executor costs only its tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A fresh path below spark.checkpoint.dir. A local folder takes its place only in a local session, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="placelens-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write df and read it again."""
    where = shared_path(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df over as many tasks as a shuffle has, by columns if any: tables of few bytes and much work else lie in a few, and adaptive execution joins them again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def dealt(df: DataFrame, *by: str, rows: int) -> DataFrame:
    """df by columns, if any, over as many tasks as hold about so many rows each: a fixed number of them holds more as df grows. df is counted for it, so it should be cheap to read."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *by)


def merged(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast a side: files of made or repeated values are far smaller than their rows, which Spark goes by."""
    return df.hint("merge")
