"""Shared plumbing: tables, the shared work folder, and files in it."""

from __future__ import annotations

import gc
import json
import tempfile
import time
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

WHITE = b" \t\n\r\x0b\x0c"
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh path under spark.checkpoint.dir, which every executor sees.

    Only where that setting is missing in a local session, as in tests, a local
    folder takes its place, one for each application; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="placelens-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/placelens-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    where = where or shared_dir(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished, unreferenced plans.

    The first collection frees what Python referred to; only the next ones find the plans.
    """
    for _ in range(4):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if spark.sparkContext.master.startswith("local["):
            return  # one process, whose own collections do
        time.sleep(0.8)


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder that this library wrote into the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a whole file under another name, then move it.

    A task that runs twice finds the whole file of the first run, which holds the
    same bytes, and leaves it: no file system has to replace a name.
    """
    files, path = open_fs(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    if files.get_file_info(path).type == pafs.FileType.NotFound:
        files.move(part, path)
    else:
        files.delete_file(part)


def get_range(uri: str, start: int, length: int | None = None) -> bytes:
    files, path = open_fs(uri)
    with files.open_input_file(path) as f:
        size = f.size()
        length = size - start if length is None else max(0, min(length, size - start))
        return f.read_at(length, start) if length else b""


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_list(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def hidden(df: DataFrame, *names: str) -> dict[str, str]:
    """Names for helper columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for n in names:
        free = f"_{n}"
        while free.lower() in taken:
            free = "_" + free
        taken.add(free.lower())
        out[n] = free
    return out


def as_json(x) -> str:
    return json.dumps(x, separators=(",", ":"), sort_keys=True)
