"""Publishing: masking, nested documents, dictionary encoding, snapshots and the binary answer."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the binary answer: 8-byte header (magic, count), then columns packed one after the other.
MAGIC = 0x53495331


def mask(df: DataFrame, private: Column, blank: list[str], postcode: str) -> DataFrame:
    """Private rows lose the columns to blank, and their postcode is cut to its district."""
    from placelens.functions.text import privacy_postcode

    out = {c: F.when(~private, F.col(c)) for c in blank} | {postcode: F.when(private, privacy_postcode(F.col(postcode))).otherwise(F.col(postcode))}
    return df.withColumns(out)


def insufficient(name: Column, contacts: list[Column]) -> Column:
    """No usable name and nothing to reach or find it by."""
    blank = F.coalesce(F.trim(name).isin("", "REDACTED"), F.lit(True))
    for c in contacts:
        blank = blank & c.isNull()
    return blank


def nested_documents(parents: DataFrame, children: DataFrame, key: str, child_fields: list[str], order: str) -> DataFrame:
    """(key, doc): JSON of the parent with its children in order; nulls are left out."""
    rows = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, *(c for c in child_fields if c != order)))), lambda x: F.struct(*(x[c].alias(c) for c in child_fields))).alias("items"))
    joined = parents.join(rows, key, "left")
    return joined.select(key, F.to_json(F.struct(*(c for c in joined.columns))).alias("doc"))


def dictionary_encode(df: DataFrame, group: str, code: str) -> DataFrame:
    """Codes as 0-based places in their group's sorted distinct codes: adds dictionary and index."""
    words = df.groupBy(group).agg(F.array_sort(F.collect_set(code)).alias("dictionary"))
    return df.join(words, group).withColumn("index", (F.array_position("dictionary", F.col(code)) - 1).cast("long"))


def decode_indices(dictionary: Column, indices: Column) -> Column:
    """Indices out of range are dropped."""
    return F.transform(F.filter(indices, lambda i: (i >= 0) & (i < F.size(dictionary))), lambda i: F.get(dictionary, i))


def pack_columns(pdf: pd.DataFrame, kinds: dict[str, str]) -> bytes:
    """The binary answer: header and little-endian columns; missing floats are NaN and missing bytes -1."""
    parts = [struct.pack("<II", MAGIC, len(pdf))]
    for name, kind in kinds.items():
        values = pdf[name].astype("float32") if kind == "f" else pdf[name].fillna(-1).astype({"b": "int8", "q": "int64", "i": "int32"}[kind])
        parts.append(values.to_numpy().astype(f"<{ {'f': 'f4', 'b': 'i1', 'q': 'i8', 'i': 'i4'}[kind] }").tobytes())
    return b"".join(parts)


def unpack_columns(data: bytes, kinds: dict[str, str]) -> pd.DataFrame:
    import numpy as np

    magic, n = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no answer of this kind")
    at, out = 8, {}
    for name, kind in kinds.items():
        dtype = np.dtype({"f": "<f4", "b": "i1", "q": "<i8", "i": "<i4"}[kind])
        out[name] = np.frombuffer(data, dtype, n, at)
        at += n * dtype.itemsize
    return pd.DataFrame(out)


def pack_answers(rows: DataFrame, key: str, order: str, kinds: dict[str, str]) -> DataFrame:
    """One binary answer per key; answers are cut at the search's limit, so a group is small."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(pdf)], "answer": [pack_columns(pdf.sort_values(order), kinds)]})

    return rows.groupBy(key).applyInPandas(one, f"{key} {rows.schema[key].dataType.simpleString()}, n long, answer binary")


def publish_snapshot(df: DataFrame, root: str) -> str:
    """Write a new version below root and point root/CURRENT to it; readers see the old version or the new one."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tmp, current = (jvm.org.apache.hadoop.fs.Path(f"{root}/{x}") for x in (f"CURRENT.{version}", "CURRENT"))
    out = tmp.getFileSystem(conf).create(tmp, True)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.getFileSystem(conf).getUri(), conf)
    context.rename(context.makeQualified(tmp), context.makeQualified(current), over)
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.text(f"{root}/CURRENT").first()[0]
    return spark.read.parquet(f"{root}/{version}")

