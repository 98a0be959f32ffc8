"""Flat files: delimited text with tolerant typing, and the newest of dated files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def snake_headers(names: list[str]) -> list[str]:
    """Lower snake case, 63 characters at most, repeats numbered from _2."""
    out, seen = [], {}
    for k, name in enumerate(names):
        s = re.sub(r"[^a-z0-9]+", "_", (name or "").lstrip("﻿").strip().lower()).strip("_")[:63] or f"column_{k + 1}"
        seen[s] = seen.get(s, 0) + 1
        out.append(s if seen[s] == 1 else f"{s[:60]}_{seen[s]}")
    return out


def read_text_table(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """All columns as strings under snake-case names; quoted fields may hold line ends."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*snake_headers(df.columns))


def keep_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Listed columns under new names; a missing one is null; blanks become null."""
    there = set(df.columns)
    return df.select(*((F.when(F.trim(c) == "", None).otherwise(F.trim(c)) if c in there else F.lit(None).cast("string")).alias(n) for c, n in wanted.items()))


def tolerant(c: Column, kind: str) -> Column:
    """A cast whose failures are null: int, double, decimal(p,s), boolean, date (dd/MM/yyyy or ISO)."""
    if kind == "date":
        return F.coalesce(F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "yyyy-MM-dd"))
    if kind == "boolean":
        s = F.lower(F.trim(c))
        return F.when(s.isin("y", "yes", "true", "1"), True).when(s.isin("n", "no", "false", "0"), False)
    return F.regexp_replace(c, r"[£,\s]", "").try_cast(kind)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*(tolerant(F.col(c), k).alias(c) if (k := kinds.get(c)) else F.col(c) for c in df.columns))


def newest(spark: SparkSession, pattern: str, date_regex: str = r"(\d{4}-\d{2}-\d{2})") -> str:
    """The path whose name holds the latest date."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    row = files.withColumn("d", F.regexp_extract("path", date_regex, 1)).where("d <> ''").agg(F.max_by("path", "d").alias("p")).first()
    if not row.p:
        raise FileNotFoundError(pattern)
    return row.p
