"""Provider-like tables from the test tables, by formulas that SQL states alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Providers: every fifth has a box instead of a point, every 17th has no place.
PROVIDERS_SQL = """
SELECT c_custkey AS provider_id, c_name AS name, c_nationkey AS area, c_mktsegment AS segment, c_acctbal AS balance,
       CAST(c_custkey % 8 AS INT) AS care_type,
       CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 THEN 50 + CAST(c_custkey * 37 % 5000 AS DOUBLE) / 1000 END AS lat,
       CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 17 <> 0 THEN -5 + CAST(c_custkey * 53 % 6000 AS DOUBLE) / 1000 END AS lon,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 17 <> 0 THEN 50 + CAST(c_custkey * 37 % 5000 AS DOUBLE) / 1000 END AS bbox_south,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 17 <> 0 THEN -5 + CAST(c_custkey * 53 % 6000 AS DOUBLE) / 1000 END AS bbox_west,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 17 <> 0 THEN 50.05 + CAST(c_custkey * 37 % 5000 AS DOUBLE) / 1000 END AS bbox_north,
       CASE WHEN c_custkey % 5 = 0 AND c_custkey % 17 <> 0 THEN -4.95 + CAST(c_custkey * 53 % 6000 AS DOUBLE) / 1000 END AS bbox_east,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 11 AS INT) END AS min_months,
       CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 6 AS INT) END AS min_years,
       CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 9 + 2 AS INT) END AS max_years,
       c_custkey % 2 = 0 AS funded,
       CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 900 AS DOUBLE) / 100 ELSE -1 END AS graduates,
       CAST(c_custkey % 500 AS DOUBLE) / 10 AS turnover, 8.0E0 AS daily_open, 16.0E0 + CAST(c_custkey % 30 AS DOUBLE) / 10 AS daily_close,
       CAST(c_custkey % 53 AS INT) AS annual_opening, CAST(c_custkey % 100 AS DOUBLE) / 10 - 1 AS inspection,
       CAST(c_custkey % 1200 AS DOUBLE) / 100 AS sort_cost_all, CAST(c_custkey % 1300 AS DOUBLE) / 100 AS sort_cost_under2,
       CASE WHEN c_custkey % 6 <> 0 THEN CAST(c_custkey % 1100 AS DOUBLE) / 100 END AS sort_cost_age2,
       CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_custkey % 1000 AS DOUBLE) / 100 END AS sort_cost_age3to4,
       CAST(c_custkey % 700 AS DOUBLE) / 100 AS sort_cost_age5plus
FROM customer"""

#: Viewports: one per nation.
VIEWPORTS_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS query_id, 50.5E0 + CAST(n_nationkey AS DOUBLE) / 6 AS q_lat, -4.5E0 + CAST(n_nationkey AS DOUBLE) / 5 AS q_lon,
       50.4E0 + CAST(n_nationkey AS DOUBLE) / 6 AS south, -4.7E0 + CAST(n_nationkey AS DOUBLE) / 5 AS west,
       50.7E0 + CAST(n_nationkey AS DOUBLE) / 6 AS north, -4.2E0 + CAST(n_nationkey AS DOUBLE) / 5 AS east
FROM nation"""


def from_sql(spark: SparkSession, sf_dir: str, sql: str, source: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {source}", "FROM {rows}"), rows=table(spark, sf_dir, source))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, PROVIDERS_SQL, "customer")


def viewports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_sql(spark, sf_dir, VIEWPORTS_SQL, "nation")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a session of a user's day."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("session_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))
