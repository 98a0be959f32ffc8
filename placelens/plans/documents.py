"""HTML fields, packed answers and the event stream over the test tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from placelens.operators import publish, scratch, spatial
from placelens.plans.base import providers, table, viewports
from placelens.plans.registry import registry
from placelens.sources import fixtures, html, sheets
from placelens.streaming import events as stream
from placelens.streaming import intake

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT page_id, coalesce(len(regexp_extract_all(html, '<a href=')), 0) AS n_links FROM pages")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.regexp_count("html", F.lit("<a href=")), F.lit(0)).cast("long").alias("n_links"))


@query()
def page_fields(spark, d):
    return table(spark, d, "pages").select("page_id", html.extract("html").alias("f")).select("page_id", "f.title", "f.heading", "f.n_words", "f.email", "f.postcode")


@query()
def packed_answers(spark, d):
    """The binary answer of each viewport."""
    own = providers(spark, d)
    rows = spatial.spatial_search(own, viewports(spark, d), limit=50).join(own.select("provider_id", "care_type", "min_years"), "provider_id")
    kinds = {"provider_id": "q", "care_type": "b", "min_years": "b", "km": "f"}
    return publish.pack_answers(rows, "query_id", "km", kinds).select("query_id", "n", F.octet_length("answer").cast("long").alias("n_bytes"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_hourly_counts(spark, d):
    """Events read as a stream and deduplicated, then counted by hour from what the stream has written."""
    where = scratch.shared_path(spark, "stream")
    source = table(spark, d, "events")
    incoming = spark.readStream.schema(source.schema).parquet(f"{d}/events.parquet*")
    stream.load_available(stream.deduplicated(incoming, late="3650 days"), f"{where}/out", f"{where}/state").awaitTermination()
    rows = spark.read.parquet(f"{where}/out")
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"))


_LOADED_SQL = "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 14 DAY"


def _loaded(spark, d):
    """Events pulled into a table from 14 days before 20 January on, then pulled again, which finds nothing new."""
    where, source = scratch.shared_path(spark, "intake"), table(spark, d, "events")
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    for _ in range(2):
        incoming = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
        intake.pull(incoming, where, "event_id", "ts", dt.datetime(2024, 1, 20), first_days=14).awaitTermination()
    return where, intake.stored(spark, where, schema)


@query(f"SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM ({_LOADED_SQL}) GROUP BY 1, 2")
def pulled_events(spark, d):
    return _loaded(spark, d)[1].groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT 1 AS n_batches, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 14 DAY) AS loaded, count(*) FILTER (WHERE ts <= TIMESTAMP '2024-01-20' - INTERVAL 14 DAY) AS late, 0 AS repeated, max(ts) AS cursor FROM events")
def intake_log(spark, d):
    rows = intake.log(spark, _loaded(spark, d)[0])
    return rows.agg(F.count("*").alias("n_batches"), F.sum("loaded").alias("loaded"), F.sum("late").alias("late"), F.sum("repeated").alias("repeated"), F.max("cursor").cast("timestamp_ntz").alias("cursor"))


@query("""WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events), s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n_events, round(sum(value), 4) AS value FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    rows = stream.session_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n_events", F.round("value", 4).alias("value"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    rows = stream.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier WHERE s_nationkey IN (3, 7) AND s_name LIKE 'Supplier#0000%'")
def workbook_rows(spark, d):
    """Suppliers written to workbooks in the shared folder and read again by two partitions of each, with both filters in the reader."""
    where = scratch.shared_path(spark, "workbooks")
    sheets.write_xlsx(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), where).count()
    rows = sheets.register(spark).read.format("sheet").schema("s_suppkey string, s_name string, s_nationkey string").option("parts", 2).load(where)
    return rows.where("s_nationkey IN ('3', '7') AND s_name LIKE 'Supplier#0000%'").select("s_suppkey", "s_name")


def _loaded_documents(spark, d):
    """Customers written as JSON lines and loaded: kinds by key modulo 3 have banded fees, a flat rate, or no care at all."""
    where = scratch.shared_path(spark, "documents")
    text = F.expr("""concat('{"id": "p', c_custkey, '", "name": "', c_name, '", "phone": "+44 ', c_custkey, '", "ofsted": {"rating": "Good"}', CASE c_custkey % 3
      WHEN 0 THEN concat(', "careTypes": [{"type": "private_nursery", "fees": {"under2": {"fullDay": ', c_custkey % 90, '.5, "perHour": 7}, "age2": {"fullDay": 1}}, "openingHours": [{"days": "13", "open": "08:00", "close": "18:00"}]}, {"type": "holiday_club", "minimumCommitment": false}]')
      WHEN 1 THEN concat(', "careTypes": [{"type": "breakfast_club", "fees": {"perSession": ', c_custkey % 7, '}}]') ELSE '' END, '}')""")
    table(spark, d, "customer").select(text.alias("value")).write.text(where)
    return fixtures.tables(fixtures.read_documents(spark, where))


@query("""SELECT 'fixture:p' || id AS provider_id, care_type, no_minimum, age_band, full_day, per_hour, per_session FROM (SELECT c_custkey AS id, c_custkey % 3 AS k FROM customer), (VALUES (0, 'private_nursery', false, 'under2', -1.0, 7.0, NULL), (0, 'private_nursery', false, 'age2', 1.0, NULL, NULL), (0, 'holiday_club', true, NULL, NULL, NULL, NULL),
 (1, 'breakfast_club', false, 'all', NULL, NULL, -1.0)) v(k2, care_type, no_minimum, age_band, full_day, per_hour, per_session) WHERE k = k2""".replace("full_day, per_hour, per_session FROM", "CASE WHEN full_day = -1 THEN id % 90 + 0.5 ELSE full_day END AS full_day, per_hour, CASE WHEN per_session = -1 THEN id % 7 ELSE per_session END AS per_session FROM"))
def loaded_fees(spark, d):
    t = _loaded_documents(spark, d)
    return t["care_types"].join(t["fee_rates"], "care_type_id", "left").select("provider_id", "care_type", F.col("no_minimum_commitment").alias("no_minimum"), "age_band", "full_day", "per_hour", "per_session")


@query("""WITH n AS (SELECT count(*) FILTER (WHERE c_custkey % 3 = 0) AS a, count(*) FILTER (WHERE c_custkey % 3 = 1) AS b, count(*) AS c FROM customer)
SELECT 'providers' AS "table", c AS rows, 0 AS lost FROM n UNION ALL SELECT 'care_types', 2 * a + b, 0 FROM n UNION ALL SELECT 'opening_hours', a, 0 FROM n UNION ALL SELECT 'fee_rates', 2 * a + b, 0 FROM n""")
def loaded_tables(spark, d):
    t = _loaded_documents(spark, d)
    rows = None
    for name in ("providers", "care_types", "opening_hours", "fee_rates"):
        n = t[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        rows = n if rows is None else rows.unionByName(n)
    return rows.join(fixtures.orphans(t).withColumnRenamed("n", "lost"), "table", "left").select("table", "rows", F.coalesce("lost", F.lit(0)).alias("lost"))
