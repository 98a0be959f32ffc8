"""Features of sessions from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_value(column: str):
    """The earliest value that is there, by (ts, event_id)."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct("ts", "event_id", column)))[column]


def session_features(events: DataFrame, kinds: list[str], value: str = "value") -> DataFrame:
    """One row per session: span, counts by kind, first and last kind, furthest step, mode, mean and median.

    events: session_id, event_id, ts, event_type, value. Blank sessions and rows without a time are left out.
    """
    own = events.where("session_id is not null and session_id <> '' and ts is not null")
    counts = [F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds]
    steps = F.create_map(*(F.lit(x) for k, name in enumerate(kinds) for x in (name, k)))
    grouped = own.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_kinds"), *counts,
        (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"),
        first_value("event_type").alias("first_kind"), F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("last_kind"),
        F.max(steps[F.col("event_type")]).cast("long").alias("furthest_step"),
        F.round(F.avg(value), 4).alias("mean_value"), F.round(F.median(value), 4).alias("median_value"),
        F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"),
    )
    by_kind = own.groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("at"))
    mode = by_kind.groupBy("session_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "at")).alias("top_kind"))
    return grouped.join(mode, "session_id")


def gap_sessions(events: DataFrame, user: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.groupBy(user, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")
