"""When children gain and lose schemes: rules as date intervals, cut by spells, joined, and read at the first of each month.

An interval is [start, stop) of a child and scheme. Nothing is evaluated by
date: borders are computed from the birth month once, whatever the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.functions import numbers
from placelens.operators import scratch
from placelens.operators.scoring import work_test

_EVER = "0001-01-01"
#: Schemes that need the parents to work.
WORKING = ("30_hours_working_families", "tax_free_childcare", "universal_credit_childcare")


def scheme_intervals(children: DataFrame) -> DataFrame:
    """child_id, scheme, start, stop for the schemes of scoring.entitlements, whose columns children has."""
    c, y, m = F.col, F.col("birth_year"), F.col("birth_month")
    born, ever = F.make_date(y, m, F.lit(1)), F.lit(_EVER).cast("date")
    months = lambda n: F.add_months(born, n)
    september = lambda years: F.make_date(y + years + (m >= 9).cast("int"), F.lit(9), F.lit(1))
    term = lambda years: numbers.next_term_start(y + years, m)
    school = F.greatest(months(48), september(4))
    works = work_test(*(c(k) for k in ("has_partner", "user_works", "partner_works", "user_exempt", "partner_exempt")))
    earns = works & c("earns_enough") & ~c("over_100k")
    rules: dict[str, tuple[Column, Column, Column]] = {
        "30_hours_working_families": (earns & c("in_england") & c("public_funds") & c("ni_number"), months(9), school),
        "15_hours_universal": (c("in_england"), term(3), school),
        "15_hours_2_year_olds": (c("in_england") & (c("fostered") | c("disabled") | c("low_income")), term(2), term(3)),
        "tax_free_childcare": (earns & ~c("on_uc") & ~c("fostered"), ever, F.when(c("disabled"), september(16)).otherwise(september(11))),
        "universal_credit_childcare": (c("on_uc") & works, ever, september(16)),
        "wraparound": (F.lit(True), school, months(F.when(c("has_send"), 19 * 12).otherwise(15 * 12))),
        "breakfast_club": (F.lit(True), school, months(12 * 12)),
        "holiday_activities": (c("benefit"), school, months(17 * 12)),
    }
    each = F.array(*(F.when(F.coalesce(ok, F.lit(False)) & (start < stop), F.struct(F.lit(k).alias("scheme"), start.alias("start"), stop.alias("stop"))) for k, (ok, start, stop) in rules.items()))
    return children.select("child_id", F.explode(F.array_compact(each)).alias("e")).select("child_id", "e.*")


def cut(intervals: DataFrame, spells: DataFrame, schemes: tuple[str, ...]) -> DataFrame:
    """Intervals of the given schemes as far as a spell (child_id, start, stop) lasts; a row for each meeting. Others as they are."""
    own = spells.groupBy("child_id").agg(F.collect_list(F.struct("start", "stop")).alias("_spells"))
    part = lambda s: F.struct(F.greatest("start", s["start"]).alias("start"), F.least("stop", s["stop"]).alias("stop"))
    met = F.filter(F.transform("_spells", part), lambda p: p["start"] < p["stop"])
    parts = F.when(F.col("scheme").isin(*schemes), met).otherwise(F.array(F.struct("start", "stop")))
    # intervals are read once and stay where their child is: no union, no shuffle if both sides lie by child
    return intervals.join(scratch.merged(own), "child_id", "left").select("child_id", "scheme", F.explode(parts).alias("_p")).select("child_id", "scheme", "_p.*")


def joined(intervals: DataFrame) -> DataFrame:
    """Intervals of a child and scheme that meet or overlap become one: a sweep by start with the latest stop so far."""
    w = Window.partitionBy("child_id", "scheme").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= F.col("_before"), 0).otherwise(1)).over(w)
    runs = intervals.withColumn("_before", before).withColumn("_run", run)
    return runs.groupBy("child_id", "scheme", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")


def transitions(intervals: DataFrame, at: Column, months: int = 12) -> DataFrame:
    """child_id, scheme, direction (gain or loss) and the first of the month, months after at's month at most, at which it shows.

    Intervals are joined ones. A border shows at the first of the month on or after it, unless the next border comes before that.
    """
    month = F.trunc(at, "month")
    shows = lambda d: F.when(d == F.trunc(d, "month"), d).otherwise(F.add_months(F.trunc(d, "month"), 1))
    w = Window.partitionBy("child_id", "scheme").orderBy("start")
    marked = intervals.withColumn("next", F.lead("start").over(w))
    soonest = F.add_months(month, 1)
    on = F.when(F.col("start") > at, F.greatest(shows(F.col("start")), soonest))
    off = F.when(F.col("stop") > at, F.greatest(shows(F.col("stop")), soonest))
    gain = F.min(F.when(on < F.col("stop"), on))
    loss = F.min(F.when(F.coalesce(off < F.col("next"), F.lit(True)), off))
    now = F.max((F.col("start") <= at) & (F.col("stop") > at))
    each = marked.groupBy("child_id", "scheme").agg(now.alias("now"), gain.alias("gain"), loss.alias("loss"))
    out = each.select("child_id", "scheme", F.when(F.col("now"), "loss").otherwise("gain").alias("direction"), F.when(F.col("now"), F.col("loss")).otherwise(F.col("gain")).alias("at"))
    return out.where(F.col("at") <= F.add_months(month, months))
