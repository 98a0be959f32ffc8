"""Inspection scores, hourly rates, support amounts and entitlement rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.functions import numbers

# Points by framework.
MAIN = {"Outstanding": 9.0, "Good": 6.0, "Requires Improvement": 3.0, "Inadequate": 0.0}
SUB = {"Outstanding": 1.0, "Good": 0.67, "Requires Improvement": 0.33, "Inadequate": 0.0}
TRANSITION = {"Outstanding": 10.0, "Good": 6.67, "Requires Improvement": 3.33, "Inadequate": 0.0}
REPORT_CARD = {"Exceptional": 10.0, "Strong": 7.5, "Expected": 5.0, "Needs attention": 2.5, "Urgent improvement": 0.0}


def _points(c: Column, table: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def _mean(values: list[Column]) -> Column:
    there = F.filter(F.array(*values), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there))


def inspection_score(framework: Column, rating: Column, subs: list[Column], judgements: list[Column], flags: list[Column], agency_points: Column) -> Column:
    """By framework, less one per flag that is false; -10 where nothing tells."""
    legacy = _points(rating, MAIN) + F.coalesce(_mean([_points(s, SUB) for s in subs]), F.lit(0.0))
    score = F.when(framework == "legacy", legacy).when(framework == "legacy_transition", _mean([_points(s, TRANSITION) for s in subs])).when(framework == "report_card", _mean([_points(j, REPORT_CARD) for j in judgements]))
    penalty = sum((F.when(f == F.lit(False), 1.0).otherwise(0.0) for f in flags), F.lit(0.0))
    known = framework.isin("legacy", "legacy_transition", "report_card")
    return F.when(framework.isNull(), F.coalesce(agency_points, F.lit(-10.0))).when(known, F.coalesce(score, F.lit(-10.0)) - penalty).otherwise(-10.0)


def session_hours(care_type: Column, hours: Column) -> Column:
    return F.when(hours.isNull() | (hours <= 0), None).when(care_type == "breakfast_club", F.least(hours, F.lit(1.5))).when(care_type == "after_school_club", F.least(hours, F.lit(3.0))).otherwise(hours)


def hourly_rate(band: Column, fee: dict[str, Column], session: dict[str, Column], care_type: Column, hours: Column) -> Column:
    """The first of the fees that gives an hourly rate. A session fee without hours ends the search with null."""
    per = lambda amount, h: F.when(amount.isNotNull() & (h > 0), amount / h)
    by_part = F.coalesce(per(fee["full_day"], session["full_day"]), per(fee["morning_session"], session["morning"]), per(fee["afternoon_session"], session["afternoon"]))
    by_day = per(fee["per_day"], F.when(hours > 0, hours).otherwise(10.0))
    tail = F.when(fee["per_session"].isNotNull(), per(fee["per_session"], session_hours(care_type, hours))).otherwise(by_day)
    return F.when(fee["per_hour"].isNotNull(), fee["per_hour"]).when((band != "all") & by_part.isNotNull(), by_part).otherwise(tail)


def funded_hours(age2: Column, two_year: Column, working: Column, universal: Column) -> Column:
    """Weekly hours: the two-year-old hours first, topped up to 30 for working families, else the universal 15."""
    first = F.when(age2 & two_year, 15).otherwise(0)
    return first + F.when(working, 30 - first).when(universal, 15).otherwise(0)


def tax_free_support(net: Column, has_send: Column, rate: float = 0.25, cap: float = 2000.0, cap_send: float = 4000.0) -> Column:
    return F.least(net * (rate / (1 + rate)), F.when(has_send, cap_send).otherwise(cap))


def credit_support(df: DataFrame, family: str, order: str, eligible: str, rate: float = 0.85, cap_one: float = 1031.88, cap_more: float = 1768.94) -> DataFrame:
    """Yearly credit of a family, by the month and under its cap, split by the children's costs; the last takes the rest."""
    w = Window.partitionBy(family)
    total, n = F.sum(eligible).over(w), F.count("*").over(w)
    award = numbers.round_half_up(F.least(total / 12 * rate, F.when(n == 1, cap_one).otherwise(cap_more)) * 12)
    own = df.withColumn("award", award).withColumn("_part", numbers.round_half_up(F.when(total > 0, F.col("award") * F.col(eligible) / total).otherwise(0.0))).withColumn("_last", F.row_number().over(w.orderBy(F.desc(order))) == 1)
    others = F.sum(F.when(~F.col("_last"), F.col("_part")).otherwise(0.0)).over(w)
    return own.withColumn("credit", F.round(F.when(F.col("_last"), F.col("award") - others).otherwise(F.col("_part")), 2)).drop("_part", "_last")


def reasons(**tests: Column) -> Column:
    """Names of the tests that fail; none means eligible."""
    return F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())


def work_test(has_partner: Column, user_works: Column, partner_works: Column, user_exempt: Column, partner_exempt: Column) -> Column:
    """All parents work, or one does and the other is exempt."""
    return F.when(~has_partner, user_works).otherwise((user_works & partner_works) | (user_works & partner_exempt) | (partner_works & user_exempt))


def entitlements(children: DataFrame, at: Column) -> DataFrame:
    """One row per child and scheme: eligible and the failed tests, comma-joined.

    Columns: child_id, birth_year, birth_month, has_partner, user_works, partner_works,
    user_exempt, partner_exempt, earns_enough, over_100k, in_england, public_funds, ni_number,
    fostered, disabled, low_income, on_uc, has_send, benefit.
    """
    y, m = F.col("birth_year"), F.col("birth_month")
    age, pre = numbers.age_months(y, m, at), numbers.is_pre_school(y, m, at)
    works = work_test(*(F.col(c) for c in ("has_partner", "user_works", "partner_works", "user_exempt", "partner_exempt")))
    england, c = F.col("in_england"), F.col
    september = lambda years: F.make_date(y + years + (m >= 9).cast("int"), F.lit(9), F.lit(1))
    schemes = {
        "30_hours_working_families": reasons(age=age >= 9, pre_school=pre, work=works, earnings=~works | c("earns_enough"), income=~c("over_100k"), england=england, funds=c("public_funds"), ni=c("ni_number")),
        "15_hours_universal": reasons(age=at >= numbers.next_term_start(y + 3, m), pre_school=pre, england=england),
        "15_hours_2_year_olds": reasons(england=england, age=(at >= numbers.next_term_start(y + 2, m)) & (at < numbers.next_term_start(y + 3, m)), circumstances=c("fostered") | c("disabled") | c("low_income")),
        "tax_free_childcare": reasons(age=at < F.when(c("disabled"), september(16)).otherwise(september(11)), work=works, earnings=~works | c("earns_enough"), income=~c("over_100k"), uc=~c("on_uc"), fostered=~c("fostered")),
        "universal_credit_childcare": reasons(age=at < september(16), uc=c("on_uc"), work=works),
        "wraparound": reasons(school=~pre, age=F.floor(age / 12) <= F.when(c("has_send"), 18).otherwise(14)),
        "breakfast_club": reasons(school=~pre, age=F.floor(age / 12) <= 11),
        "holiday_activities": reasons(school=~pre, age=F.floor(age / 12) <= 16, benefit=c("benefit")),
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), r.alias("failed")) for k, r in schemes.items()))).alias("e")
    return children.select("child_id", each).select("child_id", "e.scheme", (F.size("e.failed") == 0).alias("eligible"), F.array_join("e.failed", ",").alias("failed"))
