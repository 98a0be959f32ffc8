"""Household costs: gross fees by care type, charges by the year, funded savings and totals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM_WEEKS = 38
CLUBS = ("breakfast_club", "after_school_club")
NURSERIES = ("private_nursery", "school_based_nursery")


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def gross_fee(care_type: Column, days: dict[str, Column], fees: dict[str, Column], hours_per_week: Column, days_per_week: Column, days_per_year: Column, weeks: Column) -> Column:
    """struct(total, weekly_hours, hourly): nursery sessions, childminder hours, club days in term, holiday days.

    days and fees have morning, afternoon and full_day; fees also per_hour, per_session and per_day.
    A morning or afternoon has 5 hours, a full day 10.
    """
    weekly = sum((_zero(days[s]) * _zero(fees[s]) for s in ("morning", "afternoon", "full_day")), F.lit(0.0))
    hours = _zero(days["morning"]) * 5 + _zero(days["afternoon"]) * 5 + _zero(days["full_day"]) * 10
    cost = lambda total, h, rate: F.struct(total.cast("double").alias("total"), h.cast("double").alias("weekly_hours"), rate.cast("double").alias("hourly"))
    nursery = cost(weekly * weeks, hours, F.when(hours > 0, weekly / hours).otherwise(0.0))
    minder = cost(_zero(hours_per_week) * _zero(fees["per_hour"]) * weeks, _zero(hours_per_week), _zero(fees["per_hour"]))
    club = cost(_zero(days_per_week) * _zero(fees["per_session"]) * TERM_WEEKS, _zero(days_per_week), _zero(fees["per_session"]))
    holiday = cost(_zero(days_per_year) * _zero(fees["per_day"]), F.lit(0.0), F.lit(0.0))
    nothing = cost(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.when(care_type.isin(*NURSERIES), nursery).when(care_type == "childminder", minder).when(care_type.isin(*CLUBS), club).when(care_type == "holiday_club", holiday).otherwise(nothing)


def attendance_days(care_type: Column, sessions: list[Column], hours_per_week: Column, days_per_week: Column, days_per_year: Column, weeks: Column) -> Column:
    """Days a year; a childminder's unstated days are hours over six, rounded up, five at most."""
    estimated = F.least(F.lit(5), F.ceil(hours_per_week / 6))
    minder = F.coalesce(F.when(days_per_week > 0, days_per_week), estimated, F.lit(0)) * weeks
    most = F.greatest(*sessions) if len(sessions) > 1 else sessions[0]
    by_week = F.coalesce(days_per_week, F.lit(0)) * F.when(care_type.isin(*CLUBS, "free_breakfast_club"), TERM_WEEKS).otherwise(weeks)
    return F.when(care_type == "holiday_club", F.coalesce(days_per_year, F.lit(0))).when(care_type == "childminder", minder).when(most.isNotNull(), most * weeks).otherwise(by_week)


def yearly_charge(cost: Column, unit: Column, days: Column, weeks: Column, sessions: Column) -> Column:
    return F.when(unit == "per day", cost * days).when(unit == "per week", cost * weeks).when(unit == "per session", cost * sessions).otherwise(0.0)


def funded_saving(used: Column, hourly: Column, weeks: Column) -> Column:
    """Weekly hours used at the effective rate, in term weeks at most."""
    return used * hourly * F.least(F.lit(TERM_WEEKS), weeks)


def monthly_display(hourly_low: Column, hourly_high: Column) -> Column:
    """Ten hours, five days and 4.33 weeks; a range shrinks to one value when its ends are less than a penny apart."""
    low, high = (F.round(x * 10 * 5 * 4.33, 2) for x in (hourly_low, hourly_high))
    return F.when(F.abs(high - low) < 0.01, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))
