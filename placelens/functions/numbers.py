"""Rounding, ages, terms, and the half-open arithmetic around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, places: int = 2) -> Column:
    """floor(x + 0.5) at the given place; 0.5 goes up, for negatives too."""
    return F.floor(c * 10**places + 0.5) / 10**places


def exact_sum(x: Column) -> Column:
    """An aggregate: the sum of doubles rounded once, so that it depends on no order of rows; up to 2^42 in size, and by steps of 2^-59."""
    whole = F.floor(x * 2.0**20)
    high, low = F.sum(whole), F.sum(F.floor((x * 2.0**20 - whole) * 2.0**39))
    carry = F.shiftright(low, 39)
    return (high + carry).cast("double") / 2.0**20 + (low - F.shiftleft(carry, 39)).cast("double") / 2.0**59


def round_to_ten(c: Column) -> Column:
    return F.floor(c / 10 + 0.5) * 10


def round_half_even(c: Column, places: int = 2) -> Column:
    return F.bround(c, places)


def age_months(birth_year: Column, birth_month: Column, at: Column) -> Column:
    return (F.year(at) - birth_year) * 12 + F.month(at) - birth_month


def age_years(birth_year: Column, birth_month: Column, at: Column) -> Column:
    return F.floor(age_months(birth_year, birth_month, at) / 12).cast("int")


def next_term_start(year: Column, month: Column) -> Column:
    """1 January, April or September, whichever comes next after the month."""
    return F.when(month >= 9, F.make_date(year + 1, F.lit(1), F.lit(1))).when(month >= 4, F.make_date(year, F.lit(9), F.lit(1))).otherwise(F.make_date(year, F.lit(4), F.lit(1)))


def is_pre_school(birth_year: Column, birth_month: Column, at: Column) -> Column:
    """Under four, or before the September in which school starts."""
    start = F.make_date(birth_year + 4 + (birth_month >= 9).cast("int"), F.lit(9), F.lit(1))
    return (age_months(birth_year, birth_month, at) < 48) | (at < start)


def decimal_hours(c: Column) -> Column:
    """HH:mm as hours."""
    part = F.split(c, ":")
    return F.try_element_at(part, F.lit(1)).cast("double") + F.try_element_at(part, F.lit(2)).cast("double") / 60


def days_bitmask(days: Column) -> Column:
    """Digits 1..7 as bits."""
    return F.aggregate(F.filter(F.split(days, ""), lambda d: d != ""), F.lit(0), lambda acc, d: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), d.cast("int") - 1)))


def annual_income(amount: Column, period: Column) -> Column:
    return amount * F.when(period == "week", 52).when(period == "month", 12).when(period == "quarter", 4).otherwise(1)


def hourly_threshold(hourly: Column, period: Column) -> Column:
    """Sixteen hours a week at the hourly rate, by week, month, quarter or year."""
    week = hourly * 16
    return F.when(period == "week", week).when(period == "month", week * 52 / 12).when(period == "quarter", week * 13).otherwise(week * 52)
