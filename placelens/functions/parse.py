"""Free text to structures: ages, weeks, hours, fees."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that tell no age, and what availability means in weeks.
NO_AGE = frozenset(("not available", "-", "no information given", "please see 'additional information' for details", "adults", "16+", "18+", "preschool, adults", "preschool, children", "children"))
AVAILABILITY = {"open all year": 52, "all year": 52, "term time only": 38, "term time": 38, "term time only option": 38}
DAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
#: A quantity of time: years with months that may follow, months alone, or a bare number, which counts as years.
_QUANTITY = r"\d+\s*y[a-z()]*(?:[\s,]*(?:and\s+)?\d+\s*mo?[a-z()]*)?|\d+\s*m[a-z()]*|\d+"


def _in_months(quantity: Column) -> Column:
    """Months of one quantity."""
    number = lambda unit: F.try_to_number(F.nullif(F.regexp_extract(quantity, rf"(\d+)\s*{unit}", 1), F.lit("")), F.lit("99999")).cast("int")
    years = F.when(quantity.rlike(r"^\d+$"), number("$")).otherwise(number("y"))
    return F.coalesce(years, F.lit(0)) * 12 + F.coalesce(number("m"), F.lit(0))


def parse_age_range(raw: Column) -> Column:
    """struct(min_months, min_years, max_years) of a text that names one or two ages.

    The text is read as a list of quantities: the first is the low end and the
    last, where there are several, the high end. "Up to" puts 0 before, "from"
    allows a low end alone. Low ends below a year stay months; other ends are
    whole years. Texts of NO_AGE, and those that name no range, give nulls.
    """
    text = F.lower(F.trim(raw))
    ages = F.transform(F.regexp_extract_all(text, F.lit(f"({_QUANTITY})"), F.lit(1)), _in_months)
    ages = F.when(text.rlike(r"^up\s+to\s"), F.array_prepend(F.slice(ages, 1, 1), F.lit(0))).when(text == "all ages", F.array(F.lit(0), F.lit(18 * 12))).otherwise(ages)
    none = text.isin(*NO_AGE) | (F.size(ages) == 0) | (F.size(ages) == 1) & ~text.rlike(r"^from\s")
    low, high = F.get(ages, F.lit(0)), F.when(F.size(ages) > 1, F.element_at(ages, -1))
    whole = lambda months: F.floor(months / 12).cast("int")
    found = F.struct(F.when(low < 12, low).alias("min_months"), F.when(low >= 12, whole(low)).alias("min_years"), whole(high).alias("max_years"))
    nothing = F.struct(*(F.lit(None).cast("int").alias(c) for c in ("min_months", "min_years", "max_years")))
    return F.when(F.coalesce(none, F.lit(True)), nothing).otherwise(found)


def operating_weeks(availability: Column, text: Column) -> Column:
    """A stated number of weeks beats the keyword."""
    stated = F.regexp_extract(text, r"(?i)for\s+(\d+)\s+weeks", 1)
    keyword = F.lit(None).cast("int")
    for name, weeks in AVAILABILITY.items():
        keyword = F.when(F.lower(F.trim(availability)) == name, weeks).otherwise(keyword)
    return F.coalesce(F.when(stated != "", stated.cast("int")), keyword)


def funded_hours(answers: Column) -> Column:
    """Any yes or funded: true; all no: false; else null."""
    yes = F.exists(answers, lambda x: F.lower(x).rlike("yes|funded"))
    no = F.forall(answers, lambda x: F.lower(F.trim(x)) == "no")
    return F.when(yes, True).when((F.size(answers) > 0) & no, False)


def _clock(raw: str, evening: bool) -> str | None:
    m = re.match(r"\s*(\d{1,2})(?:[:.]?(\d{2}))?\s*(am|pm)?\s*$", raw, re.I)
    if not m:
        return None
    hour, minute, half = int(m[1]), int(m[2] or 0), (m[3] or "").lower()
    if half == "pm" and hour < 12 or not half and evening and hour < 6:
        hour += 12
    if half == "am" and hour == 12:
        hour = 0
    return f"{hour:02d}:{minute:02d}" if hour < 24 and minute < 60 else None


def opening_hours(raw: str | None) -> list[tuple[str, str, str]]:
    """(days as digits 1..7, open, close) of "Mon-Fri 08:00-18:00; Sat 9am to 1pm"."""
    slots: dict[tuple[str, str], set[int]] = {}
    for part in re.split(r"[;\n]", raw or ""):
        m = re.match(r"\s*([A-Za-z ,&\-–]+?)[: ]+(\d[\d:.apm ]*?)\s*(?:-|–|to)\s*(\d[\d:.apm ]*)\s*$", part, re.I)
        if not m:
            continue
        opens, closes = _clock(m[2], False), _clock(m[3], True)
        days: set[int] = set()
        for span in re.split(r"[,&]|\band\b", m[1].lower()):
            names = [DAYS.index(w[:3]) for w in re.findall(r"[a-z]{3,}", span) if w[:3] in DAYS]
            if len(names) == 2 and re.search(r"-|–|\bto\b", span):
                days |= {k % 7 for k in range(names[0], names[1] + 1 + 7 * (names[1] < names[0]))}
            else:
                days |= set(names)
        if opens and closes and days:
            slots.setdefault((opens, closes), set()).update(days)
    return [("".join(str(d + 1) for d in sorted(days)), o, c) for (o, c), days in slots.items()]


def _opening_hours(raw: pd.Series) -> pd.Series:
    return pd.Series([[{"days": d, "open": o, "close": c} for d, o, c in opening_hours(x)] for x in raw])


def parse_opening_hours(raw: Column) -> Column:
    return F.pandas_udf(_opening_hours, "array<struct<days:string,open:string,close:string>>")(raw)


# Ages that a fee line names, by pattern, first match first.
FEE_BANDS = ((r"under\s*2|baby|babies|0\s*-\s*2", "under2"), (r"\b2\s*year|age\s*2\b", "age2"), (r"3\s*(?:-|to|and|/)\s*4|3\s*year", "age3to4"), (r"5\s*\+|over\s*5|school\s*age", "age5plus"))
FEE_PERIODS = ((r"hour", "per_hour"), (r"half\s*day|morning|\bam\b", "morning_session"), (r"afternoon|\bpm\b", "afternoon_session"), (r"full\s*day", "full_day"), (r"session", "per_session"), (r"\bday\b|daily", "per_day"))


def parse_fees(raw: Column) -> Column:
    """array<struct(age_band, period, amount)> of lines with an amount and a period; the first amount for a pair wins."""
    first = lambda line, table, rest: F.coalesce(*(F.when(line.rlike(f"(?i){p}"), F.lit(name)) for p, name in table), rest)

    def one(line: Column) -> Column:
        amount = F.nullif(F.regexp_extract(line, r"£\s*(\d+(?:\.\d{1,2})?)", 1), F.lit("")).cast("double")
        return F.struct(first(line, FEE_BANDS, F.lit("all")).alias("age_band"), first(line, FEE_PERIODS, F.lit(None)).alias("period"), amount.alias("amount"))

    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), r"[;\n]"), one), lambda x: x["amount"].isNotNull() & x["period"].isNotNull())
    same = lambda x, y: (x["age_band"] == y["age_band"]) & (x["period"] == y["period"])
    return F.filter(lines, lambda x, i: ~F.exists(F.slice(lines, 1, i), lambda y: same(x, y)))
