"""Data-quality rules: violations as rows, from conditions by rule name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.text import POSTCODE
from placelens.operators import relational


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a condition that is null is not broken."""
    broken = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def opening_hours_rules(open_: Column, close: Column, n_days: Column) -> dict[str, Column]:
    """Hours as decimals: open 5:30 to 17:30, close 7:30 to 19:00, 45 minutes to 12 hours, a day or more."""
    return {"open_range": ~open_.between(5.5, 17.5), "close_range": ~close.between(7.5, 19.0), "duration": ~(close - open_).between(0.75, 12.0), "no_day": n_days < 1}


def care_type_rules(care_type: Column, weeks: Column, min_years: Column, max_years: Column) -> dict[str, Column]:
    return {
        "weeks_range": ~weeks.between(1, 52),
        "holiday_weeks": (care_type == "holiday_club") & (weeks > 17),
        "club_weeks": care_type.isin("breakfast_club", "after_school_club") & (weeks > 40),
        "age_order": min_years > max_years,
        "club_age": care_type.isin("breakfast_club", "after_school_club") & (min_years < 4),
        "nursery_age": care_type.contains("nursery") & (max_years > 5),
    }


def provider_rules(name: Column, postcode: Column, address: Column, city: Column, lat: Column, lon: Column, contacts: list[Column]) -> dict[str, Column]:
    """Rules for places that are open to the public: they must be named, reachable and on the map."""
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    return {
        "name": blank(name),
        "postcode": ~F.coalesce(postcode.rlike(POSTCODE), F.lit(False)),
        "address": blank(address),
        "city_digits": city.rlike(r"\d"),
        "coordinates": ~F.coalesce(lat.between(49.0, 61.0) & lon.between(-9.0, 2.5), F.lit(False)),
        "contact": F.forall(F.array(*contacts), lambda x: blank(x)),
    }


def summary(broken: DataFrame, key: str, samples: int = 3) -> DataFrame:
    """Rules with how often they are broken and the first few keys."""
    return relational.samples(broken, ["rule"], key, samples)


# Shapes, enumerations and limits of a provider's record.
PHONE, EMAIL, AREA_CODE, WEB = "^0[0-9]{9,10}$", r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "^E[0-9]{8}$", "^https?://"
RATINGS, FRAMEWORKS, SCHOOL_FRAMEWORKS = ("Outstanding", "Good", "Requires Improvement", "Inadequate"), ("legacy", "legacy_transition", "report_card"), ("report_card", "legacy_transition")
STALE_DAYS, MOST_PLACES, MOST_PLACES_AT_HOME = 7 * 365, 500, 15


def record_rules(today: Column, same_care: dict[str, str] | None = None) -> dict[str, Column]:
    """Rules of a provider's record: "missing x" for a field that must be there, "x" for one that breaks its rule.

    Columns: institution_type, lad25cd, phone, email, website, fis_url, rating, inspected (ISO text), framework,
    safeguarding_met, places, care_types (array). same_care: kinds of care that count as one, by kind.
    """
    c = F.col
    cares = F.filter(F.coalesce("care_types", F.array().cast("array<string>")), lambda x: x.isNotNull())
    groups = F.create_map(*(F.lit(x) for kv in (same_care or {"": ""}).items() for x in kv))
    grouped = F.transform(cares, lambda x: F.coalesce(F.try_element_at(groups, x), x))
    day = c("inspected").try_cast("date")
    age = F.date_diff(today, day)
    shape = lambda x, pattern: c(x).isNotNull() & ~c(x).rlike(pattern)
    missing = {f"missing {x}": c(x).isNull() for x in ("lad25cd", "rating", "inspected", "framework", "places")}
    own = c("institution_type") == "childminder"
    return missing | {
        "lad25cd": shape("lad25cd", AREA_CODE), "phone": shape("phone", PHONE), "email": shape("email", EMAIL), "website": shape("website", WEB), "fis_url": shape("fis_url", WEB),
        "rating": ~c("rating").isin(*RATINGS), "framework": ~c("framework").isin(*FRAMEWORKS), "inspected_unreadable": c("inspected").isNotNull() & day.isNull(), "inspected_in_future": age < 0, "inspected_long_ago": age > STALE_DAYS,
        "safeguarding_met": c("framework").isin(*SCHOOL_FRAMEWORKS) & c("safeguarding_met").isNull(),
        "places": ~c("places").between(1, MOST_PLACES), "places_at_home": c("places").between(1, MOST_PLACES) & F.array_contains(grouped, "childminder") & (c("places") > MOST_PLACES_AT_HOME),
        "no_care_type": F.coalesce(F.size("care_types"), F.lit(0)) < 1, "repeated_care_type": F.size(grouped) > F.size(F.array_distinct(grouped)),
        "website_is_fis": c("website") == c("fis_url"), "institution_and_care": F.when(own, F.exists(cares, lambda x: x != "childminder")).otherwise(c("institution_type").isNotNull() & F.array_contains(cares, "childminder")),
    }
