"""Where fields come from, validation of records, map features, fee lines, forms, labels and support for parents who study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens.operators import relational

#: Hourly minimum wages by age bracket; apprentices get the youngest bracket's.
WAGES = {"21+": 12.71, "18-20": 10.85, "16-17": 8.0}
APPRENTICE = "16-17"


def field_sources(records: DataFrame, values: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(field, source, count, pct): how many of all records have a field from which source; those without it are 'absent'.

    values(key, field, source, order) holds fields that have a value; a record's
    first source in order counts. pct is of all records, to one decimal.
    """
    first = values.join(records.select(key), key, "left_semi").groupBy(key, "field").agg(F.min_by("source", order).alias("source"))
    counts = first.groupBy("field", "source").agg(F.count("*").alias("count"))
    total = records.agg(F.count("*").alias("total")).select(F.explode(F.array(*map(F.lit, fields))).alias("field"), "total")
    present = counts.groupBy("field").agg(F.sum("count").alias("present"))
    absent = total.join(present, "field", "left").withColumn("count", F.col("total") - F.coalesce("present", F.lit(0))).where("count > 0")
    rows = counts.join(total, "field").unionByName(absent.select("field", F.lit("absent").alias("source"), "count", "total"))
    return rows.select("field", "source", "count", F.round(100 * F.col("count") / F.col("total"), 1).alias("pct"))


def field_checks(path: str, required: bool = False, low: float | None = None, high: float | None = None, allowed: list[str] | None = None) -> list[tuple[str, str, Column]]:
    """(path, code, condition that breaks it) of one field."""
    x, found = F.col(path), []
    if required:
        found.append((path, "invalid_type", x.isNull()))
    if low is not None:
        found.append((path, "too_small", x < low))
    if high is not None:
        found.append((path, "too_big", x > high))
    if allowed is not None:
        found.append((path, "invalid_value", ~x.isin(allowed)))
    return found


def pair_check(low: str, high: str) -> tuple[str, str, Column]:
    """The two ends of a range come in order."""
    return (low, "custom", F.col(low) > F.col(high))


def issues(rows: DataFrame, key: str, checks: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, path, code) of each check that a row breaks; a condition that is null is not broken."""
    broken = F.array(*(F.when(F.coalesce(x, F.lit(False)), F.struct(F.lit(p).alias("path"), F.lit(c).alias("code"))) for p, c, x in checks))
    return rows.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def issue_summary(found: DataFrame, key: str, samples: int = 10) -> DataFrame:
    """(path, code, n, sample): how often, and the least `samples` keys; a report's samples, not a cap on counts."""
    return relational.samples(found, ["path", "code"], key, samples, distinct=False)


def validated(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """rows with pass and the errors as sorted path:code, comma-joined."""
    errors = found.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "code"))), ",").alias("errors"))
    return rows.join(errors, key, "left").withColumn("pass", F.col("errors").isNull())


def map_features(care: DataFrame, places: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """One feature per place: records there, the union of their care bits, their widest age range, whether any is funded.

    care(key, bit, low, high, funded) has a row per care type; records without care keep mask 0.
    """
    each = care.groupBy(key).agg(F.bit_or("bit").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("funded").alias("funded"))
    sums = [F.count("*").alias("n"), F.min(key).alias("first"), F.bit_or(F.coalesce("mask", F.lit(0))).alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.coalesce("funded", F.lit(False))).alias("funded")]
    return places.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).join(each, key, "left").groupBy(lat, lon).agg(*sums)


def _pounds(c: Column) -> Column:
    return F.format_string("£%.2f", c.cast("double"))


def fee_lines(band: Column, hour: Column, morning: Column, afternoon: Column, day: Column, session: Column, daily: Column) -> Column:
    """Lines (label, value) of one row of fees; without a band they are flat. An afternoon that costs as much as the morning is left out."""
    line = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    of = lambda what: F.concat(band, F.lit(what))
    flat = F.array(
        F.when(hour > 0, line(F.lit("Per hour"), _pounds(hour))),
        F.when(session > 0, line(F.lit("Per session"), _pounds(session))).when(session == 0, line(F.lit("Per session"), F.lit("Free"))),
        F.when(daily > 0, line(F.lit("Per day"), _pounds(daily))),
    )
    banded = F.array(
        F.when(hour.isNotNull(), line(of(""), F.concat(_pounds(hour), F.lit(" per hour")))),
        F.when(morning.isNotNull(), line(of(" AM"), _pounds(morning))),
        F.when(afternoon.isNotNull() & ~afternoon.eqNullSafe(morning), line(of(" PM"), _pounds(afternoon))),
        F.when(day.isNotNull(), line(of(" full day"), _pounds(day))),
        F.when(session.isNotNull(), line(of(""), F.concat(_pounds(session), F.lit(" per session")))),
        F.when(daily.isNotNull(), line(of(""), F.concat(_pounds(daily), F.lit(" per day")))),
    )
    return F.filter(F.when(band.isNull(), flat).otherwise(banded), lambda x: x.isNotNull())


def resolved_form(df: DataFrame) -> DataFrame:
    """Forms with defaults: savings and income limits count only where every parent has no recourse to public funds, the credit limit only with the credit."""
    none = lambda c: F.coalesce(F.col(c) == "no_recourse_to_public_funds", F.lit(False))
    every = none("residency") & (F.col("partner_residency").isNull() | none("partner_residency"))
    benefits = F.coalesce("benefits", F.array().cast("array<string>"))
    return df.withColumns({
        "benefits": benefits,
        "income_under": F.when(every, F.coalesce("income_under", F.lit(0))).otherwise(0),
        "savings_under": F.when(every, F.coalesce("savings_under", F.lit(0))).otherwise(0),
        "credit_below": F.array_contains(benefits, "universal_credit") & F.coalesce("credit_below", F.lit(False)),
    })


def named_children(df: DataFrame, family: str, order: str, name: str) -> DataFrame:
    """Blank names become 'Child n', n from one in the family's order."""
    n = F.row_number().over(Window.partitionBy(family).orderBy(order))
    return df.withColumn("_n", n).withColumn(name, F.coalesce(F.when(F.trim(name) != "", F.trim(name)), F.concat(F.lit("Child "), "_n"))).drop("_n")


def study_support(parents: DataFrame, family: str, order: str) -> DataFrame:
    """Per family, which support a parent's study opens: care to learn, learner support, childcare grant (before the child's age).

    parents: family, order, bracket, studying, level, apprentice, funded, full_time,
    finance, resident, in_england. The first parent in order who fits is judged.
    """
    c = F.col
    young = c("bracket").isin("16-17", "18-20") & c("level").isin("school_sixth_form", "further_education") & ~c("apprentice")
    older = c("bracket").isin("18-20", "21+") & (c("level") == "further_education")
    higher = (c("level") == "higher_education") & c("full_time") & c("finance")
    learns = F.when(c("studying") & young, c(order))
    found = parents.groupBy(family).agg(
        F.min_by(c("funded") & c("resident"), learns).alias("care_to_learn"),
        F.bool_or(c("studying") & older).alias("learner_support"),
        F.bool_or(c("studying") & higher).alias("childcare_grant"),
        F.bool_or("in_england").alias("england"),
    )
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    return found.select(family, (yes("care_to_learn") & yes("england")).alias("care_to_learn"), yes("learner_support").alias("learner_support"), (yes("childcare_grant") & yes("england")).alias("childcare_grant"))


def grant_age(age_years: Column, special_needs: Column) -> Column:
    """Under 15, or under 17 with special needs."""
    return age_years < F.when(special_needs, 17).otherwise(15)


def minimum_wage(bracket: Column, apprentice: Column, period: Column, hours: int = 16, wages: dict[str, float] = WAGES) -> Column:
    """What `hours` a week at the minimum wage earn in a week, month, quarter or year, to pence."""
    of = F.when(apprentice, APPRENTICE).otherwise(bracket)
    week = F.element_at(F.create_map(*(F.lit(x) for kv in wages.items() for x in kv)), of) * hours
    return F.round(F.when(period == "week", week).when(period == "month", week * 52 / 12).when(period == "quarter", week * 13).when(period == "year", week * 52), 2)


def layer_label(layer: Column, name: Column, labels: dict[int, str], mixed: dict[int, str], gate: str) -> Column:
    """A layer's label; in a mixed layer only for names that pass the gate, else the layer's fallback."""
    found = F.lit(None).cast("string")
    for k, label in labels.items():
        own = F.lit(label)
        if k in mixed:
            own = F.when(F.coalesce(name, F.lit("")).rlike(gate), own).otherwise(mixed[k])
        found = F.when(layer == k, own).otherwise(found)
    return found


def report_status(name: Column, postcode: Column) -> Column:
    """success with a name and a postcode, partial with one of them, else not_published; blank is none."""
    has = lambda x: F.coalesce(F.trim(x) != "", F.lit(False))
    return F.when(has(name) & has(postcode), "success").when(has(name) | has(postcode), "partial").otherwise("not_published")


def indexed_features(features: DataFrame, index: DataFrame, key: str, code: str, pattern: str = "^[ESNW][0-9]{8}$") -> DataFrame:
    """Features with what the index has of them, where the code fits the pattern."""
    return features.where(F.col(code).rlike(pattern)).join(index, key)


def boundary_checks(features: DataFrame, code: str, name: str, geometry: str) -> DataFrame:
    """(check, status, n, sample): there are features; each has a code, a name and a geometry. WARN where not; the five least codes as a sample."""
    bad = F.coalesce(F.trim(code) == "", F.lit(True)) | F.coalesce(F.trim(name) == "", F.lit(True)) | F.col(geometry).isNull()
    label = F.when(F.coalesce(F.trim(code) != "", F.lit(False)), F.col(code)).otherwise("unknown")
    broken = features.where(bad).select(label.alias("code")).distinct()
    few = F.array_join(F.slice(F.array_sort(F.collect_list("code")), 1, 5), ",")
    ranked = broken.orderBy("code").limit(5).agg(few.alias("sample"))
    some = features.agg(F.when(F.count("*") > 0, 0).otherwise(1).cast("long").alias("n")).select(F.lit("non_empty").alias("check"), "n", F.lit("").alias("sample"))
    whole = broken.agg(F.count("*").alias("n")).select(F.lit("complete").alias("check"), "n").join(ranked.withColumn("check", F.lit("complete")), "check")
    return some.unionByName(whole).withColumn("status", F.when(F.col("n") == 0, "PASS").otherwise("WARN"))


def triaged(label: Column, value: Column) -> Column:
    """(kind, text) of a strong label and what follows it: an amount is a fee, '- place' a school, all else stays a pair."""
    fee = label.rlike(r"^\s*£\s*[0-9]")
    place = value.rlike("^[-–] ")
    both = F.concat_ws(" ", label, value)
    text = F.when(fee, F.trim(F.regexp_replace(both, ":+$", ""))).when(place, F.trim(both)).otherwise(value)
    return F.struct(F.when(fee, "fee").when(place, "school").otherwise("pair").alias("kind"), text.alias("text"))
