"""Reports over checked tables: cross-filters, scores, trends, folds and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the label of rows without an area.
NO_AREA = "(no LA)"


def cross_filter(df: DataFrame, chosen: dict[str, list[str]], present: tuple[DataFrame, list[str]] | None = None, absent: tuple[DataFrame, list[str]] | None = None) -> DataFrame:
    """Rows whose columns are among the values chosen; NO_AREA stands for null. present and absent: tables with keys that must or must not hold the row."""
    for column, values in chosen.items():
        df = df.where(F.coalesce(F.col(column).cast("string"), F.lit(NO_AREA)).isin(values))
    if present:
        df = df.join(present[0], present[1], "left_semi")
    return df.join(absent[0], absent[1], "left_anti") if absent else df


def text_filter(df: DataFrame, needle: str, columns: list[str], children: DataFrame, key: str, child_columns: list[str]) -> DataFrame:
    """Rows that hold needle, taken literally and in either case, in a column or in a child's column."""
    holds = lambda cs: F.greatest(*(F.coalesce(F.lower(F.col(c).cast("string")).contains(needle.lower()), F.lit(False)) for c in cs), F.lit(False))
    found = children.where(holds(child_columns)).select(key).distinct().withColumn("_child", F.lit(True))
    return df.join(found, key, "left").where(holds(columns) | F.col("_child").isNotNull()).drop("_child")


def missing_boxes(areas: DataFrame, in_view: DataFrame, key: str) -> DataFrame:
    """Per area how many of its box-only providers, areas(key, box_only), have no box in view; never below 0."""
    seen = in_view.groupBy(key).agg(F.count("*").alias("_seen"))
    total = areas.groupBy(key).agg(F.sum("box_only").alias("_total"))
    return total.join(seen, key, "left").select(key, F.greatest(F.lit(0), F.col("_total") - F.coalesce("_seen", F.lit(0))).cast("long").alias("missing"))


def score(df: DataFrame, by: str, rates: list[str]) -> DataFrame:
    """Mean of the rates' averages by version or region; null if one is missing."""
    means = df.groupBy(by).agg(*(F.avg(r).alias(r) for r in rates))
    total = sum((F.col(r) for r in rates), F.lit(0.0))
    return means.select(by, F.round(total / len(rates), 2).alias("score"))


def trend(df: DataFrame, row: str, version: str, rate: Column, versions: list) -> DataFrame:
    """The rate of each row's checks, in per cent to one decimal, with a column for each version."""
    return df.groupBy(row).pivot(version, versions).agg(F.round(100.0 * rate, 1))


def denominators(df: DataFrame, by: str, count: str, pct: str) -> DataFrame:
    """Totals told from counts and their percentages; rows of 0 % tell nothing."""
    return df.where(F.col(pct) > 0).groupBy(by).agg(F.sum(F.floor(F.col(count) * 100.0 / F.col(pct) + 0.5)).cast("long").alias("total"))


def colocated(df: DataFrame, lat: str, lon: str, flag: str, low: str, high: str) -> DataFrame:
    """One row per place: how many rows, whether any is flagged, and the range of their values."""
    return df.groupBy(lat, lon).agg(F.count("*").alias("n"), F.bool_or(F.col(flag)).alias(flag), F.min(low).alias(low), F.max(high).alias(high))


def last_of_order(column: str, last: str) -> list[Column]:
    """An order by a column with one value last."""
    return [(F.col(column) == last).asc(), F.col(column).asc()]


def ranked_categories(column: str, order: list[str]) -> Column:
    """Place of a category in a stated order; others come after."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def subset_checks(checks: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(check, n_missing, status) for tables of one key column each: every key of the first must be in the second."""
    out = None
    for name, part, whole in checks:
        own = part.toDF("k").distinct().join(whole.toDF("k").distinct(), "k", "left_anti").agg(F.count("*").alias("n_missing"))
        own = own.select(F.lit(name).alias("check"), "n_missing", F.when(F.col("n_missing") == 0, "PASS").otherwise("FAIL").alias("status"))
        out = own if out is None else out.unionByName(own)
    return out


def invalid_steps(steps: dict[str, Column]) -> Column:
    """Names of form steps whose condition does not hold, in order; null does not hold."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in steps.items())), lambda x: x.isNotNull())


def available_types(months: Column) -> Column:
    """Kinds of care that a child of this age may use."""
    kinds = {"childminder": F.lit(True), "private_nursery": months < 60, "school_based_nursery": months.between(24, 59), "breakfast_club": months >= 48, "after_school_club": months >= 48}
    return F.filter(F.array(*(F.when(ok, F.lit(n)) for n, ok in kinds.items())), lambda x: x.isNotNull())


def area_documents(df: DataFrame, area: str, age_group: str, provider_group: str, cost: str) -> DataFrame:
    """(area, doc): JSON of mean costs, rounded to pence, by age group and group of providers."""
    cells = df.groupBy(area, age_group, provider_group).agg(F.round(F.avg(cost), 2).alias("cost"))
    rows = cells.groupBy(area, age_group).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(provider_group, "cost"))))).alias("costs"))
    named = F.transform(F.array_sort(F.collect_list(F.struct(age_group, "costs"))), lambda x: F.concat_ws(":", F.regexp_replace(F.to_json(F.array(x[age_group])), r"^\[|\]$", ""), x["costs"]))
    return rows.groupBy(area).agg(F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}")).alias("doc"))


def household_totals(df: DataFrame, family: str, child: str, gross: str, support: str) -> DataFrame:
    """Gross, support and net per child and, with a null child, per family."""
    sums = df.groupBy(family, child).agg(F.sum(gross).alias("gross"), F.sum(support).alias("support"))
    whole = sums.groupBy(family).agg(F.sum("gross").alias("gross"), F.sum("support").alias("support")).withColumn(child, F.lit(None).cast(df.schema[child].dataType))
    both = sums.unionByName(whole.select(*sums.columns))
    return both.select(family, child, *(F.round(c, 2).alias(c) for c in ("gross", "support")), F.round(F.greatest(F.col("gross") - F.col("support"), F.lit(0.0)), 2).alias("net"))


def fee_rows(df: DataFrame, key: str, fees: str, bands: list[str]) -> DataFrame:
    """(key, band, period, amount) of a JSON object: one band "all" if it has amounts itself, else each known band's amounts."""
    flat = F.from_json(F.col(fees), "map<string,double>", {"mode": "PERMISSIVE"})
    banded = F.from_json(F.col(fees), "map<string,map<string,double>>")
    pick = lambda b: F.transform(F.map_entries(F.coalesce(F.try_element_at(banded, F.lit(b)), F.create_map().cast("map<string,double>"))), lambda e: F.struct(F.lit(b).alias("band"), e["key"].alias("period"), e["value"].alias("amount")))
    own = F.filter(F.transform(F.map_entries(flat), lambda e: F.struct(F.lit("all").alias("band"), e["key"].alias("period"), e["value"].alias("amount"))), lambda x: x["amount"].isNotNull())
    rows = F.when(F.size(own) > 0, own).otherwise(F.flatten(F.array(*map(pick, bands))))
    return df.select(key, F.explode(rows).alias("r")).select(key, "r.*").where("amount is not null")
