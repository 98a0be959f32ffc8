"""Relational operators: choosing rows, merging, checking and nesting. Each maps DataFrames to a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given, which should end in a column without ties."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each key. The rank alone is tested, so that each task cuts its rows to k a key before they move."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """k rows of each key with rank, and whether there were more. One row more than k is kept to tell."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= k + 1)
    return ranked.withColumn("overflow", F.max("rank").over(w) > k).where(F.col("rank") <= k)


def samples(df: DataFrame, keys: list[str], value: str, k: int, distinct: bool = True) -> DataFrame:
    """keys, n (rows) and sample: the k least (distinct) values as strings, comma-joined. Each task sends k values of a key at most."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    least = df.select(*keys, value).where(F.col(value).isNotNull())
    least = least.distinct() if distinct else least
    few = first_k(least, keys, [F.col(value)], k).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(value)), lambda x: x.cast("string")), ",").alias("sample"))
    return n.join(few, keys, "left").withColumn("sample", F.coalesce("sample", F.lit("")))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Last wins: a key's greatest row of changes replaces its row of base."""
    last = distinct_on(changes, keys, [order.desc()])
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First wins: rows of new come in only for keys that base lacks."""
    return base.unionByName(distinct_on(new, keys, [order.asc()]).join(base.select(*keys), keys, "left_anti"))


def update_from(base: DataFrame, other: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """column takes other's value where the key matches and the value is there; of several values the greatest."""
    values = other.groupBy(*keys).agg(F.max(value).alias("_v"))
    return base.join(values, keys, "left").withColumn(column, F.coalesce("_v", column)).drop("_v").select(base.columns)


def delete_siblings(df: DataFrame, keys: list[str], marker: Column) -> DataFrame:
    """Where a key has a marked row, its other rows go."""
    has = F.max(marker.cast("int")).over(Window.partitionBy(*keys))
    return df.withColumn("_has", has).where((F.col("_has") == 0) | marker).drop("_has")


def rollup_counts(df: DataFrame, key: str, label: str = "--TOTAL--") -> DataFrame:
    """Counts by key and in total; a null key shares the total's label."""
    return df.rollup(key).agg(F.count("*").alias("n")).select(F.coalesce(F.col(key), F.lit(label)).alias(key), "n")


def rollup_marked(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts on every level with grouping_id, which tells a null key from a total."""
    return df.rollup(*keys).agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


def count_filters(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in conditions.items()))


def richest_first(df: DataFrame, keys: list[str], fields: list[str], tie: str) -> DataFrame:
    """The row of each key with the most fields set."""
    richness = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    return distinct_on(df.withColumn("richness", richness), keys, [F.desc("richness"), F.asc(tie)])


def resolve_by_priority(df: DataFrame, key: str, rank: str, source: str, fields: list[str]) -> DataFrame:
    """Each field's value and source from the least rank that has it."""
    aggs = []
    for f in fields:
        best = F.min(F.when(F.col(f).isNotNull(), F.struct(F.col(rank), F.col(f), F.col(source))))
        aggs += [best[f].alias(f), best[source].alias(f"{f}_source")]
    return df.groupBy(key).agg(*aggs)


def coalesce_with_source(**candidates: list[tuple[str, Column]]) -> list[Column]:
    """Columns name and name_source: the first candidate that is there."""
    out = []
    for name, options in candidates.items():
        picked = F.coalesce(*(F.when(c.isNotNull(), F.struct(c.alias("v"), F.lit(s).alias("s"))) for s, c in options))
        out += [picked["v"].alias(name), picked["s"].alias(f"{name}_source")]
    return out


def set_check(left: DataFrame, right: DataFrame, keys: list[str], name: str, samples: int = 10) -> DataFrame:
    """One row: keys of left that right lacks, PASS or FAIL, and the first few in order."""
    missing = left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti")
    first = missing.orderBy(*keys).limit(samples).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", *keys))), ",").alias("sample"))
    return missing.agg(F.count("*").alias("n_missing")).crossJoin(first).select(F.lit(name).alias("check"), "n_missing", F.when(F.col("n_missing") == 0, "PASS").otherwise("FAIL").alias("status"), "sample")


def paginate(df: DataFrame, order: list[Column], page: int, size: int = 50) -> DataFrame:
    """A page of the ordered rows; the page is clamped to the last one."""
    return df.orderBy(*order).offset(max(0, min(page, max(0, -(-df.count() // size) - 1))) * size).limit(size)


def shared_values(df: DataFrame, key: str, value: str, limit: int) -> DataFrame:
    """Rows whose value is used by more than `limit` rows; summed by value first, so that a hot value moves once."""
    often = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("uses")).where(F.col("uses") > limit)
    return df.join(often, value).select(key, value, "uses")


def coverage(totals: DataFrame, failures: DataFrame, key: str, field: str, fields: list[str]) -> DataFrame:
    """present = total - missing for every key of totals(key, total) and every field, and the share in per cent to one decimal.

    A key and field without a failure is wholly present; keys with a total of 0 are left out.
    """
    missing = failures.groupBy(key, field).agg(F.count("*").alias("missing"))
    every = totals.where("total > 0").withColumn(field, F.explode(F.array(*map(F.lit, fields))))
    present = F.col("total") - F.coalesce("missing", F.lit(0))
    return every.join(missing, [key, field], "left").select(key, field, present.alias("present"), F.round(100.0 * present / F.col("total"), 1).alias("pct"))


def share_of_total(df: DataFrame, by: str) -> DataFrame:
    counted = df.groupBy(by).agg(F.count("*").alias("n"))
    return counted.crossJoin(counted.agg(F.sum("n").alias("total"))).select(by, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("pct"))


def pool_depletion(df: DataFrame, key: str, order: list[str], demand: str, pool: Column) -> DataFrame:
    """Each row in turn takes what it needs from what is left of the pool."""
    before = F.coalesce(F.sum(demand).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("used", F.least(F.col(demand), F.greatest(F.lit(0.0), pool - before)))


def allocate_with_remainder(df: DataFrame, key: str, order: list[str], weight: str, total: Column, places: int = 2) -> DataFrame:
    """total in proportion to weight, rounded half up; the last row takes what rounding leaves."""
    w = Window.partitionBy(key)
    part = F.floor(total * F.col(weight) / F.sum(weight).over(w) * 10**places + 0.5) / 10**places
    parted = df.withColumn("_part", part).withColumn("_last", F.row_number().over(w.orderBy(*map(F.desc, order))) == 1)
    others = F.sum(F.when(~F.col("_last"), F.col("_part")).otherwise(0.0)).over(w)
    return parted.withColumn("share", F.round(F.when(F.col("_last"), total - others).otherwise(F.col("_part")), places)).drop("_part", "_last")


def first_transition(df: DataFrame, key: str, step: str, state: str) -> DataFrame:
    """The earliest step at which the state differs from that of step 0, and what it then is."""
    base = df.where(F.col(step) == 0).select(key, F.col(state).alias("_base"))
    changed = df.join(base, key).where(~F.col(state).eqNullSafe(F.col("_base")))
    return changed.groupBy(key).agg(F.min(step).alias("at"), F.min_by(state, step).alias("becomes"))
