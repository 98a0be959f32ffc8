"""Which column of an unknown table is which: profiles of all columns, scored by names and by how far values fit a pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A row per column: rows, filled, distinct (approximate) and, for each pattern, the share of filled values that fit it. One pass."""
    text = {k: F.col(f"`{k}`").cast("string") for k in df.columns}
    filled = {k: F.when(F.trim(v) != "", v) for k, v in text.items()}
    fits = lambda v: [F.count_if(F.coalesce(v.rlike(p), F.lit(False))).alias(n) for n, p in patterns.items()]
    one = df.agg(*(F.struct(F.lit(k).alias("column"), F.lit(i).alias("place"), F.count("*").alias("rows"), F.count(v).alias("filled"), F.approx_count_distinct(v).alias("distinct"), F.struct(*fits(v)).alias("fit")).alias(f"c{i}") for i, (k, v) in enumerate(filled.items())))
    each = one.select(F.explode(F.array(*(f"c{i}" for i in range(len(filled))))).alias("c")).select("c.*")
    return each.select("column", "place", "rows", "filled", "distinct", *((F.col(f"fit.{n}") / F.nullif("filled", F.lit(0))).alias(n) for n in patterns))


def choose(profiles: DataFrame, roles: dict[str, tuple[list[str], str | None]], least: float = 0.5) -> DataFrame:
    """(role, column, score): for each role the column with the best score of least or more; of equals the first in the table.

    roles: names that the column may have (lower case, the best first) and the pattern that its values fit, or None.
    A name counts 2 less a little for each name before it, a fit what its share is, so that a known name with
    fitting values beats both alone, and a column without a known name still serves if its values fit.
    """
    options = []
    for role, (names, pattern) in roles.items():
        by_name = F.coalesce(*(F.when(F.lower("column") == n, 2.0 - k / 100) for k, n in enumerate(names)), F.lit(0.0)) if names else F.lit(0.0)
        score = by_name + (F.coalesce(F.col(pattern), F.lit(0.0)) if pattern else F.lit(0.0))
        options.append(F.struct(F.lit(role).alias("role"), F.round(score, 4).alias("score")))
    each = profiles.select("column", "place", F.explode(F.array(*options)).alias("o")).select("column", "place", "o.*").where(F.col("score") >= least)
    return each.groupBy("role").agg(F.min(F.struct((-F.col("score")).alias("less"), "place", "column")).alias("b")).select("role", F.col("b.column").alias("column"), (-F.col("b.less")).alias("score"))


def find_layer(layers: DataFrame, hints: list[str]) -> DataFrame:
    """Of layers (place, table_name, geometry_column) the first by place whose name has the earliest hint, else the first; layers without geometry don't count."""
    hint = F.coalesce(*(F.when(F.lower("table_name").contains(h.lower()), k) for k, h in enumerate(hints)), F.lit(len(hints)))
    own = layers.where("geometry_column is not null")
    return own.agg(F.min(F.struct(hint.alias("hint"), "place", "table_name", "geometry_column")).alias("b")).where("b is not null").select("b.table_name", "b.geometry_column")
