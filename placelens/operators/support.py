"""Government support of a family and the range of its costs.

A family has either Tax-Free Childcare, by child, or Universal Credit, by
family and shared among its children, never both. Fees come in three variants;
each is a scenario of its own, all in one pass. Sums are made per family and
joined back, so that no task needs all rows of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.functions.numbers import exact_sum, round_half_up

VARIANTS = ("lower", "mean", "upper")
# Top-up and caps a year, share and caps a month.
TOP_UP, CAP, CAP_DISABLED = 0.25, 2000.0, 4000.0
SHARE, CAP_ONE, CAP_MORE = 0.85, 1031.88, 1768.94


def scenarios(children: DataFrame) -> DataFrame:
    """A row per child and variant: fees and saved (funded hours) from fees_<variant>, saved_<variant>."""
    each = F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"fees_{v}").alias("fees"), F.col(f"saved_{v}").alias("saved")) for v in VARIANTS))
    rest = [k for k in children.columns if not k.startswith(("fees_", "saved_"))]
    return children.select(*rest, F.explode(each).alias("s")).select(*rest, "s.*")


def by_child(children: DataFrame, choose: Column | None = None) -> DataFrame:
    """scenarios with tfc and uc of each child, one of them 0, and kind, which of them the family has.

    children: family, child, tfc_eligible, uc_eligible, disabled, on_uc, charges and the variants' columns. Universal
    Credit goes to families on it, or where choose, over the sums tfc_total and uc_total, says so. Of its yearly amount
    each eligible child has its share of costs, rounded, and the last child what is left. Totals that are compared are
    summed exactly: where both supports are equal to the penny, no order of rows decides.
    """
    c = F.col
    rows, sums, shared = children, [], []
    for v in VARIANTS:  # a column per variant while rows move, a row per variant at the end
        cost = c(f"fees_{v}") - c(f"saved_{v}")
        tfc = F.when(c("tfc_eligible"), round_half_up(F.least(cost * (TOP_UP / (1 + TOP_UP)), F.when(c("disabled"), CAP_DISABLED).otherwise(CAP)))).otherwise(0.0)
        rows = rows.withColumn(f"_tfc_{v}", tfc).withColumn(f"_cost_{v}", F.when(c("uc_eligible"), cost))
        sums += [exact_sum(c(f"_tfc_{v}")).alias(f"_total_{v}"), exact_sum(c(f"_cost_{v}")).alias(f"_costs_{v}"), F.count(f"_cost_{v}").alias(f"_n_{v}")]
    sums = rows.groupBy("family").agg(*sums, F.max(F.when(c("uc_eligible"), c("child"))).alias("_last"), F.max("on_uc").alias("_on_uc"))
    for v in VARIANTS:
        yearly = round_half_up(F.least(c(f"_costs_{v}") / 12 * SHARE, F.when(c(f"_n_{v}") == 1, CAP_ONE).otherwise(CAP_MORE)) * 12)
        sums = sums.withColumn("tfc_total", c(f"_total_{v}")).withColumn("uc_total", F.when(c(f"_n_{v}") > 0, yearly).otherwise(0.0))
        kind = F.when(F.coalesce(c("_on_uc") if choose is None else choose, F.lit(False)), "uc").otherwise("tfc")
        sums = sums.withColumn(f"_kind_{v}", kind).withColumn(f"_uc_{v}", c("uc_total"))
    sums = sums.drop("tfc_total", "uc_total", "_on_uc", *(f"_{k}_{v}" for k in ("n", "total") for v in VARIANTS))
    parts = rows.select("family", "child", "charges", *(f"{k}_{v}" for k in ("fees", "saved", "_tfc", "_cost") for v in VARIANTS)).join(sums, "family")
    for v in VARIANTS:
        part = round_half_up(F.when(c(f"_costs_{v}") > 0, c(f"_uc_{v}") * (c(f"_cost_{v}") / c(f"_costs_{v}"))).otherwise(0.0))
        parts = parts.withColumn(f"_part_{v}", F.when(c(f"_cost_{v}").isNotNull() & (c("child") != c("_last")), part).otherwise(0.0))
        shared.append(F.sum(f"_part_{v}").alias(f"_given_{v}"))
    parts = parts.join(parts.groupBy("family").agg(*shared), "family")

    def of(v: str) -> Column:
        uc = F.when(c(f"_cost_{v}").isNotNull() & (c("child") == c("_last")), round_half_up(c(f"_uc_{v}") - c(f"_given_{v}"))).otherwise(c(f"_part_{v}"))
        kind = c(f"_kind_{v}")
        own = {"variant": F.lit(v), "fees": c(f"fees_{v}"), "saved": c(f"saved_{v}"), "kind": kind, "tfc": F.when(kind == "tfc", c(f"_tfc_{v}")).otherwise(0.0), "uc": F.when(kind == "uc", uc).otherwise(0.0)}
        return F.struct(*(x.alias(k) for k, x in own.items()))

    each = parts.select("family", "child", "charges", F.explode(F.array(*map(of, VARIANTS))).alias("s"))
    return each.select("family", "child", "s.variant", "s.fees", "s.saved", "charges", "s.kind", "s.tfc", "s.uc")


def better(tfc: str = "tfc_total", uc: str = "uc_total") -> Column:
    """For choose: Universal Credit where it pays more."""
    return F.col(uc) > F.col(tfc)


def family_range(supported: DataFrame) -> DataFrame:
    """Per family the cost that is left by variant (lower, mean, upper), the support at the mean and its kind."""
    c = F.col
    left = c("fees") + F.coalesce("charges", F.lit(0.0)) - c("saved") - c("tfc") - c("uc")
    of = lambda v, x: F.round(F.sum(F.when(c("variant") == v, x)), 2)
    return supported.groupBy("family").agg(*(of(v, left).alias(v) for v in VARIANTS), of("mean", c("tfc") + c("uc")).alias("support"), F.max(F.when(c("variant") == "mean", c("kind"))).alias("kind"))
