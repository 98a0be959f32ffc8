"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the least node reachable.

    Each round sends every neighbour to the least one, first among larger and
    then among smaller neighbours; a round is written to the shared folder. Sums
    per node are combined before they are shuffled, so a hub costs no single task
    all of its edges. Loops and null ends are left out; no edges, no rows.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = common.written(edges)
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        least = edges.union(edges.select("v", "u")).toDF("k", "x").groupBy("k").agg(F.min("x").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = edges.join(least, edges.v == least.k).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(low, large.u == low.k).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = common.written(small.where("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
