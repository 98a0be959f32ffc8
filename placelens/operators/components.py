"""Connected components of records that share keys or are linked in pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.operators import scratch


def key_edges(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Each record links to the least id with the same key: a star per key, never all pairs."""
    out = None
    for k in keys:
        own = df.where(F.col(k).isNotNull()).select(F.col(id_col).alias("u"), F.col(k).cast("string").alias("k"))
        star = own.join(own.groupBy("k").agg(F.min("u").alias("v")), "k").where("u <> v").select("u", "v")
        out = star if out is None else out.union(star)
    return out


def _marked(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first())


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the least id reachable, by star contraction.

    A round hangs first the larger neighbours of every node and then the smaller
    ones on its least neighbour; it ends when each component is a star. Rounds
    grow with the logarithm of the longest chain; more than max_rounds raise.
    """
    edges = scratch.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _marked(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        ends = edges.union(edges.select("v", "u")).toDF("k", "x")
        least = ends.groupBy("k").agg(F.min("x").alias("m")).select("k", F.least("k", "m").alias("m"))  # summed before it moves
        large = edges.join(least, edges.v == least.k).select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        pair = lambda c: F.struct(F.col(c).alias("u"), F.col("m").alias("v"))
        small = large.join(low, large.u == low.k).select(F.explode(F.array(pair("u"), pair("v"))).alias("e")).select("e.*")
        edges = scratch.written(small.where("u <> v").distinct())
        after = _marked(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return nodes.join(edges, nodes.id == edges.u, "left").select("id", F.coalesce("v", "id").alias("component"))
