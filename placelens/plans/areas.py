"""Areas of a made mesh, one per customer: simplified with common borders, and who borders on whom.

Area k lies at column k % 50 and row k / 50 of a grid. Each side has three
points between its corners: two lie 1/1024 off the line, which simplifying by
1/512 removes, and the middle one is 1/4 off it on some sides, which stays, or
1/2048. The SQL states what is left.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from placelens.operators import topology
from placelens.plans.base import table
from placelens.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

_WIDE = 50
_TOLERANCE = 1 / 512
_CELLS = f"SELECT c_custkey AS id, c_custkey % {_WIDE} AS i, c_custkey // {_WIDE} AS j FROM customer"
#: Whether the side below, and to the left of, the area at (i, j) has a tooth.
_BELOW, _LEFT = "({i} + 2 * {j}) % 3 = 0", "(2 * {i} + {j}) % 3 = 1"


def areas(spark, d):
    """id and rings; sides that two areas share have the same points, read from either end."""
    cells = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % _WIDE).alias("i"), F.floor(F.col("c_custkey") / _WIDE).alias("j"))

    def side(flat: bool, i: str, j: str):
        tooth = F.expr(f"CASE WHEN {(_BELOW if flat else _LEFT).format(i=i, j=j)} THEN 0.25D ELSE 1D / 2048 END")
        x, y = F.expr(f"double({i})"), F.expr(f"double({j})")
        along = [(0.0, F.lit(0.0)), (0.25, tooth / 2 + 1 / 1024), (0.5, tooth), (0.75, tooth / 2 - 1 / 1024)]
        return [F.struct((x + t if flat else x + off).alias("x"), (y + off if flat else y + t).alias("y")) for t, off in along]

    def corner(i: str, j: str):
        return F.struct(F.expr(f"double({i})").alias("x"), F.expr(f"double({j})").alias("y"))

    right, above = side(False, "(i + 1)", "j"), side(True, "i", "(j + 1)")
    ring = [*side(True, "i", "j"), *right, corner("i + 1", "j + 1"), *above[:0:-1], corner("i", "j + 1"), *side(False, "i", "j")[:0:-1], corner("i", "j")]
    return cells.select("id", F.array(F.array(*ring)).alias("rings"))


_TEETH = f"""SELECT id, i, j, CASE WHEN {_BELOW.format(i='i', j='j')} THEN 1 ELSE 0 END AS below, CASE WHEN {_LEFT.format(i='i', j='j')} THEN 1 ELSE 0 END AS lft,
  CASE WHEN {_BELOW.format(i='i', j='(j + 1)')} THEN 1 ELSE 0 END AS above, CASE WHEN {_LEFT.format(i='(i + 1)', j='j')} THEN 1 ELSE 0 END AS rgt FROM ({_CELLS})"""


@query(f"SELECT id, 5 + below + lft + above + rgt AS n_points, CAST(j AS DOUBLE) AS south, CAST(i AS DOUBLE) AS west, j + 1 + above * 0.25 AS north, i + 1 + rgt * 0.25 AS east FROM ({_TEETH})")
def simplified_areas(spark, d):
    simple = topology.simplify(areas(spark, d), _TOLERANCE)
    return simple.select("id", F.size(F.get("rings", F.lit(0))).cast("long").alias("n_points"), *(v.alias(k) for k, v in topology.envelope(F.col("rings")).items()))


@query(f"""SELECT a.id AS a, b.id AS b, round(CASE WHEN (CASE WHEN b.i > a.i THEN b.lft ELSE b.below END) = 1 THEN sqrt(1.25) ELSE 1 END, 9) AS length
FROM ({_TEETH}) a JOIN ({_TEETH}) b ON b.i = a.i + 1 AND b.j = a.j OR b.j = a.j + 1 AND b.i = a.i""")
def shared_borders(spark, d):
    """Borders after simplifying: neighbours that no longer had the same points would share none."""
    return topology.shared_borders(topology.simplify(areas(spark, d), _TOLERANCE)).withColumn("length", F.round("length", 9))
