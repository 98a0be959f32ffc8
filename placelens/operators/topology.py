"""Simplification of neighbouring areas by their shared borders.

Rings are cut into arcs at junctions, points where the neighbours before and
after differ between the rings that pass. An arc that several rings share is
kept once, in one direction, and simplified once; rings are stitched from the
arcs again. So neighbours keep every point of their border in common, and no
gap or overlap opens between them. Arcs that would cross after simplifying are
taken back to a finer tolerance, to all of their points if need be.

features: id and rings, an array of closed rings, each an array of struct<x, y>
(doubles). Rings of areas without neighbours are arcs that close. Joins are on
points, arcs and grid cells; a task holds one ring or one arc.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens.operators import scratch

_POINTS = "array<struct<x: double, y: double>>"
_XY = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Tolerances of an arc that crosses others: each is this part of the one before; after the last all points stay.
FINER, STEPS = 0.25, 4


def _tuples(points: list[dict]) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in points]


def _dicts(points) -> list[dict]:
    return [{"x": x, "y": y} for x, y in points]


def cut_ring(points: list[tuple], junctions: list[int]) -> list[tuple[list[tuple], bool]]:
    """Arcs of an open ring (its first point not repeated) in order, each in its own direction, and whether it was turned for that.

    A ring without junctions starts at its least point, so that equal rings give the same arc wherever they start.
    """
    n = len(points)
    starts = junctions or [min(range(n), key=points.__getitem__)]
    out = []
    for k, start in enumerate(starts):
        end = starts[(k + 1) % len(starts)]
        arc = [points[(start + i) % n] for i in range((end - start - 1) % n + 2)]
        other = arc[::-1]
        out.append((other, True) if other < arc else (arc, False))
    return out


def simplified_arc(points: list[tuple], tolerance: float, inner: bool) -> list[tuple]:
    """Points farther than tolerance from the chord stay, the ends always; a closed arc keeps three points at least, and one with inner a point between its ends."""

    def off(a, b, k):
        (ax, ay), (bx, by), (x, y) = points[a], points[b], points[k]
        length = ((bx - ax) ** 2 + (by - ay) ** 2) ** 0.5
        return abs((bx - ax) * (ay - y) - (ax - x) * (by - ay)) / length if length else ((x - ax) ** 2 + (y - ay) ** 2) ** 0.5

    last = len(points) - 1
    if last < 2 or tolerance <= 0:
        return points
    forced, keep = [], {0, last}
    if points[0] == points[last]:  # the farthest point, and the farthest from the line to it
        far = max(range(1, last), key=lambda k: off(0, last, k))
        forced = sorted({far, max((k for k in range(1, last) if k != far), key=lambda k: off(0, far, k), default=far)})
    elif inner:
        forced = [max(range(1, last), key=lambda k: off(0, last, k))]
    keep.update(forced)
    ends = [0, *forced, last]
    stack = list(zip(ends, ends[1:], strict=False))
    while stack:
        a, b = stack.pop()
        far = max(range(a + 1, b), key=lambda k: off(a, b, k), default=None)
        if far is not None and off(a, b, far) > tolerance:
            keep.add(far)
            stack += [(a, far), (far, b)]
    return [points[k] for k in sorted(keep)]


def _ring_rows(features: DataFrame) -> DataFrame:
    """A row per ring with its points, the first one not repeated and none twice in a row, and a number of its own."""
    rings = scratch.spread(features, "id").select("id", F.posexplode("rings").alias("ring", "points"))
    first = F.element_at("points", 1)
    bare = F.when((F.size("points") > 1) & (first == F.element_at("points", -1)), F.slice("points", 1, F.size("points") - 1)).otherwise(F.col("points"))
    rings = rings.where(F.size("points") > 0).withColumn("points", bare)
    fresh = F.filter("points", lambda p, k: (k == 0) | (p != F.get("points", k - 1)))
    return rings.withColumn("points", fresh).withColumn("rid", F.monotonically_increasing_id())


def arcs_of(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uses, arcs). uses: id, ring, rid (a ring's own number), seq, turned, arc_id; arcs: arc_id, points."""
    rings = scratch.written(_ring_rows(features))
    n, p = F.size("points"), F.col("points")
    around = F.transform(p, lambda x, k: F.struct(x.alias("at"), k.alias("k"), F.get(p, (k + n - 1) % n).alias("a"), F.get(p, (k + 1) % n).alias("b")))
    met = rings.select("rid", F.explode(around).alias("s")).select("rid", "s.*")
    pair = F.array_sort(F.array("a", "b"))
    # two least and greatest pairs differ where rings part; they are combined before rows move
    junctions = met.groupBy("at").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where("low <> high").select("at")
    places = met.select("rid", "k", "at").join(scratch.merged(junctions), "at").groupBy("rid").agg(F.sort_array(F.collect_list("k")).alias("places"))
    kind = features.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for name, ring, rid, points, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                cut = cut_ring(_tuples(points), places or [])
                for seq, (arc, turned) in enumerate(cut):
                    arc_id = hashlib.sha256(struct.pack(f"<{2 * len(arc)}d", *(v for xy in arc for v in xy))).hexdigest()
                    out.append((name, ring, rid, seq, turned, arc_id, _dicts(arc)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (b.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), _XY)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "ring", "rid", "seq", "turned", "arc_id", "points"])

    whole = rings.join(scratch.merged(places), "rid", "left").select("id", "ring", "rid", "points", "places")
    cut = scratch.written(whole.mapInArrow(run, f"id {kind}, ring int, rid long, seq int, turned boolean, arc_id string, points {_POINTS}"))
    arcs = cut.groupBy("arc_id").agg(F.any_value("points").alias("points"))
    return cut.select("id", "ring", "rid", "seq", "turned", "arc_id"), scratch.written(arcs)


def _simplified(arcs: DataFrame) -> DataFrame:
    """arc_id, points, inner, tolerance -> the same with line, the points that stay."""

    def run(batches):
        for b in batches:
            lines = [_dicts(simplified_arc(_tuples(p), t, i)) for p, i, t in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lines, _XY)], [*b.schema.names, "line"])

    return arcs.select("arc_id", "points", "inner", "tolerance").mapInArrow(run, f"arc_id string, points {_POINTS}, inner boolean, tolerance double, line {_POINTS}")


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def _on(a: Column, b: Column, c: Column) -> Column:
    """c lies on the line from a to b, not at its ends."""
    inside = c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    return (_side(a, b, c) == 0) & inside & (c != a) & (c != b)


def crossings(lines: DataFrame, cell: float) -> DataFrame:
    """Pairs (arc_id, other_id) of lines with segments that cross or touch other than at their ends. lines: arc_id, line.

    Segments meet on grid cells: one lies on the level whose cells are as wide as it, in four of
    them at most, and looks up its own level and all wider ones.
    """
    segments = lines.select("arc_id", F.explode(F.sequence(F.lit(1), F.size("line") - 1)).alias("k"), "line")
    segments = segments.select("arc_id", "k", F.get("line", F.col("k") - 1).alias("a"), F.get("line", F.col("k")).alias("b"))
    low = lambda v: F.least(F.col(f"a.{v}"), F.col(f"b.{v}"))
    high = lambda v: F.greatest(F.col(f"a.{v}"), F.col(f"b.{v}"))
    side = F.greatest(high("x") - low("x"), high("y") - low("y"), F.lit(cell))
    segments = scratch.written(segments.withColumn("level", F.ceil(F.log(2.0, side / cell) - 1e-9).cast("int")))
    top = segments.agg(F.max("level")).first()[0] or 0

    def celled(df):
        wide = F.lit(cell) * F.pow(F.lit(2.0), F.col("at_level"))
        span = lambda v: F.explode(F.sequence(F.floor(low(v) / F.col("wide")), F.floor(high(v) / F.col("wide"))))
        return df.withColumn("wide", wide).withColumn("gx", span("x")).withColumn("gy", span("y")).drop("wide", "level")

    own = celled(segments.withColumn("at_level", F.col("level")))
    looked = celled(segments.withColumn("at_level", F.explode(F.sequence(F.col("level"), F.lit(top)))))
    looked = looked.select("at_level", "gx", "gy", F.col("arc_id").alias("other_id"), F.col("k").alias("other_k"), F.col("a").alias("c"), F.col("b").alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    cross = (_side(a, b, c) * _side(a, b, d) < 0) & (_side(c, d, a) * _side(c, d, b) < 0)
    touch = _on(a, b, c) | _on(a, b, d) | _on(c, d, a) | _on(c, d, b)
    other = (F.col("arc_id") != F.col("other_id")) | (F.col("k") != F.col("other_k"))
    same = (F.col("arc_id") != F.col("other_id")) & ((a == c) & (b == d) | (a == d) & (b == c))
    return own.join(scratch.merged(looked), ["at_level", "gx", "gy"]).where(other & (cross | touch | same)).select("arc_id", "other_id").distinct()


def simplify(features: DataFrame, tolerance: float) -> DataFrame:
    """id and rings, where neighbours share every point of their common borders.

    Features with an empty or null array of rings are left out; a null id is a feature; rows with equal ids are one.
    """
    uses, arcs = arcs_of(features)
    lines = scratch.written(_simplified(arcs.withColumns({"inner": F.lit(False), "tolerance": F.lit(float(tolerance))})))
    if tolerance > 0:  # rings of two arcs that have become one line get a point back on each
        sizes = uses.join(lines.select("arc_id", (F.size("line") - 1).alias("n")), "arc_id").groupBy("rid").agg(F.sum("n").alias("n"))
        flat = uses.join(sizes.where("n < 3"), "rid", "left_semi").select("arc_id").distinct()
        lines = _redone(lines, scratch.written(flat), {"inner": F.lit(True)})
    while tolerance > 0:
        met = crossings(lines.select("arc_id", "line"), tolerance)
        crossed = met.select(F.explode(F.array("arc_id", "other_id")).alias("arc_id")).distinct()
        crossed = scratch.written(lines.where("tolerance > 0").select("arc_id").join(crossed, "arc_id", "left_semi"))
        if crossed.isEmpty():
            break
        finer = F.when(F.col("tolerance") * FINER < tolerance * FINER**STEPS, 0.0).otherwise(F.col("tolerance") * FINER)
        lines = _redone(lines, crossed, {"tolerance": finer})
    return stitched(uses, lines)


def _redone(lines: DataFrame, some: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Lines where those of some arcs (arc_id) are simplified again after changes."""
    if some.isEmpty():
        return lines
    again = _simplified(lines.join(some, "arc_id", "left_semi").withColumns(changes))
    return scratch.written(lines.join(some, "arc_id", "left_anti").unionByName(again))


def stitched(uses: DataFrame, lines: DataFrame) -> DataFrame:
    """Rings put together from lines (arc_id, line)."""
    line = F.when(F.col("turned"), F.reverse("line")).otherwise(F.col("line"))
    parts = uses.join(lines.select("arc_id", "line"), "arc_id").select("id", "ring", "rid", "seq", line.alias("line"))
    rings = parts.groupBy("id", "ring", "rid").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("own"))
    bare = F.flatten(F.transform("own", lambda s: F.slice(s["line"], 1, F.size(s["line"]) - 1)))
    rings = rings.select("id", "ring", "rid", bare.alias("p")).select("id", "ring", "rid", F.concat("p", F.slice("p", 1, 1)).alias("points"))
    return rings.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "rid", "points"))), lambda r: r["points"]).alias("rings"))


def length(line: Column) -> Column:
    """The sum of a line's segments."""
    step = lambda p, k: F.when(k == 0, 0.0).otherwise(F.hypot(p["x"] - F.get(line, k - 1)["x"], p["y"] - F.get(line, k - 1)["y"]))
    return F.aggregate(F.transform(line, step), F.lit(0.0), lambda s, x: s + x)


def shared_borders(features: DataFrame) -> DataFrame:
    """(a, b, length) of features a < b that have a border in common. In a coverage two features share an arc at most."""
    uses, arcs = arcs_of(features)
    pairs = uses.groupBy("arc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    return pairs.join(arcs.select("arc_id", length(F.col("points")).alias("length")), "arc_id").groupBy("a", "b").agg(F.sum("length").alias("length"))


def envelope(rings: Column) -> dict[str, Column]:
    """south, west, north, east of all rings."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"south": F.array_min(ys), "west": F.array_min(xs), "north": F.array_max(ys), "east": F.array_max(xs)}
