"""Plan geometry as column expressions over rings: array<struct<x double, y double>>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), 0)


def closed_next(ring: Column) -> Column:
    """The ring shifted by one, so zipping both gives the edges."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Shoelace sum; positive for counter-clockwise rings. Null ring gives 0."""
    def measure(r: Column) -> Column:
        terms = F.zip_with(r, closed_next(r), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
        total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
        return F.when(r.isNull() | (F.size(r) < 3), 0.0).otherwise(total / 2.0)

    return let(ring, measure)


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def is_proper(ring: Column) -> Column:
    """At least three points and some area; the ring is evaluated once."""
    return F.coalesce(let(ring, lambda r: (F.size(r) >= 3) & (area(r) > 0)), F.lit(False))


def perimeter(ring: Column) -> Column:
    def measure(r: Column) -> Column:
        terms = F.zip_with(r, closed_next(r), lambda a, b: F.sqrt(
            (b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])))
        return F.when(r.isNull() | (F.size(r) < 2), 0.0).otherwise(
            F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t))

    return let(ring, measure)


def ring_pairs(ring: Column) -> Column:
    """Edges of a ring as array<struct<a, b>>."""
    return let(ring, lambda r: F.zip_with(r, closed_next(r), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def wkt(ring: Column) -> Column:
    """POLYGON text with the first point repeated; numbers without trailing zeros."""
    def number(v: Column) -> Column:
        text = v.cast("decimal(28,6)").cast("string")
        return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")

    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)),
                         lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"])))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))


def cross(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _chain(points: Column) -> Column:
    """Points of a left-turning chain over sorted points; each new point cuts back to the last left turn."""
    def step(acc: Column, p: Column) -> Column:
        turns = F.filter(F.sequence(F.lit(2), F.size(acc)),
                         lambda i: cross(F.element_at(acc, i - 1), F.element_at(acc, i), p) > 1e-12)
        keep = F.coalesce(F.array_max(turns), F.lit(1))
        return F.when(F.size(acc) < 2, F.concat(acc, F.array(p))).otherwise(
            F.concat(F.slice(acc, 1, keep), F.array(p)))

    return F.aggregate(points, F.array().cast(RING), step)


def convex_hull(points: Column) -> Column:
    """G1: counter-clockwise hull of an array of points; fewer than 3 hull points mean no area."""
    def open_end(chain: Column) -> Column:
        return F.slice(chain, 1, F.greatest(F.size(chain) - 1, F.lit(0)))

    def build(ordered: Column) -> Column:
        return F.when(F.size(ordered) < 3, ordered).otherwise(
            F.concat(let(_chain(ordered), open_end), let(_chain(F.reverse(ordered)), open_end)))

    return let(F.array_sort(F.array_distinct(points)), build)


def directions(k: int) -> list[tuple[float, float]]:
    """Vertices of the structuring polygon for buffers, from the lowest: k = 4 is the mitred square, else a k-gon."""
    if k == 4:
        return [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    turn = [2 * math.pi * i / k - math.pi / 2 for i in range(k)]
    return [(round(math.cos(t), 15), round(math.sin(t), 15)) for t in turn]


def _turn(dx: float, dy: float) -> float:
    angle = math.atan2(dy, dx)
    return angle + 2 * math.pi if angle < -1e-12 else max(angle, 0.0)


def dilate(ring: Column, distance: float, k: int = 64) -> Column:
    general = let(ring, lambda r: _dilate(r, distance, k))
    return F.when(is_box(ring), box_around(ring, distance)).otherwise(general) if k == 4 else general


def is_box(ring: Column) -> Column:
    """A rectangle along the axes, or a segment along one of them."""
    p = [F.get(ring, i) for i in range(4)]

    def same(axis: str, i: int, j: int) -> Column:
        return p[i][axis] == p[j][axis]

    first_level = same("y", 0, 1) & same("x", 1, 2) & same("y", 2, 3) & same("x", 3, 0)
    first_upright = same("x", 0, 1) & same("y", 1, 2) & same("x", 2, 3) & same("y", 3, 0)
    return ((F.size(ring) == 2) & (same("x", 0, 1) | same("y", 0, 1))) | ((F.size(ring) == 4) & (first_level | first_upright))


def box_around(ring: Column, distance: float) -> Column:
    """The mitred buffer of a box (is_box) from its opposite corners."""
    a, b = F.get(ring, 0), F.when(F.size(ring) == 2, F.get(ring, 1)).otherwise(F.get(ring, 2))
    low = {c: F.round(F.least(a[c], b[c]) - distance, 9) for c in "xy"}
    high = {c: F.round(F.greatest(a[c], b[c]) + distance, 9) for c in "xy"}
    return F.array(*[F.struct(x["x"].alias("x"), y["y"].alias("y")) for x, y in ((low, low), (high, low), (high, high), (low, high))])


def _dilate(ring: Column, distance: float, k: int) -> Column:
    """Buffer of a convex counter-clockwise ring (or of a segment given as two points).

    The border of a sum of convex shapes runs through the edges of both in the
    order of their direction, so sorting the edges and adding them up gives the ring.
    Edges of the same direction are one, so they add no point to the sweep.
    """
    shape = [(x * distance, y * distance) for x, y in directions(k)]
    steps = [(shape[(i + 1) % len(shape)][0] - x, shape[(i + 1) % len(shape)][1] - y) for i, (x, y) in enumerate(shape)]
    fixed = F.expr("array(" + ", ".join(
        f"named_struct('t', {_turn(dx, dy)!r}D, 'dx', {dx!r}D, 'dy', {dy!r}D)" for dx, dy in steps) + ")")

    def edge(a: Column, b: Column) -> Column:
        angle = F.atan2(b["y"] - a["y"], b["x"] - a["x"])
        turn = F.when(angle < -1e-12, angle + 2 * math.pi).otherwise(F.greatest(angle, F.lit(0.0)))
        return F.struct(turn.alias("t"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"))

    own = F.filter(F.zip_with(ring, closed_next(ring), edge), lambda e: (e["dx"] != 0) | (e["dy"] != 0))
    # Lowest vertex, leftmost among equals; the same corner of the shape starts the walk.
    low = F.array_min(F.transform(ring, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    start = F.struct((low["x"] + shape[0][0]).alias("x"), (low["y"] + shape[0][1]).alias("y"))

    def walk(acc: Column, e: Column) -> Column:
        nxt = F.struct((acc["p"]["x"] + e["dx"]).alias("x"), (acc["p"]["y"] + e["dy"]).alias("y"))
        ring = F.when(e["t"] == acc["t"], acc["r"]).otherwise(F.concat(acc["r"], F.array(acc["p"])))
        return F.struct(nxt.alias("p"), ring.alias("r"), e["t"].alias("t"))

    path = F.aggregate(F.array_sort(F.concat(own, fixed)), F.struct(start.alias("p"), F.array().cast(RING).alias("r"), F.lit(-1.0).alias("t")),
                       walk, lambda acc: acc["r"])
    return F.transform(path, lambda p: F.struct(F.round(p["x"], 9).alias("x"), F.round(p["y"], 9).alias("y")))
