"""Polygon overlay as relational algebra.

Polygons of one storey are cut by vertical lines into strips in which no two
edges cross.  Every edge of a counter-clockwise ring adds +1 (lower side) or -1
(upper side) to the depth of its layer, so a running sum over the edges of a
strip, from bottom to top, gives the depth of each gap.  Areas of unions,
differences and intersections are sums over gaps.

Work is split by square tiles: edges are clipped to the tiles they touch, so a
storey that owns most polygons is spread over many groups and a group holds only
the distinct edges crossing one strip of one tile.  Equal edges are summed
before any shuffle of the sweep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.geometry import let, ring_pairs, signed_area
from areaflow.functions.numbers import exact_area
from areaflow.session import cut_lineage

TILE = 16.0
SNAP = 9


def ring_edges(polys: DataFrame, keys: list[str]) -> DataFrame:
    """Directed edges of counter-clockwise rings: keys, layer, poly_id, x1, y1, x2, y2."""
    def edges(r: Column) -> Column:
        oriented = let(F.when(signed_area(r) < 0, F.reverse(r)).otherwise(r), ring_pairs)
        return F.when(F.size(r) >= 3, oriented)

    # One expression from ring to edges, so a computed ring is computed once.
    e = polys.select(*keys, "layer", "poly_id", F.explode_outer(let(F.col("ring"), edges)).alias("e")).where("e is not null")
    return e.select(*keys, "layer", "poly_id", *[
        F.round(F.col(c), SNAP).alias(n) for c, n in
        (("e.a.x", "x1"), ("e.a.y", "y1"), ("e.b.x", "x2"), ("e.b.y", "y2"))])


def signed_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that are not vertical, left to right, equal ones merged with their summed sign per layer."""
    forward = F.col("x1") < F.col("x2")

    def pick(a: str, b: str) -> Column:
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    sign = F.when(forward, 1).otherwise(-1)
    flat = edges.where(F.col("x1") != F.col("x2")).select(
        *keys, "layer", pick("x1", "x2").alias("xl"), pick("y1", "y2").alias("yl"),
        pick("x2", "x1").alias("xr"), pick("y2", "y1").alias("yr"), sign.alias("sign"))
    merged = flat.groupBy(*keys, "xl", "yl", "xr", "yr").agg(
        F.sum(F.when(F.col("layer") == "a", F.col("sign")).otherwise(0)).alias("sa"),
        F.sum(F.when(F.col("layer") == "b", F.col("sign")).otherwise(0)).alias("sb"))
    return merged.where((F.col("sa") != 0) | (F.col("sb") != 0))


def to_tiles(edges: DataFrame, tile: float | None) -> DataFrame:
    """Copy each edge to every tile column it spans; without tiles the storey is one tile.

    Depth in a tile needs the edges below it as well, so tiles are columns of the
    plan: an edge meets the tiles of its x range, clipped to them.
    """
    if tile is None:
        return edges.withColumn("tile", F.lit(0).cast("bigint"))
    first, last = F.floor(F.col("xl") / tile), F.ceil(F.col("xr") / tile) - 1
    spread = edges.withColumn("tile", F.explode(F.sequence(first, F.greatest(first, last))))
    left = F.greatest(F.col("xl"), F.col("tile") * tile)
    right = F.least(F.col("xr"), (F.col("tile") + 1) * tile)
    slope = (F.col("yr") - F.col("yl")) / (F.col("xr") - F.col("xl"))

    def y_at(x: Column) -> Column:
        return F.when(F.col("yl") == F.col("yr"), F.col("yl")).otherwise(F.round(
            F.col("yl") + (x - F.col("xl")) * slope, SNAP))

    return spread.select(*[c for c in edges.columns if c not in ("xl", "yl", "xr", "yr")], "tile",
                         left.alias("xl"), y_at(left).alias("yl"), right.alias("xr"), y_at(right).alias("yr"))


def crossings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """x of proper crossings: sloped edges against all edges of the same tile and height band.

    Edges are copied to the height bands they span, so the join is an equi-join
    on (keys, tile, band); only true crossings leave it.
    """
    band = TILE / 4
    low, high = F.least("yl", "yr"), F.greatest("yl", "yr")
    banded = edges.withColumn("band", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    ks = [*keys, "tile", "band"]
    s = banded.where(F.col("yl") != F.col("yr")).select(*ks, *[F.col(c).alias("s_" + c) for c in ("xl", "yl", "xr", "yr")])
    on = banded.join(s, ks)
    x1, y1, x2, y2 = (F.col(c) for c in ("xl", "yl", "xr", "yr"))
    u1, v1, u2, v2 = (F.col("s_" + c) for c in ("xl", "yl", "xr", "yr"))
    overlap = (x1 < u2) & (u1 < x2)
    m, n = (y2 - y1) / (x2 - x1), (v2 - v1) / (u2 - u1)
    left, right = F.greatest(x1, u1), F.least(x2, u2)

    def gap(x: Column) -> Column:
        return (y1 + (x - x1) * m) - (v1 + (x - u1) * n)

    x = left + (right - left) * gap(left) / (gap(left) - gap(right))
    return on.where(overlap & (gap(left) * gap(right) < 0)).select(*keys, "tile", F.round(x, SNAP).alias("x"))


def strips(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Consecutive breakpoints (a, b) per tile: edge ends and, when an edge slopes, crossings."""
    ks = [*keys, "tile"]
    points = edges.select(*ks, F.explode(F.array("xl", "xr")).alias("x"))
    if not edges.where("yl <> yr").isEmpty():
        points = points.unionByName(crossings(edges, keys))
    following = F.lead("x").over(Window.partitionBy(*ks).orderBy("x"))
    return points.select(*ks, F.col("x").alias("a"), following.alias("b")).where("a < b")


def sweep(edges: DataFrame, keys: list[str], tile: float | None = TILE) -> DataFrame:
    """Gaps of every strip with the depth of layer a and b above each edge.

    Columns: keys, tile, a, b (strip), ya, yb (lower side), ta, tb (upper side),
    da, db (depths).  The gap above the last edge is not listed.  The merged edges
    are written once; strips and pieces both read them.  Joins, sums and windows
    all cluster on (keys, tile), so one shuffle serves them.
    """
    placed = cut_lineage(to_tiles(signed_edges(edges, keys), tile))
    cuts = strips(placed, keys)
    ks = [*keys, "tile"]
    pieces = placed.join(cuts, ks).where((F.col("xl") <= F.col("a")) & (F.col("b") <= F.col("xr")))
    slope = (F.col("yr") - F.col("yl")) / (F.col("xr") - F.col("xl"))

    def y_at(x: str) -> Column:
        return F.when(F.col("yl") == F.col("yr"), F.col("yl")).otherwise(
            F.round(F.col("yl") + (F.col(x) - F.col("xl")) * slope, SNAP))

    rows = pieces.select(*ks, "a", "b", y_at("a").alias("ya"), y_at("b").alias("yb"), "sa", "sb").groupBy(
        *ks, "a", "b", "ya", "yb").agg(F.sum("sa").alias("sa"), F.sum("sb").alias("sb")).where(
        (F.col("sa") != 0) | (F.col("sb") != 0))
    up = Window.partitionBy(*ks, "a", "b").orderBy(F.col("ya") + F.col("yb"), "ya")
    run = up.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*ks, "a", "b", "ya", "yb", F.lead("ya").over(up).alias("ta"), F.lead("yb").over(up).alias("tb"),
                       F.sum("sa").over(run).alias("da"), F.sum("sb").over(run).alias("db")).where("ta is not null")


def gap_area() -> Column:
    return (F.col("b") - F.col("a")) * ((F.col("ta") - F.col("ya")) + (F.col("tb") - F.col("yb"))) / 2.0


def gap_sums(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Areas of a, b, a or b, a and b, a without b, per key."""
    in_a, in_b, area = F.col("da") > 0, F.col("db") > 0, gap_area()
    sums = {"area_a": in_a, "area_b": in_b, "area_union": in_a | in_b, "area_both": in_a & in_b,
            "area_a_only": in_a & ~in_b}
    return gaps.groupBy(*keys).agg(*[
        F.coalesce(exact_area(F.when(cond, area)), F.lit(0.0)).alias(name) for name, cond in sums.items()])


def overlay_areas(polys: DataFrame, keys: list[str], tile: float | None = TILE) -> DataFrame:
    """A1, A3: overlay areas of polygon layers 'a' and 'b'."""
    return gap_sums(sweep(ring_edges(polys, keys), keys, tile), keys)
