"""Plan-space joins and tests on a square grid, and hulls of large point groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.geometry import convex_hull, cross, is_box, let, ring_pairs
from areaflow.operators.ordered import largest_key

CELL = 8.0
EPS = 1e-9
HULL_CHUNK = 4096


def with_bbox(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Add minx, maxx, miny, maxy of a ring column."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return df.withColumns({"minx": F.array_min(xs), "maxx": F.array_max(xs),
                           "miny": F.array_min(ys), "maxy": F.array_max(ys)})


def cells(df: DataFrame, cell: float) -> DataFrame:
    """Copy a row to every grid cell its box touches (columns cx, cy)."""
    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

    # explode_outer: the spans are never empty, and a plain explode would make Spark
    # add a not-empty filter that evaluates them twice.
    return df.withColumn("cx", F.explode_outer(span("minx", "maxx"))).withColumn(
        "cy", F.explode_outer(span("miny", "maxy")))


def box_join(left: DataFrame, right: DataFrame, keys: list[str], cond: Column | None = None,
             cell: float = CELL) -> DataFrame:
    """Pairs of rows with touching boxes, each once.

    Both sides are copied to the grid cells they touch and meet on (keys, cell); a
    pair counts only in the cell of the lower-left corner of its common box.
    Columns of the right side get the prefix r_.
    """
    l = cells(left, cell)
    r = cells(right, cell)
    r = r.select(*[F.col(c).alias("r_" + c) for c in r.columns])
    on = (F.col("cx") == F.col("r_cx")) & (F.col("cy") == F.col("r_cy"))
    for k in keys:
        on = on & (F.col(k) == F.col("r_" + k))
    touch = (F.col("minx") <= F.col("r_maxx")) & (F.col("r_minx") <= F.col("maxx")) & (
        F.col("miny") <= F.col("r_maxy")) & (F.col("r_miny") <= F.col("maxy"))
    own_cell = (F.floor(F.greatest("minx", "r_minx") / cell) == F.col("cx")) & (
        F.floor(F.greatest("miny", "r_miny") / cell) == F.col("cy"))
    on = on & touch & own_cell
    if cond is not None:
        on = on & cond
    return l.join(r, on).drop("cx", "cy", "r_cx", "r_cy", *[f"r_{k}" for k in keys])


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Crossing parity; points on the border may fall either way."""
    def hits(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > py) != (b["y"] > py)) & (
            px < (b["x"] - a["x"]) * (py - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(ring_pairs(ring), hits)) % 2 == 1


def on_border(px: Column, py: Column, ring: Column) -> Column:
    p = F.struct(px.alias("x"), py.alias("y"))
    return F.exists(ring_pairs(ring), lambda e: (F.abs(cross(e["a"], e["b"], p)) <= EPS)
                    & (px >= F.least(e["a"]["x"], e["b"]["x"]) - EPS) & (px <= F.greatest(e["a"]["x"], e["b"]["x"]) + EPS)
                    & (py >= F.least(e["a"]["y"], e["b"]["y"]) - EPS) & (py <= F.greatest(e["a"]["y"], e["b"]["y"]) + EPS))


def strictly_inside(px: Column, py: Column, ring: Column) -> Column:
    return inside(px, py, ring) & ~on_border(px, py, ring)


def rings_touch(r1: Column, r2: Column) -> Column:
    """Two polygons share a point: an edge meets an edge, or one holds the other."""
    def meets(e, f):
        d1, d2 = cross(e["a"], e["b"], f["a"]), cross(e["a"], e["b"], f["b"])
        d3, d4 = cross(f["a"], f["b"], e["a"]), cross(f["a"], f["b"], e["b"])
        boxes = (F.least(e["a"]["x"], e["b"]["x"]) <= F.greatest(f["a"]["x"], f["b"]["x"])) & (
            F.least(f["a"]["x"], f["b"]["x"]) <= F.greatest(e["a"]["x"], e["b"]["x"])) & (
            F.least(e["a"]["y"], e["b"]["y"]) <= F.greatest(f["a"]["y"], f["b"]["y"])) & (
            F.least(f["a"]["y"], f["b"]["y"]) <= F.greatest(e["a"]["y"], e["b"]["y"]))
        return boxes & (d1 * d2 <= EPS) & (d3 * d4 <= EPS)

    def any_meet(e1: Column, e2: Column) -> Column:
        return F.exists(e1, lambda e: F.exists(e2, lambda f: meets(e, f)))

    edges = let(ring_pairs(r2), lambda e2: any_meet(ring_pairs(r1), e2))
    first, second = F.get(r1, 0), F.get(r2, 0)
    return inside(first["x"], first["y"], r2) | inside(second["x"], second["y"], r1) | edges


def inside_box(px: Column, py: Column) -> Column:
    """strictly_inside for a ring that is its box (minx, maxx, miny, maxy): the same products, without a walk along the ring."""
    def clear(p: Column, low: Column, high: Column, length: Column) -> Column:
        return (((p - low) * length > EPS) | (p > low + EPS)) & (((high - p) * length > EPS) | (p < high - EPS))

    left, right, bottom, top = (F.col(c) for c in ("minx", "maxx", "miny", "maxy"))
    return clear(px, left, right, top - bottom) & clear(py, bottom, top, right - left)


def inner_points(points: DataFrame) -> DataFrame:
    """Points (px, py) strictly inside their ring; `_box` says whether it is a rectangle along the axes."""
    px, py = F.col("px"), F.col("py")
    return points.where(F.when(F.col("_box"), inside_box(px, py)).otherwise(strictly_inside(px, py, F.col("ring")))).drop("_box")


def grid_points(df: DataFrame, step: float) -> DataFrame:
    """Grid points of `step` from the lower-left corner that lie strictly inside the ring (px, py)."""
    def count(lo: str, hi: str) -> Column:
        return F.ceil((F.col(hi) + step - F.col(lo)) / step).cast("int")

    steps = df.withColumn("_box", is_box(F.col("ring"))).withColumn("i", F.explode(F.sequence(F.lit(0), count("minx", "maxx") - 1))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), count("miny", "maxy") - 1)))
    pts = steps.withColumn("px", F.col("minx") + F.col("i") * step).withColumn("py", F.col("miny") + F.col("j") * step)
    return inner_points(pts).drop("i", "j")


def even_points(df: DataFrame, n: int) -> DataFrame:
    """n x n evenly spaced points over the box of the ring, those strictly inside (px, py), with their column i and row j."""
    pts = df.withColumn("_box", is_box(F.col("ring"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pts = pts.withColumn("px", F.col("minx") + F.col("i") * (F.col("maxx") - F.col("minx")) / (n - 1)).withColumn(
        "py", F.col("miny") + F.col("j") * (F.col("maxy") - F.col("miny")) / (n - 1))
    return inner_points(pts)


def group_hulls(points: DataFrame, keys: list[str], chunk: int = HULL_CHUNK) -> DataFrame:
    """G1 for groups of any size: hulls of hulls.

    Equal points are merged first.  While a group is larger than `chunk`, its points
    are hashed into chunks of about that size, each chunk is replaced by its hull,
    and the next pass works on hull points only.
    """
    pts = points.select(*keys, "x", "y").distinct()
    hull = convex_hull(F.collect_list(F.struct("x", "y")))
    peak = largest_key(pts, keys)
    while peak > chunk:
        size = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        parts = pts.join(size, keys).withColumn("_c", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("_n") / chunk)))
        pts = parts.groupBy(*keys, "_c").agg(hull.alias("_h")).select(*keys, F.explode("_h").alias("_p")).select(
            *keys, F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
        smaller = largest_key(pts, keys)
        if smaller >= peak:  # every point is a corner: the hull itself is that long
            break
        peak = smaller
    return pts.groupBy(*keys).agg(hull.alias("ring"))
