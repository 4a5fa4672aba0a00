"""Wall polygons, thickness, centre, external walls, curved walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.geometry import cross, perimeter, ring_pairs
from areaflow.operators.ordered import greedy_keep, largest_key, with_neighbours, with_position
from areaflow.operators.spatial import box_join, with_bbox

# Fixed values.
DEFAULT_THICKNESS = 0.2
EXTERNAL_SHARE = 0.1
EXTERNAL_SHARE_MANUAL = 0.5
THIN_DISTANCE = 0.05
JUMP_DISTANCE = 2.0
GUARD_DISTANCE = 1.0
TOUCH = 1e-6


def wall_thickness(models: DataFrame, extents: DataFrame) -> DataFrame:
    """A4: upper median of the short box sides of a model's walls, 0.2 without walls."""
    sides = extents.where((F.col("dx") > 0) & (F.col("dy") > 0)).select(
        "model_id", "express_id", F.least("dx", "dy").alias("t"))
    ranked = with_position(sides, ["model_id"], ["t", "express_id"], "rank")
    sizes = sides.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    middle = ranked.join(sizes, "model_id").where(F.col("rank") == F.floor(F.col("n") / 2) + 1)
    return models.select("model_id").join(middle.select("model_id", "t"), "model_id", "left").select(
        "model_id", F.coalesce("t", F.lit(DEFAULT_THICKNESS)).alias("thickness"))


def building_centroid(models: DataFrame, walls: DataFrame) -> DataFrame:
    """Mean of the wall end points, the origin without walls."""
    ends = F.array(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y")), F.struct(F.col("ex").alias("x"), F.col("ey").alias("y")))
    points = walls.select("model_id", F.explode(ends).alias("p"))
    sums = points.groupBy("model_id").agg(
        F.sum(F.col("p.x").cast("decimal(28,10)")).cast("double").alias("x"),
        F.sum(F.col("p.y").cast("decimal(28,10)")).cast("double").alias("y"), F.count(F.lit(1)).alias("n"))
    return models.select("model_id").join(sums, "model_id", "left").select(
        "model_id", F.coalesce(F.col("x") / F.col("n"), F.lit(0.0)).alias("cx"),
        F.coalesce(F.col("y") / F.col("n"), F.lit(0.0)).alias("cy"))


def strip_ring(sx: Column, sy: Column, ex: Column, ey: Column, thickness: Column, outward: bool = False) -> Column:
    """Four corners of a straight wall, around its line or on its left side only."""
    dx, dy = ex - sx, ey - sy
    length = F.sqrt(dx * dx + dy * dy)
    nx = F.when(length > 0, -dy / length).otherwise(0.0)
    ny = F.when(length > 0, dx / length).otherwise(1.0)
    left, right = (thickness, F.lit(0.0)) if outward else (thickness / 2.0, thickness / 2.0)

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    above_start, below_start = point(sx + nx * left, sy + ny * left), point(sx - nx * right, sy - ny * right)
    above_end, below_end = point(ex + nx * left, ey + ny * left), point(ex - nx * right, ey - ny * right)
    if outward:
        return F.array(below_start, above_start, above_end, below_end)
    return F.array(above_start, below_start, below_end, above_end)


def clipped_length(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of a segment inside a convex counter-clockwise ring, border included."""
    p = F.struct(x1.alias("x"), y1.alias("y"))
    q = F.struct(x2.alias("x"), y2.alias("y"))

    def cut(acc: Column, e: Column) -> Column:
        size = F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
        c0, c1 = cross(e["a"], e["b"], p), cross(e["a"], e["b"], q)
        # A segment along this side stays whole when it is on the line up to noise; one that
        # crosses the side is cut exactly, so the tolerance never lengthens it.
        along = F.abs(c0 - c1) <= TOUCH * size
        outside = F.when(along, F.least(c0, c1) < -TOUCH * size).otherwise((c0 < 0) & (c1 < 0))
        t = c0 / (c0 - c1)
        lo = F.when(outside, 2.0).when(~along & (c0 < 0), F.greatest(acc["lo"], t)).otherwise(acc["lo"])
        hi = F.when(~along & (c0 >= 0) & (c1 < 0), F.least(acc["hi"], t)).otherwise(acc["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    span = F.aggregate(ring_pairs(ring), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), cut)
    return F.greatest(F.lit(0.0), span["hi"] - span["lo"]) * F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def border_overlap(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Length of a segment that runs along the sides of a ring."""
    p = F.struct(x1.alias("x"), y1.alias("y"))
    q = F.struct(x2.alias("x"), y2.alias("y"))

    def along(e: Column) -> Column:
        ux, uy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        size = F.sqrt(ux * ux + uy * uy)
        near = (F.abs(cross(e["a"], e["b"], p)) <= TOUCH * size) & (F.abs(cross(e["a"], e["b"], q)) <= TOUCH * size)
        s = ((x1 - e["a"]["x"]) * ux + (y1 - e["a"]["y"]) * uy) / size
        t = ((x2 - e["a"]["x"]) * ux + (y2 - e["a"]["y"]) * uy) / size
        return F.when((size > 0) & near, F.greatest(F.lit(0.0), F.least(F.greatest(s, t), size) - F.greatest(
            F.least(s, t), F.lit(0.0)))).otherwise(0.0)

    return F.aggregate(F.transform(ring_pairs(ring), along), F.lit(0.0), lambda acc, v: acc + v)


def external_walls(walls: DataFrame, outline_edges: DataFrame, keys: list[str], threshold: float = EXTERNAL_SHARE,
                   manual: bool = False) -> DataFrame:
    """Share of the wall perimeter that the outline border covers, and whether it passes the threshold.

    Walls (convex counter-clockwise rings) meet border edges on grid cells, so a
    storey with very many walls is spread over its cells.
    """
    boxed = with_bbox(walls.select(*keys, "poly_id", "ring"))
    segments = outline_edges.select(
        *keys, "x1", "y1", "x2", "y2", (F.least("x1", "x2") - TOUCH).alias("minx"), (F.greatest("x1", "x2") + TOUCH).alias("maxx"),
        (F.least("y1", "y2") - TOUCH).alias("miny"), (F.greatest("y1", "y2") + TOUCH).alias("maxy"))
    pairs = box_join(boxed, segments, keys)
    measure = border_overlap if manual else clipped_length
    length = measure(F.col("ring"), F.col("r_x1"), F.col("r_y1"), F.col("r_x2"), F.col("r_y2"))
    sums = pairs.groupBy(*keys, "poly_id").agg(F.sum(length.cast("decimal(28,10)")).cast("double").alias("on_outline"))
    out = walls.join(sums, [*keys, "poly_id"], "left").withColumn(
        "ratio", F.round(F.coalesce("on_outline", F.lit(0.0)) / perimeter(F.col("ring")), 9))
    return out.withColumn("is_external", F.col("ratio") > threshold).drop("on_outline")


# --- curved walls: ordered points per wall ---

def _distance(row: Column, last: Column) -> Column:
    return F.sqrt(F.pow(row["x"] - last["x"], 2) + F.pow(row["y"] - last["y"], 2))


def point_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("wall_id").agg(F.count(F.lit(1)).alias("n"), F.max("pt_ord").alias("last_ord"))


def thin_curve(points: DataFrame, tolerance: float = THIN_DISTANCE, peak: int | None = None) -> DataFrame:
    """Keep points more than `tolerance` from the last kept one; walls of up to two points stay whole.

    When only the first point is left, the last point comes back.
    """
    peak = largest_key(points, ["wall_id"]) if peak is None else peak
    kept = greedy_keep(points, ["wall_id"], ["pt_ord"], lambda row, last: _distance(row, last) > tolerance, peak=peak)
    kept_n = kept.groupBy("wall_id").agg(F.count(F.lit(1)).alias("kept_n"))
    back = points.join(point_counts(points), "wall_id").join(kept_n, "wall_id").where(
        (F.col("kept_n") == 1) & (F.col("n") > 1) & (F.col("pt_ord") == F.col("last_ord"))).select(*points.columns)
    return kept.unionByName(back)


def guard_curve(points: DataFrame, limit: float = GUARD_DISTANCE, peak: int | None = None) -> DataFrame:
    """Drop points `limit` or more away from the last kept one; walls left with fewer than 3 points go."""
    kept = greedy_keep(points, ["wall_id"], ["pt_ord"], lambda row, last: _distance(row, last) < limit, peak=peak)
    enough = kept.groupBy("wall_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("wall_id")
    return kept.join(enough, "wall_id", "left_semi")


def smooth_curve(points: DataFrame, peak: int | None = None) -> DataFrame:
    """Drop jump points (both neighbour distances must be below 2.0), then average each with its neighbours.

    End points stay; curves of up to three points stay unchanged.
    """
    peak = largest_key(points, ["wall_id"]) if peak is None else peak
    counted = points.join(point_counts(points), "wall_id")
    short, long = counted.where("n <= 3").select(*points.columns), counted.where("n > 3").select(*points.columns)

    def far(side: str) -> Column:
        return F.sqrt(F.pow(F.col("x") - F.col(f"{side}_x"), 2) + F.pow(F.col("y") - F.col(f"{side}_y"), 2))

    end = F.col("prev_x").isNull() | F.col("next_x").isNull()
    calm = with_neighbours(long, ["wall_id"], ["pt_ord"], ["x", "y"], peak).where(
        end | ((far("prev") < JUMP_DISTANCE) & (far("next") < JUMP_DISTANCE))).select(*points.columns)

    def mean(c: str) -> Column:
        return F.when(end, F.col(c)).otherwise((F.col(f"prev_{c}") + F.col(c) + F.col(f"next_{c}")) / 3.0)

    near = with_neighbours(calm, ["wall_id"], ["pt_ord"], ["x", "y"], peak)
    smooth = near.select(*[mean(c).alias(c) if c in ("x", "y") else F.col(c) for c in points.columns])
    return short.unionByName(smooth)


def offset_curve(points: DataFrame, half: float, peak: int | None = None) -> DataFrame:
    """Ring of a curved wall as rows: left side forwards, then right side backwards (ring_ord)."""
    peak = largest_key(points, ["wall_id"]) if peak is None else peak
    placed = with_position(points, ["wall_id"], ["pt_ord"], "pos", peak)
    near = with_neighbours(placed, ["wall_id"], ["pt_ord"], ["x", "y"], peak)

    def heading(c: str) -> Column:
        back, ahead = F.col(c) - F.col(f"prev_{c}"), F.col(f"next_{c}") - F.col(c)
        return F.when(F.col("prev_x").isNull(), ahead).when(F.col("next_x").isNull(), back).otherwise((back + ahead) / 2.0)

    near = near.withColumn("hx", heading("x")).withColumn("hy", heading("y")).withColumn(
        "len", F.sqrt(F.col("hx") * F.col("hx") + F.col("hy") * F.col("hy")))
    nx = F.when(F.col("len") > 0, -F.col("hy") / F.col("len")).otherwise(0.0)
    ny = F.when(F.col("len") > 0, F.col("hx") / F.col("len")).otherwise(1.0)
    sizes = points.groupBy("wall_id").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("pos").alias("ring_ord"), (F.col("x") + nx * half).alias("x"), (F.col("y") + ny * half).alias("y")),
                   F.struct((F.col("n") * 2 + 1 - F.col("pos")).alias("ring_ord"), (F.col("x") - nx * half).alias("x"),
                            (F.col("y") - ny * half).alias("y")))
    return near.join(sizes, "wall_id").where("n >= 2").select("wall_id", F.explode(both).alias("p")).select("wall_id", "p.*")
