"""Headroom above slabs: footprints, slabs above, rays, section lines, classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.geometry import convex_hull
from areaflow.operators.spatial import CELL, box_join, even_points, grid_points, rings_touch, with_bbox
from areaflow.session import cut_lineage
from areaflow.sources.meshes import axis, triangles

# Fixed values.
THRESHOLD = 2.2
TOP_TOLERANCE = 0.01
RAY_STEP = 0.5
SPLIT_GRID = 20
STEEP = 1e-6
ABOVE_TOP = 0.01
NO_STOREY_HEADROOM = 3.0
MIN_SEGMENT = 0.001
ROOF_TYPES = ["IfcRoof", "IfcCovering"]
ROOF_WORDS = ["屋檐", "屋顶"]
REACHES = [6.0, 48.0]


def solids(meshes: DataFrame) -> DataFrame:
    """Per element: hull of the plan points, its box, lowest and highest z.

    Written once: the hull is the costly part, and filters on its box would
    otherwise be pushed below it and compute it again.
    """
    n = F.floor(F.size("verts") / 3).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get("verts", i * 3).alias("x"), F.get("verts", i * 3 + 1).alias("y")))
    zs = axis(F.col("verts"), 2)
    hulls = cut_lineage(meshes.where(F.size("verts") >= 9).withColumn("ring", convex_hull(points)).withColumns(
        {"min_z": F.array_min(zs), "max_z": F.array_max(zs)}).drop("verts", "faces"))
    return with_bbox(hulls)


def face_border(meshes: DataFrame, side: str) -> DataFrame:
    """Border edges of the faces at the top or bottom of each mesh; shared edges cancel.

    Returns model_id, express_id, x1, y1, x2, y2 (directed) for every border edge.
    """
    zs = axis(F.col("verts"), 2)
    level = F.array_max(zs) if side == "top" else F.array_min(zs)
    tri = triangles(meshes.select("model_id", "express_id", "verts", "faces", level.alias("level")))
    flat = tri.where(reduce(lambda a, b: a & b, [F.abs(F.col(f"p{i}.z") - F.col("level")) < TOP_TOLERANCE for i in (1, 2, 3)]))

    def edge(a: str, b: str) -> Column:
        return F.struct(F.col(f"{a}.x").alias("x1"), F.col(f"{a}.y").alias("y1"),
                        F.col(f"{b}.x").alias("x2"), F.col(f"{b}.y").alias("y2"))

    e = flat.select("model_id", "express_id", F.explode(F.array(edge("p1", "p2"), edge("p2", "p3"), edge("p3", "p1"))).alias("e"))
    forward = (F.col("e.x1") < F.col("e.x2")) | ((F.col("e.x1") == F.col("e.x2")) & (F.col("e.y1") < F.col("e.y2")))

    def pick(a: str, b: str) -> Column:
        return F.when(forward, F.col(f"e.{a}")).otherwise(F.col(f"e.{b}"))

    merged = e.select("model_id", "express_id", pick("x1", "x2").alias("xa"), pick("y1", "y2").alias("ya"),
                      pick("x2", "x1").alias("xb"), pick("y2", "y1").alias("yb"),
                      F.when(forward, 1).otherwise(-1).alias("s")).groupBy(
        "model_id", "express_id", "xa", "ya", "xb", "yb").agg(F.sum("s").alias("s")).where("s <> 0")
    fwd = F.col("s") > 0
    return merged.select("model_id", "express_id", *[
        F.when(fwd, F.col(a)).otherwise(F.col(b)).alias(n)
        for n, a, b in (("x1", "xa", "xb"), ("y1", "ya", "yb"), ("x2", "xb", "xa"), ("y2", "yb", "ya"))])


def footprint_area(border: DataFrame) -> DataFrame:
    """Area enclosed by border edges; no ring order is needed."""
    twice = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).cast("decimal(28,10)")
    return border.groupBy("model_id", "express_id").agg(
        (F.abs(F.sum(twice).cast("double")) / 2.0).alias("area"), F.count(F.lit(1)).alias("n_edges"))


def nearest_above(slabs: DataFrame, others: DataFrame | None = None, reaches: list[float] | None = None) -> DataFrame:
    """Nearest element of `others` (by default: slab) above each slab whose hull meets its plan.

    Candidates are searched in height bands: first close above, then higher up for
    the slabs still without one, at last without a band.  A slab in a tall stack
    so meets its neighbours, not the whole stack.
    """
    plan = ["ring", "minx", "maxx", "miny", "maxy"]
    slabs = cut_lineage(slabs.select("model_id", "express_id", *plan, "min_z", "max_z"))
    # Copies of the same plan at the same height count once, below and above.
    lower = cut_lineage(slabs.groupBy("model_id", F.col("max_z").alias("top"), *plan).agg(
        F.min("express_id").alias("express_id")))
    upper = cut_lineage((slabs if others is None else others).groupBy("model_id", "min_z", *plan).agg(
        F.min("express_id").alias("express_id")))
    nearest = F.min(F.struct("r_min_z", "r_express_id"))
    found: list[DataFrame] = []
    left = lower
    for reach in [*(REACHES if reaches is None else reaches), None]:
        higher = F.col("r_min_z") > F.col("top")
        touch = rings_touch(F.col("ring"), F.col("r_ring"))
        if reach is None:
            pairs = box_join(left, upper, ["model_id"], higher & touch)
        else:
            band = F.floor(F.col("top") / reach)
            pairs = box_join(left.withColumn("band", F.explode(F.array(band, band + 1))),
                             upper.withColumn("band", F.floor(F.col("min_z") / reach)),
                             ["model_id", "band"], higher & touch)
        hit = cut_lineage(pairs.groupBy("model_id", "express_id").agg(nearest.alias("n")).select(
            "model_id", "express_id", F.col("n.r_express_id").alias("above_id"), F.col("n.r_min_z").alias("above_z")))
        # Within the band searched the nearest is exact: every slab up to the top of the next band was seen.
        found.append(hit)
        left = left.join(hit.select("model_id", "express_id"), ["model_id", "express_id"], "left_anti")
    first = lower.select("model_id", "top", "ring", "express_id").join(
        reduce(DataFrame.unionByName, found), ["model_id", "express_id"]).drop("express_id")
    every = slabs.select("model_id", "express_id", F.col("max_z").alias("top"), "ring")
    return every.join(first, ["model_id", "top", "ring"]).select("model_id", "express_id", "above_id", "above_z")


def above_candidates(open_slabs: DataFrame, others: DataFrame) -> DataFrame:
    """Other elements with a part above an open slab and a plan that meets it."""
    o = others.select("model_id", F.col("express_id").alias("other"), "ifc_type", "name", "ring", "min_z", "max_z",
                      "minx", "maxx", "miny", "maxy")
    s = open_slabs.select("model_id", "express_id", "ring", "minx", "maxx", "miny", "maxy", F.col("max_z").alias("top"))
    cond = (F.col("r_max_z") > F.col("top")) & rings_touch(F.col("ring"), F.col("r_ring"))
    return box_join(s, o, ["model_id"], cond).select(
        "model_id", "express_id", "top", F.col("r_other").alias("other"), F.col("r_ifc_type").alias("ifc_type"),
        F.col("r_name").alias("name"), F.col("r_min_z").alias("min_z"), F.col("r_max_z").alias("max_z"))


def mesh_faces(meshes: DataFrame) -> DataFrame:
    """Triangles that are not steep, with their plan box."""
    t = triangles(meshes.select("model_id", F.col("express_id").alias("other"), "verts", "faces"))
    x, y = [F.col(f"p{i}.x") for i in (1, 2, 3)], [F.col(f"p{i}.y") for i in (1, 2, 3)]
    nz = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])
    return t.where(F.abs(nz) >= STEEP).withColumns({
        "minx": F.least(*x), "maxx": F.greatest(*x), "miny": F.least(*y), "maxy": F.greatest(*y)})


def ray_hits(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Z of each face straight above each point (px, py, top); points and faces meet on grid cells."""
    at = points.withColumns({"minx": F.col("px"), "maxx": F.col("px"), "miny": F.col("py"), "maxy": F.col("py")})
    a, b, c = F.col("r_p1"), F.col("r_p2"), F.col("r_p3")
    px, py = F.col("px"), F.col("py")

    def side(p: Column, q: Column) -> Column:
        return (q["x"] - p["x"]) * (py - p["y"]) - (q["y"] - p["y"]) * (px - p["x"])

    s1, s2, s3 = side(a, b), side(b, c), side(c, a)
    within = ((s1 >= -1e-9) & (s2 >= -1e-9) & (s3 >= -1e-9)) | ((s1 <= 1e-9) & (s2 <= 1e-9) & (s3 <= 1e-9))
    nx = (b["y"] - a["y"]) * (c["z"] - a["z"]) - (c["y"] - a["y"]) * (b["z"] - a["z"])
    ny = (b["z"] - a["z"]) * (c["x"] - a["x"]) - (c["z"] - a["z"]) * (b["x"] - a["x"])
    nz = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (c["x"] - a["x"]) * (b["y"] - a["y"])
    z = a["z"] - (nx * (px - a["x"]) + ny * (py - a["y"])) / nz
    pairs = box_join(at, faces, ["model_id"], within, CELL / 2)
    return pairs.withColumn("z", F.round(z, 9)).where(F.col("z") > F.col("top")).drop(
        "minx", "maxx", "miny", "maxy").withColumnRenamed("r_other", "other")


def effective_heights(candidates: DataFrame, open_slabs: DataFrame, faces: DataFrame) -> DataFrame:
    """Lowest z of each candidate over the slab; its own heights where no ray hits."""
    s = open_slabs.select("model_id", "express_id", "ring", "minx", "maxx", "miny", "maxy", F.col("max_z").alias("top"))
    used = s.join(candidates.select("model_id", "express_id").distinct(), ["model_id", "express_id"], "left_semi")
    hits = ray_hits(grid_points(used, RAY_STEP).select("model_id", "express_id", "px", "py", "top"), faces)
    lowest = hits.groupBy("model_id", "express_id", "other").agg(F.min("z").alias("ray_z"))
    top = F.col("top")
    own = F.when(F.col("min_z") > top, F.col("min_z")).otherwise(F.coalesce(F.col("vertex_z"), top + ABOVE_TOP))
    return candidates.join(lowest, ["model_id", "express_id", "other"], "left").withColumn(
        "effective_z", F.coalesce("ray_z", own))


def lowest_vertex_above(candidates: DataFrame, meshes: DataFrame) -> DataFrame:
    """Add vertex_z, the lowest vertex of the candidate above the slab top."""
    zs = meshes.select("model_id", F.col("express_id").alias("other"), axis(F.col("verts"), 2).alias("zs"))
    return candidates.join(zs, ["model_id", "other"]).withColumn(
        "vertex_z", F.array_min(F.filter("zs", lambda z: z > F.col("top")))).drop("zs")


def is_roof_like(kind: Column, name: Column) -> Column:
    hit = kind.isin(ROOF_TYPES)
    for w in ROOF_WORDS:
        hit = hit | F.coalesce(name.contains(w), F.lit(False))
    return hit


def section_crossing(candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """roof-like candidates cut by the plane `threshold` above the slab (bounds included)."""
    plane = F.col("top") + threshold
    return candidates.where(is_roof_like(F.col("ifc_type"), F.col("name")) & (F.col("min_z") <= plane) & (
        plane <= F.col("max_z")))


def clearances(slabs: DataFrame, above: DataFrame, effective: DataFrame, next_levels: DataFrame) -> DataFrame:
    """Clearance by the nearest slab, else by the lowest candidate, else to the next storey, else 3 m."""
    low = effective.groupBy("model_id", "express_id").agg(F.min("effective_z").alias("low_z"))
    out = slabs.select("model_id", "express_id", F.col("max_z").alias("top")).join(
        above, ["model_id", "express_id"], "left").join(low, ["model_id", "express_id"], "left").join(
        next_levels, ["model_id", "express_id"])
    top = F.col("top")
    return out.withColumn("min_clearance", F.coalesce(
        F.col("above_z") - top, F.col("low_z") - top, F.col("next_elevation") - top, F.lit(NO_STOREY_HEADROOM)))


def sampled_slabs(open_slabs: DataFrame, crossing: DataFrame) -> DataFrame:
    """Slabs under a crossing roof, as sample_heights reads them."""
    s = open_slabs.select("model_id", "express_id", "ring", "minx", "maxx", "miny", "maxy", F.col("max_z").alias("top"))
    return s.join(crossing.select("model_id", "express_id").distinct(), ["model_id", "express_id"], "left_semi")


def sample_heights(used: DataFrame, faces: DataFrame) -> DataFrame:
    """Sample points (column i, row j) of slabs with the clearance below the lowest face above; open sky drops out."""
    points = even_points(used, SPLIT_GRID).select("model_id", "express_id", "i", "j", "px", "py", "top")
    return ray_hits(points, faces).groupBy("model_id", "express_id", "i", "j").agg(
        (F.min("z") - F.first("top")).alias("clear"))


def split_samples(open_slabs: DataFrame, crossing: DataFrame, faces: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Share of sampled points with clearance at or above the threshold, for slabs under a crossing roof."""
    points = sample_heights(sampled_slabs(open_slabs, crossing), faces)
    return points.groupBy("model_id", "express_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("clear") >= threshold).alias("n_high"))


def clearance_classes(cleared: DataFrame, samples: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Variable when sampled points fall on both sides, else high or low by the clearance."""
    mixed = (F.col("n_high") > 0) & (F.col("n_high") < F.col("n_points"))
    out = cleared.join(samples, ["model_id", "express_id"], "left")
    return out.withColumn("height_class", F.when(F.coalesce(mixed, F.lit(False)), "variable").when(
        F.col("min_clearance") >= threshold, "high").otherwise("low")).withColumn(
        "high_share", F.col("n_high") / F.col("n_points"))


def section_lines(faces: DataFrame) -> DataFrame:
    """Segment where each triangle (p1, p2, p3) meets the plane at section_z; shorter than 1 mm drop out."""
    z = F.col("section_z")

    def meet(a: Column, b: Column) -> Column:
        t = (z - a["z"]) / (b["z"] - a["z"])
        spans = ((a["z"] <= z) & (z <= b["z"])) | ((b["z"] <= z) & (z <= a["z"]))
        return F.when(spans & (a["z"] != b["z"]), F.struct(
            (a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y")))

    p1, p2, p3 = F.col("p1"), F.col("p2"), F.col("p3")
    ends = F.filter(F.array(meet(p1, p2), meet(p2, p3), meet(p3, p1)), lambda p: p.isNotNull())
    two = faces.withColumn("ends", ends).where(F.size("ends") >= 2)
    first, second = F.get("ends", 0), F.get("ends", 1)
    dx, dy = second["x"] - first["x"], second["y"] - first["y"]
    kept = two.withColumn("length", F.sqrt(dx * dx + dy * dy)).where(F.col("length") > MIN_SEGMENT)
    return kept.select(*[c for c in faces.columns if c not in ("p1", "p2", "p3")], "length", *[
        F.round(p[a], 3).alias(f"{a}{i}") for i, p in ((1, first), (2, second)) for a in "xy"])
