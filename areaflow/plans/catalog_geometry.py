"""Registered queries: polygons, overlay, outlines, walls and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.functions import geometry
from areaflow.functions.numbers import rounded
from areaflow.operators import features, outline, overlay, simplify, spatial, walls
from areaflow.sources.derived import Buildings

STOREY = ["model_id", "storey_id"]
MITRED = 4  # exact on the axis-aligned test rectangles


def rings(b: Buildings, layer: str) -> DataFrame:
    return b.footprints().where(F.col("layer") == layer)


def convex_hull(spark: SparkSession, folder: str) -> DataFrame:
    pts = rings(Buildings(spark, folder), "wall").select(*STOREY, F.explode("ring").alias("p")).select(*STOREY, "p.*")
    hulls = spatial.group_hulls(pts, STOREY)
    return hulls.select(*STOREY, F.size("ring").cast("bigint").alias("n_points"),
                        rounded(geometry.area(F.col("ring")), 4).alias("area"))


def ring_measures(spark: SparkSession, folder: str) -> DataFrame:
    return Buildings(spark, folder).footprints().select(
        "model_id", "poly_id", rounded(geometry.area(F.col("ring")), 4).alias("area"),
        rounded(geometry.perimeter(F.col("ring")), 4).alias("length"))


def point_in_polygon(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    x, y = (F.col("gx") * 4 + F.col("gw") * 2 + 1) / 8.0, (F.col("gy") * 4 + F.col("gd") * 2 + 1) / 8.0
    points = b.element_base().select("model_id", F.col("home_storey").alias("storey_id"), "express_id",
                                     x.alias("px"), y.alias("py"), x.alias("minx"), x.alias("maxx"), y.alias("miny"), y.alias("maxy"))
    slabs = spatial.with_bbox(rings(b, "slab").select(*STOREY, "poly_id", "ring"))
    pairs = spatial.box_join(points, slabs, STOREY, spatial.inside(F.col("px"), F.col("py"), F.col("r_ring")))
    return pairs.select("model_id", "storey_id", "express_id", F.col("r_poly_id").alias("poly_id"))


def sample_grid(spark: SparkSession, folder: str) -> DataFrame:
    slabs = spatial.with_bbox(rings(Buildings(spark, folder), "slab"))
    return spatial.grid_points(slabs, 0.5).select("model_id", "poly_id", "px", "py")


def buffer_area(spark: SparkSession, folder: str) -> DataFrame:
    return rings(Buildings(spark, folder), "wall").select(
        "model_id", "poly_id", rounded(geometry.area(geometry.dilate(F.col("ring"), 0.05, 16)), 5).alias("area"))


def wall_strip(spark: SparkSession, folder: str) -> DataFrame:
    base = Buildings(spark, folder).element_base().where("ifc_type = 'IfcWall'")
    sx, sy = F.col("gx") * 0.5, F.col("gy") * 0.5
    ex, ey = (F.col("gx") + F.col("gw")) * 0.5, (F.col("gy") + F.col("gd")) * 0.5
    both = walls.strip_ring(sx, sy, ex, ey, F.lit(0.2))
    out = walls.strip_ring(sx, sy, ex, ey, F.lit(0.2), outward=True)
    rows = base.select("model_id", "express_id", both.alias("b"), out.alias("o"))
    return rows.select("model_id", "express_id", *[rounded(F.col(c)[i][a], 5).alias(f"{c}{a}{i}")
                                                   for c in "bo" for i in range(4) for a in "xy"])


def faulty_rings(polys: DataFrame) -> DataFrame:
    """Rectangles at an eighth of their size; of six, one crosses itself, one comes to its middle twice, one has a spike and one repeats points."""
    def at(i: int, dx: float = 0.0) -> Column:
        return F.struct((F.col("ring")[i]["x"] / 8 + dx).alias("x"), (F.col("ring")[i]["y"] / 8).alias("y"))

    low, high = F.col("ring")[0], F.col("ring")[2]
    middle = F.struct(((low["x"] + high["x"]) / 16).alias("x"), ((low["y"] + high["y"]) / 16).alias("y"))
    upper = F.struct((low["x"] / 8).alias("x"), ((low["y"] + 3 * high["y"]) / 32).alias("y"))
    kind = F.col("poly_id") % 6
    shape = F.when(kind == 1, F.array(at(0), at(2), at(1), upper)).when(
        kind == 2, F.array(at(0), at(1), middle, at(2), at(3), middle)).when(
        kind == 3, F.array(at(0), at(1, 0.5), at(1), at(2), at(3))).when(
        kind == 4, F.array(at(0), at(0), at(1), at(2), at(3), at(0))).otherwise(F.array(at(0), at(1), at(2), at(3)))
    return polys.withColumn("ring", shape)


def validate_outline(spark: SparkSession, folder: str) -> DataFrame:
    return outline.validate_outlines(faulty_rings(Buildings(spark, folder).footprints())).select(
        "model_id", "poly_id", rounded("area", 6).alias("area"), rounded("length", 6).alias("length"), "valid", "reason")


def simplified_ring(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles with a dent of 4 mm in each side, without it again."""
    def dented(r: Column) -> Column:
        def middle(i: int, dx: float, dy: float) -> Column:
            a, b = r[i], r[(i + 1) % 4]
            return F.struct(((a["x"] + b["x"]) / 2 + dx).alias("x"), ((a["y"] + b["y"]) / 2 + dy).alias("y"))
        return F.array(r[0], middle(0, 0, 0.004), r[1], middle(1, -0.004, 0), r[2], middle(2, 0, -0.004), r[3], middle(3, 0.004, 0))

    slabs = rings(Buildings(spark, folder), "slab").withColumn("ring", dented(F.col("ring")))
    alone = simplify.simplified(slabs, ["poly_id"])
    return alone.select("model_id", "poly_id", geometry.wkt(F.col("ring")).alias("ring_text"))


def degenerate_filter(spark: SparkSession, folder: str) -> DataFrame:
    ring = F.when(F.col("poly_id") % 7 == 0, None).when(F.col("poly_id") % 5 == 0, F.slice("ring", 1, 2)).when(
        F.col("poly_id") % 11 == 0, F.array(F.col("ring")[0], F.col("ring")[1], F.col("ring")[0])).otherwise(F.col("ring"))
    return outline.drop_degenerate(Buildings(spark, folder).footprints().withColumn("ring", ring)).select(
        "model_id", "poly_id")


def parts(b: Buildings) -> DataFrame:
    corner = F.struct((-F.col("poly_id")).cast("double").alias("a"), F.lit(0.0).alias("ya"))
    return b.footprints().select(*STOREY, F.col("poly_id").alias("part"),
                                 geometry.area(F.col("ring")).alias("area"), corner.alias("corner"))


def sliver_filter(spark: SparkSession, folder: str) -> DataFrame:
    return outline.sliver_filter(parts(Buildings(spark, folder)), STOREY).select(*STOREY, "part", "area")


def largest_part(spark: SparkSession, folder: str) -> DataFrame:
    return outline.largest_part(parts(Buildings(spark, folder)), STOREY)


def slab_union_area(spark: SparkSession, folder: str) -> DataFrame:
    polys = rings(Buildings(spark, folder), "slab").withColumn("layer", F.lit("a"))
    return overlay.overlay_areas(polys, STOREY).select(*STOREY, rounded("area_union", 4).alias("area"))


def outside_area(spark: SparkSession, folder: str) -> DataFrame:
    polys = Buildings(spark, folder).footprints().withColumn(
        "layer", F.when(F.col("layer") == "slab", "a").otherwise("b"))
    return overlay.overlay_areas(polys, STOREY).select(
        *STOREY, *[rounded(c, 4).alias(c) for c in ("area_a", "area_b", "area_union", "area_both", "area_a_only")])


def enclosed_outline(spark: SparkSession, folder: str) -> DataFrame:
    found = outline.enclosed_outline(rings(Buildings(spark, folder), "wall"), STOREY, k=MITRED)
    return found.measures.join(found.polygons(), STOREY, "left").select(
        *STOREY, rounded("area", 4).alias("area"), rounded("perimeter", 4).alias("perimeter"), "outline_polygon")


def external_walls(spark: SparkSession, folder: str) -> DataFrame:
    wall_rings = rings(Buildings(spark, folder), "wall")
    found = outline.enclosed_outline(wall_rings, STOREY, k=MITRED)
    return walls.external_walls(wall_rings, found.edges, STOREY).select(
        *STOREY, "poly_id", rounded("ratio", 4).alias("ratio"), "is_external")


def wall_thickness(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    sizes = features.extents(b.meshes().where("ifc_type = 'IfcWall'"))
    return walls.wall_thickness(b.models(), sizes).select("model_id", rounded("thickness", 4).alias("thickness"))


def building_centroid(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    ends = b.element_base().where("ifc_type = 'IfcWall'").select(
        "model_id", (F.col("gx") * 0.5).alias("sx"), (F.col("gy") * 0.5).alias("sy"),
        ((F.col("gx") + F.col("gw")) * 0.5).alias("ex"), ((F.col("gy") + F.col("gd")) * 0.5).alias("ey"))
    return walls.building_centroid(b.models(), ends).select(
        "model_id", rounded("cx", 4).alias("cx"), rounded("cy", 4).alias("cy"))


def rounded_points(df: DataFrame) -> DataFrame:
    return df.select("wall_id", "pt_ord", rounded("x", 5).alias("x"), rounded("y", 5).alias("y"))


def curve_thin(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_points(walls.thin_curve(Buildings(spark, folder).wall_curves(), 2.0))


def curve_smooth(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_points(walls.smooth_curve(Buildings(spark, folder).wall_curves().withColumn("x", F.col("x") / 4)))


def curve_guard(spark: SparkSession, folder: str) -> DataFrame:
    return rounded_points(walls.guard_curve(Buildings(spark, folder).wall_curves()))


def curve_offset(spark: SparkSession, folder: str) -> DataFrame:
    return walls.offset_curve(Buildings(spark, folder).wall_curves(), 0.1).select(
        "wall_id", "ring_ord", rounded("x", 5).alias("x"), rounded("y", 5).alias("y"))


QUERIES = {f.__name__: f for f in (
    convex_hull, ring_measures, point_in_polygon, sample_grid, buffer_area, wall_strip, validate_outline, simplified_ring,
    degenerate_filter, sliver_filter, largest_part, slab_union_area, outside_area, enclosed_outline, external_walls,
    wall_thickness, building_centroid, curve_thin, curve_smooth, curve_guard, curve_offset)}
