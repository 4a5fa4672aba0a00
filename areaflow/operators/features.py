"""Element features: mesh dimensions, external flag, space context, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.numbers import rounded
from areaflow.sources.meshes import axis

# Fixed values.
STOREY_SPAN = 3.5
STAIR_TYPES = ["IfcStair", "IfcRamp"]
TRANSPORT_TYPES = ["IfcTransportElement", "IfcElevator"]
WALL_TYPES = ["IfcWall", "IfcWallStandardCase"]
NODE_WORDS = {"IFCPROJECT": "Project Model", "IFCSITE": "Site", "IFCBUILDING": "Building"}


def extents(meshes: DataFrame) -> DataFrame:
    """Raw bounding-box sizes dx, dy, dz per element, computed inside the row: no shuffle."""
    def span(offset: int) -> Column:
        values = axis(F.col("verts"), offset)
        return F.array_max(values) - F.array_min(values)

    return meshes.where(F.size("verts") >= 3).select(
        "model_id", "express_id", "ifc_type", *[span(k).alias(n) for k, n in enumerate(("dx", "dy", "dz"))])


def dimensions(meshes: DataFrame) -> DataFrame:
    """Rounded box, plan width and depth, aspect ratio, and measures by class."""
    dx, dy, dz, kind = F.col("dx"), F.col("dy"), F.col("dz"), F.col("ifc_type")
    width, depth = F.least(dx, dy), F.greatest(dx, dy)
    return extents(meshes).select(
        "model_id", "express_id", "ifc_type",
        rounded(dx, 2).alias("bbox_dx"), rounded(dy, 2).alias("bbox_dy"), rounded(dz, 2).alias("bbox_dz"),
        rounded(dz, 2).alias("height"), rounded(width, 2).alias("width"), rounded(depth, 2).alias("depth"),
        F.when(width > 0.1, rounded(depth / width, 1)).otherwise(99.9).alias("aspect_ratio"),
        F.when(kind.isin("IfcSpace", "IfcOpeningElement"), rounded(dx * dy, 2)).otherwise(0.0).alias("area"),
        F.when(kind == "IfcSlab", rounded(dz, 2)).otherwise(0.0).alias("thickness"),
        rounded(dx * dy * dz, 2).alias("volume"))


def with_dimensions(elements: DataFrame, dims: DataFrame) -> DataFrame:
    """Elements without a mesh get zeros, aspect 1.0 and a note."""
    out = elements.join(dims.drop("ifc_type").withColumn("_has", F.lit(True)), ["model_id", "express_id"], "left")
    for c in ("bbox_dx", "bbox_dy", "bbox_dz", "height", "width", "depth", "area", "thickness", "volume"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out.withColumn("aspect_ratio", F.coalesce("aspect_ratio", F.lit(1.0))).withColumn(
        "note", F.when(F.col("_has").isNull(), "No Geometry")).drop("_has")


def external_flag(elements: DataFrame, psets: DataFrame) -> DataFrame:
    """P5: IsExternal of the first common property set that has it, upper case, else UNKNOWN."""
    has = psets.where(F.contains("pset", F.lit("Common")) & F.map_contains_key("props", "IsExternal"))
    flags = has.groupBy("model_id", "express_id").agg(F.min_by(
        F.upper(F.coalesce(F.col("props")["IsExternal"], F.lit("None"))), "pset_ord").alias("flag"))
    return elements.join(flags, ["model_id", "express_id"], "left").withColumn(
        "is_external", F.coalesce("flag", F.lit("UNKNOWN"))).drop("flag")


def floor_span(height: Column) -> Column:
    """Storeys spanned by an element."""
    return F.when(height > 0, rounded(height / STOREY_SPAN, 1)).otherwise(1.0)


def space_flags(contents: DataFrame) -> DataFrame:
    """What a space contains, from (model_id, space_id, child_type)."""
    t = F.col("child_type")
    stair, transport = t.isin(STAIR_TYPES), t.isin(TRANSPORT_TYPES)
    return contents.groupBy("model_id", "space_id").agg(
        F.bool_or(stair).alias("contains_stair"), F.bool_or(transport).alias("contains_transport"),
        F.bool_or(~stair & ~transport & t.contains("Flow")).alias("contains_mep"))


def boundary_material(bounds: DataFrame) -> DataFrame:
    """WALL when walls outnumber railings, else RAILING when there is one, else UNKNOWN."""
    counts = bounds.groupBy("model_id", "space_id").agg(
        F.count_if(F.col("element_type").isin(WALL_TYPES)).alias("walls"),
        F.count_if(F.col("element_type") == "IfcRailing").alias("railings"))
    return counts.withColumn("boundary_material", F.when(F.col("walls") > F.col("railings"), "WALL").when(
        F.col("railings") > 0, "RAILING").otherwise("UNKNOWN"))


def with_space_context(elements: DataFrame, flags: DataFrame, bounds: DataFrame) -> DataFrame:
    """Space flags and boundary material on spaces; other classes keep the defaults."""
    space = F.when(F.col("ifc_type") == "IfcSpace", F.col("express_id"))
    f = flags.select(F.col("model_id").alias("f_model"), F.col("space_id").alias("f_space"),
                     "contains_stair", "contains_transport", "contains_mep")
    b = bounds.select(F.col("model_id").alias("b_model"), F.col("space_id").alias("b_space"), "boundary_material")
    out = elements.withColumn("_space", space)
    out = out.join(f, (F.col("model_id") == F.col("f_model")) & (F.col("_space") == F.col("f_space")), "left")
    out = out.join(b, (F.col("model_id") == F.col("b_model")) & (F.col("_space") == F.col("b_space")), "left")
    for c in ("contains_stair", "contains_transport", "contains_mep"):
        out = out.withColumn(c, F.coalesce(c, F.lit(False)))
    return out.withColumn("boundary_material", F.coalesce("boundary_material", F.lit("UNKNOWN"))).withColumn(
        "floor_span", floor_span(F.col("height"))).drop("_space", "f_model", "f_space", "b_model", "b_space")


def node_name(name: Column, alt_name: Column, long_name: Column, node_type: Column, node_id: Column) -> Column:
    """Display name of a node of the spatial tree."""
    def given(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    chosen = F.coalesce(given(name), given(alt_name), given(long_name))
    word = F.lit(None).cast("string")
    for kind, text in NODE_WORDS.items():
        word = F.when(node_type == kind, text).otherwise(word)
    plain = chosen.isNull() | chosen.isin("Default", "Untitled")
    fallback = F.concat(F.coalesce(node_type, F.lit("Element")), F.lit(" ("),
                        F.coalesce(node_id.cast("string"), F.lit("?")), F.lit(")"))
    return F.coalesce(F.when(plain, word), chosen, fallback)


def entity_id(text: Column) -> Column:
    """The number of '#123=...'; null when there is none."""
    return F.regexp_extract(text, "#([0-9]+)", 1).try_cast("bigint")
