"""Flagship: regulated floor area of every storey of every model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.operators import area, assign, clearance, outline, overlay, storeys
from areaflow.operators.placement import resolve_placements
from areaflow.session import cut_lineage

STOREY = ["model_id", "storey_id"]


@dataclass
class ModelTables:
    """Inputs of one run; each table holds many models.

    models: model_id, region, unit_scale; storeys_raw: model_id, storey_id, name,
    raw_elevation; elements: model_id, express_id, ifc_type, z_m; meshes: model_id,
    express_id, ifc_type, verts, faces (metres); contained_in: model_id, parent_id,
    child_id; alignment: model_id, item_ord, category, area, manual_factor, z_m;
    rules: region, category, rule_ord, description, condition_logic, coefficient.
    """

    models: DataFrame
    storeys_raw: DataFrame
    elements: DataFrame
    meshes: DataFrame
    contained_in: DataFrame
    alignment: DataFrame
    rules: DataFrame


@dataclass
class AreaRun:
    """The tables of one area calculation."""

    facts: DataFrame
    parts: DataFrame
    sums: DataFrame
    polygons: DataFrame | None = None  # model_id, storey_id, outline_polygon, where the geometry gave outlines

    @property
    def report(self) -> DataFrame:
        """One row per storey; outline_polygon is null where there is no outline."""
        rows = area.storey_report(self.sums)
        if self.polygons is None:
            return rows.withColumn("outline_polygon", F.lit(None).cast("string"))
        return rows.join(self.polygons, STOREY, "left")

    def saved(self) -> AreaRun:
        """The same run with parts, sums and polygons written once, for callers that read several of its tables."""
        return AreaRun(self.facts, cut_lineage(self.parts), cut_lineage(self.sums),
                       None if self.polygons is None else cut_lineage(self.polygons))

    @property
    def components(self) -> DataFrame:
        return area.components(self.sums, self.parts)

    @property
    def totals(self) -> DataFrame:
        return area.model_total(self.report)


def positions(elements: DataFrame, placements: DataFrame, models: DataFrame) -> DataFrame:
    """Elements with z_m from their placement chain and the unit scale of the model."""
    z = resolve_placements(placements)[0].select("model_id", "placement_id", "z")
    scaled = elements.join(z, ["model_id", "placement_id"]).join(models.select("model_id", "unit_scale"), "model_id")
    return scaled.withColumn("z_m", F.col("z") * F.col("unit_scale")).drop("z", "unit_scale")


def calculate(storey_inputs: DataFrame, items: DataFrame, rule_rows: DataFrame, polygons: DataFrame | None = None) -> AreaRun:
    """Storeys with region, base and outside area, plus semantic items on storeys, to the report tables."""
    # Storeys are few next to elements and feed four joins: computed once, kept on shared storage.
    facts = cut_lineage(area.storey_facts(storeys.drop_roofs(storey_inputs), rule_rows))
    parts = area.adjustments(facts, items, rule_rows)
    sums = area.storey_sums(facts, parts)
    return AreaRun(facts, parts, sums, polygons)


def items_on_storeys(alignment: DataFrame, kept: DataFrame) -> DataFrame:
    """Semantic items put on storeys by height."""
    return assign.by_height(alignment, kept, assign.SEMANTIC_TOLERANCE).select(
        *STOREY, "item_ord", "category", "area", "manual_factor")


def storey_areas(t: ModelTables, kept: DataFrame, buffer_sides: int, tile: float | None) -> tuple[DataFrame, DataFrame]:
    """Base (enclosed) and outside (balcony) area per storey from the geometry, and the outlines as text."""
    shapes = clearance.solids(t.meshes.where(F.col("ifc_type").isin(assign.ENVELOPE_TYPES))).select(
        "model_id", "express_id", "ring")
    walls = assign.nearest_storey(assign.envelope(t.elements), kept).join(shapes, ["model_id", "express_id"]).select(
        *STOREY, F.col("express_id").alias("poly_id"), "ring")
    outlines = outline.enclosed_outline(walls, STOREY, k=buffer_sides, tile=tile)
    slabs = assign.slab_storey(t.elements.where("ifc_type = 'IfcSlab'"), t.contained_in, kept).select(
        *STOREY, "express_id")
    borders = clearance.face_border(t.meshes.where("ifc_type = 'IfcSlab'"), "top").join(
        slabs, ["model_id", "express_id"])
    # A storey without an outline has neither base nor outside area, so its slabs stay out of the overlay.
    with_outline = borders.join(outlines.measures.select(*STOREY), STOREY, "left_semi")
    cols = [*STOREY, "layer", "x1", "y1", "x2", "y2"]
    edges = with_outline.withColumn("layer", F.lit("a")).select(*cols).unionByName(
        outlines.edges.withColumn("layer", F.lit("b")).select(*cols))
    gaps = overlay.sweep(edges, STOREY, tile)
    outside = overlay.gap_sums(gaps, STOREY).select(*STOREY, F.col("area_a_only").alias("outside_area"))
    areas = outlines.measures.select(*STOREY, F.col("area").alias("base_area")).join(outside, STOREY, "left")
    return areas, outlines.polygons()


def floor_area(t: ModelTables, buffer_sides: int = 64, tile: float | None = overlay.TILE) -> AreaRun:
    """Storeys, outlines, slabs, semantics and rules to component rows, storey report and totals."""
    kept = cut_lineage(storeys.storeys(t.storeys_raw, t.models))
    areas, polygons = storey_areas(t, kept, buffer_sides, tile)
    inputs = kept.join(areas, STOREY, "left").join(t.models.select("model_id", "region"), "model_id").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("base_area", "outside_area")})
    return calculate(inputs, items_on_storeys(t.alignment, kept), t.rules, polygons)
