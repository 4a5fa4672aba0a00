"""Registered queries: clearance, review, streams, spatial tree."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.functions.numbers import rounded
from areaflow.operators import assign, classify, clearance, hierarchy, regions, review, rings, storeys
from areaflow.operators.ordered import with_neighbours
from areaflow.plans.catalog_features import element_features
from areaflow.session import checkpoint_dir, cut_lineage
from areaflow.sources.derived import Buildings
from areaflow.streaming import align_stream as aligning
from areaflow.streaming import review_stream as reviewing

SLAB = ["model_id", "express_id"]
COVERS = ["IfcRoof", "IfcCovering"]


def mesh_footprint(spark: SparkSession, folder: str) -> DataFrame:
    border = clearance.face_border(Buildings(spark, folder).meshes().where("ifc_type = 'IfcSlab'"), "top")
    return clearance.footprint_area(border).select(*SLAB, rounded("area", 4).alias("area"), "n_edges")


def footprint_ring(spark: SparkSession, folder: str) -> DataFrame:
    """The ring of each slab's top, from its smallest corner on."""
    border = clearance.face_border(Buildings(spark, folder).meshes().where("ifc_type = 'IfcSlab'"), "top")
    return rings.polygon_text(rings.closed_edges(border, SLAB), SLAB).withColumnRenamed("outline_polygon", "footprint")


def section_lines(spark: SparkSession, folder: str) -> DataFrame:
    meshes = Buildings(spark, folder).meshes()
    low = F.array_min(clearance.axis(F.col("verts"), 2)) + 0.995
    faces = clearance.triangles(meshes.select(*SLAB, "verts", "faces", low.alias("section_z")))
    return clearance.section_lines(faces).groupBy(*SLAB).agg(
        F.count(F.lit(1)).alias("n_segments"),
        rounded(F.sum(F.col("length").cast("decimal(28,10)")), 4).alias("total_length"))


def slabs_of(b: Buildings) -> DataFrame:
    return clearance.solids(b.meshes().where("ifc_type = 'IfcSlab'"))


def covers_of(b: Buildings) -> DataFrame:
    meshes = b.meshes().where(F.col("ifc_type").isin(COVERS))
    return meshes, clearance.solids(meshes).withColumn("name", F.lit(None).cast("string"))


def slab_above(spark: SparkSession, folder: str) -> DataFrame:
    return clearance.nearest_above(slabs_of(Buildings(spark, folder)))


def nearest_above(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return clearance.nearest_above(slabs_of(b), covers_of(b)[1])


def ray_height(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    points = slabs_of(b).select(*SLAB, ((F.col("minx") + F.col("maxx")) / 2).alias("px"),
                                ((F.col("miny") + F.col("maxy")) / 2).alias("py"), F.col("max_z").alias("top"))
    hits = clearance.ray_hits(points, clearance.mesh_faces(covers_of(b)[0]))
    return hits.groupBy(*SLAB).agg(F.min("z").alias("z"))


class Headroom:
    """Clearance tables of all slabs."""

    def __init__(self, b: Buildings):
        meshes, covers = covers_of(b)
        self.slabs = slabs_of(b)
        self.above = cut_lineage(clearance.nearest_above(self.slabs))
        self.open = self.slabs.join(self.above.select(*SLAB), SLAB, "left_anti")
        self.candidates = cut_lineage(clearance.lowest_vertex_above(
            clearance.above_candidates(self.open, covers), meshes))
        self.faces = cut_lineage(clearance.mesh_faces(meshes))
        self.b = b

    def cleared(self) -> DataFrame:
        b = self.b
        every = with_neighbours(storeys.to_metres(b.storeys_raw(), b.models()), ["model_id"],
                                ["elevation", "storey_id"], ["elevation"])
        parents = b.placements().where("placement_id % 4 = 2").select(
            "model_id", F.expr("(placement_id - 2) div 4").alias("express_id"), "parent_id")
        homes = assign.slab_storey_asof(
            self.slabs.select(*SLAB, ((F.col("min_z") + F.col("max_z")) / 2.0).alias("mid_z")), parents,
            every.select("model_id", "storey_id", "placement_id", "elevation")).where("storey_id is not null")
        levels = homes.join(every.select("model_id", "storey_id", F.expr("nullif(next_elevation, 0.0)").alias(
            "next_elevation")), ["model_id", "storey_id"])
        effective = clearance.effective_heights(self.candidates, self.open, self.faces)
        return clearance.clearances(self.slabs, self.above, effective, levels)


def clearance_heights(spark: SparkSession, folder: str) -> DataFrame:
    return Headroom(Buildings(spark, folder)).cleared().select(
        *SLAB, "storey_id", rounded("min_clearance", 4).alias("min_clearance"))


def section_crossing(spark: SparkSession, folder: str) -> DataFrame:
    return clearance.section_crossing(Headroom(Buildings(spark, folder)).candidates).select(
        *SLAB, "other", rounded("min_z", 4).alias("min_z"), rounded("max_z", 4).alias("max_z"))


def clearance_class(spark: SparkSession, folder: str) -> DataFrame:
    h = Headroom(Buildings(spark, folder))
    samples = clearance.split_samples(h.open, clearance.section_crossing(h.candidates), h.faces)
    return clearance.clearance_classes(h.cleared(), samples).select(
        *SLAB, "storey_id", "height_class", rounded("high_share", 4).alias("high_share"))


def height_regions(spark: SparkSession, folder: str) -> DataFrame:
    h = Headroom(Buildings(spark, folder))
    cells = regions.region_cells(h.open, clearance.section_crossing(h.candidates), h.faces)
    return regions.height_regions(cells, h.open).select(
        *SLAB, "region", "height_class", "n_cells", rounded("area", 4).alias("area"), rounded("lowest", 4).alias("lowest"),
        rounded("highest", 4).alias("highest"))


def element_factor(spark: SparkSession, folder: str) -> DataFrame:
    return Buildings(spark, folder).alignment().select(
        "model_id", "guid", classify.element_factor(F.col("semantic_category"), F.col("manual_factor")).alias("calc_factor"),
        (F.col("status") == "NEEDS_REVIEW").alias("is_dirty"))


def manual_factor(spark: SparkSession, folder: str) -> DataFrame:
    return Buildings(spark, folder).review_actions().where("op = 'update'").select(
        "seq", "new_type", review.manual_factor(F.col("new_type")).alias("manual_factor"))


def element_view(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return review.element_view(b.element_base(), b.alignment())


REVIEWED = ["model_id", "guid", "semantic_category", "status", "manual_factor", "reasoning"]


def review_fold(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return review.apply_actions(b.alignment(), b.review_actions()).select(*REVIEWED)


def rejected_actions(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return review.rejected_actions(b.alignment(), b.review_actions()).select("model_id", "guid", "seq", "op")


def queue_after_review(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return review.queue_after_review(b.alignment(), b.review_actions()).select("model_id", "guid", "express_id", "type", "reason")


def review_counts(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return review.review_counts(b.alignment(), b.review_actions())


def scratch(spark: SparkSession) -> str:
    """A new folder on the shared checkpoint storage."""
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def review_stream(spark: SparkSession, folder: str) -> DataFrame:
    b, place = Buildings(spark, folder), scratch(spark)
    b.review_actions().repartition(4).write.parquet(f"{place}/in")
    query = reviewing.start_review_log(reviewing.action_stream(spark, f"{place}/in", 1), f"{place}/log", f"{place}/state")
    query.awaitTermination()
    return reviewing.reviewed(b.alignment(), spark.read.parquet(f"{place}/log")).select(*REVIEWED)


def align_stream(spark: SparkSession, folder: str) -> DataFrame:
    b, place = Buildings(spark, folder), scratch(spark)
    features = element_features(b)
    features.repartition(3).write.parquet(f"{place}/in")
    answers = classify.parse_replies(b.replies())
    query = aligning.start_alignment(aligning.feature_stream(spark, f"{place}/in", features.schema, 1),
                                     lambda batch: answers, f"{place}/out", f"{place}/state")
    query.awaitTermination()
    return spark.read.parquet(f"{place}/out").select(
        "model_id", "guid", "name", "ifc_type", "semantic_category", "confidence", "status", "reasoning",
        F.col("plan_area").alias("area"))


BASE_ID = 10 ** 15


def tree_tables(b: Buildings) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: project, site, building (every seventh model has none), storeys, contained elements."""
    m = F.col("model_id")
    project, site, building = BASE_ID + m * 10, BASE_ID + m * 10 + 1, BASE_ID + m * 10 + 2
    has_building = m % 7 != 0
    models = b.models().select("model_id")

    def node(df: DataFrame, i, t) -> DataFrame:
        return df.select("model_id", i.cast("bigint").alias("node_id"), t.alias("node_type"))

    store, elements = b.storeys_raw().select("model_id", "storey_id"), b.element_base()
    storey_id = 2 * BASE_ID + F.col("storey_id")
    nodes = node(models, project, F.lit("IFCPROJECT")).unionByName(node(models, site, F.lit("IFCSITE"))).unionByName(
        node(models.where(has_building), building, F.lit("IFCBUILDING"))).unionByName(
        node(store, storey_id, F.lit("IFCBUILDINGSTOREY"))).unionByName(
        node(elements.where("is_contained"), 3 * BASE_ID + F.col("express_id"), F.upper("ifc_type")))

    def edge(df: DataFrame, p, c) -> DataFrame:
        return df.select("model_id", p.cast("bigint").alias("parent_id"), c.cast("bigint").alias("child_id"))

    edges = edge(models, project, site).unionByName(edge(models.where(has_building), site, building)).unionByName(
        edge(store, F.when(has_building, building).otherwise(site), storey_id)).unionByName(
        edge(b.contained_in(), 2 * BASE_ID + F.col("parent_id"), 3 * BASE_ID + F.col("child_id")))
    return nodes, edges


def spatial_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.walk(*tree_tables(Buildings(spark, folder)))


QUERIES = {f.__name__: f for f in (
    mesh_footprint, footprint_ring, section_lines, slab_above, nearest_above, ray_height, section_crossing, clearance_class,
    height_regions,    element_factor, manual_factor, element_view, review_fold, rejected_actions, queue_after_review, review_counts,
    review_stream, align_stream, spatial_tree)} | {"clearance": clearance_heights}
