"""Registered queries: storeys and storey assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.functions.numbers import rounded
from areaflow.operators import assign, storeys
from areaflow.operators.placement import resolve_placements
from areaflow.sources.derived import Buildings


def kept_storeys(b: Buildings) -> DataFrame:
    return storeys.storeys(b.storeys_raw(), b.models())


def unit_scale(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return storeys.to_metres(b.storeys_raw(), b.models()).select(
        "model_id", "storey_id", rounded("elevation", 4).alias("elevation"))


def greedy_gap(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return storeys.greedy_gap(storeys.to_metres(b.storeys_raw(), b.models())).select(
        "model_id", "storey_id", rounded("elevation", 4).alias("elevation"))


def storey_height(spark: SparkSession, folder: str) -> DataFrame:
    return kept_storeys(Buildings(spark, folder)).select(
        "model_id", "storey_id", rounded("elevation", 4).alias("elevation"), rounded("height", 4).alias("height"))


def min_gap(spark: SparkSession, folder: str) -> DataFrame:
    return storeys.wall_tolerance(kept_storeys(Buildings(spark, folder))).select(
        "model_id", rounded("min_gap", 4).alias("min_gap"), rounded("tolerance", 4).alias("tolerance"))


def roof_filter(spark: SparkSession, folder: str) -> DataFrame:
    return storeys.drop_roofs(Buildings(spark, folder).storeys_raw()).select("model_id", "storey_id", "name")


def storey_name(spark: SparkSession, folder: str) -> DataFrame:
    return storeys.storey_names(Buildings(spark, folder).storeys_raw())


def slab_storey(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    slabs = b.element_z().where("ifc_type = 'IfcSlab'")
    return assign.slab_storey(slabs, b.contained_in(), kept_storeys(b)).select("model_id", "express_id", "storey_id")


def semantic_storey(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return assign.by_height(b.alignment(), kept_storeys(b), assign.SEMANTIC_TOLERANCE).select(
        "model_id", "guid", "storey_id")


def slab_storey_asof(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    base = b.element_base().where("ifc_type = 'IfcSlab'")
    slabs = base.select("model_id", "express_id", (
        (F.col("z_cm") / 100.0 + (F.col("z_cm") + F.col("h_cm")) / 100.0) / 2.0).alias("mid_z"))
    parents = b.placements().select("model_id", F.expr("(placement_id - 2) div 4").alias("express_id"), "parent_id",
                                    (F.col("placement_id") % 4).alias("kind")).where("kind = 2")
    return assign.slab_storey_asof(slabs, parents, storeys.to_metres(b.storeys_raw(), b.models()))


def nearest_storey(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return assign.nearest_storey(assign.envelope(b.element_z()), kept_storeys(b)).select(
        "model_id", "express_id", "storey_id", rounded("storey_elevation", 4).alias("storey_elevation"))


def outline_lookup(spark: SparkSession, folder: str) -> DataFrame:
    kept = kept_storeys(Buildings(spark, folder))
    outlines = kept.where("storey_id % 6 <> 0").select(
        "model_id", F.col("storey_id").alias("outline_ord"),
        (F.col("elevation") + (F.col("storey_id") % 5 - 2) * 0.06).alias("outline_elev"),
        (50.0 + F.col("storey_id") % 40).alias("outline_area"))
    return assign.outline_lookup(kept, outlines)


def wall_grouping(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    chains = resolve_placements(b.placements())[0]
    local = b.placements().select("model_id", "placement_id", F.col("dz").alias("local_z"))
    walls = assign.envelope(b.element_z()).withColumn("placement_id", F.col("express_id") * 4 + 2)
    full = walls.join(chains.select("model_id", "placement_id", "root_id", F.col("z").alias("global_z")),
                      ["model_id", "placement_id"]).join(local, ["model_id", "placement_id"])
    roots = assign.root_groups(b.storeys_raw().join(
        chains.select("model_id", "placement_id", "root_id"), ["model_id", "placement_id"]))
    hits = assign.nearest_storey(walls, kept_storeys(b), tolerance=0.01)
    return assign.wall_grouping(full, hits, roots).withColumn("group_key", rounded("group_key", 4))


def walls_per_storey(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return assign.walls_per_storey(assign.envelope(b.element_z()), kept_storeys(b)).select(
        "model_id", "storey_id", "n_walls")


def envelope_union(spark: SparkSession, folder: str) -> DataFrame:
    return assign.envelope(Buildings(spark, folder).element_z()).select("model_id", "express_id", "ifc_type")


def first_n(spark: SparkSession, folder: str) -> DataFrame:
    walls = Buildings(spark, folder).element_z().where("ifc_type = 'IfcWall'")
    return assign.first_n(walls, 5).select("model_id", "express_id", "rn")


def global_z(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_placements(Buildings(spark, folder).placements())[0].select(
        "model_id", "placement_id", "root_id", "depth", rounded("z", 4).alias("z"))


QUERIES = {f.__name__: f for f in (
    unit_scale, greedy_gap, storey_height, min_gap, roof_filter, storey_name, slab_storey, semantic_storey,
    slab_storey_asof, nearest_storey, outline_lookup, wall_grouping, walls_per_storey, envelope_union, first_n,
    global_z)}
