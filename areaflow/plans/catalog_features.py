"""Registered queries: sources, features, classification."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.functions import geometry
from areaflow.functions.numbers import rounded
from areaflow.operators import classify, clearance, features, rules
from areaflow.sources import meshes, model_files
from areaflow.session import checkpoint_dir
from areaflow.sources.derived import Buildings

SCANNED = ["IfcSpace", "IfcSlab"]


def scan_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Elements written as an exchange file, with marks of the format inside their names, and read from it."""
    e = Buildings(spark, folder).elements()
    text = F.concat(F.lit("#"), "express_id", F.lit("="), F.upper("ifc_type"), F.lit("('"), "guid", F.lit("',#"), "model_id",
                    F.lit(",'"), "name", F.lit("; it''s (a)',#"), "placement_id", F.lit(",(1.,(2.,$)));"))
    files = f"{checkpoint_dir(spark)}/exchange-{uuid.uuid4().hex}"
    e.select(text).write.text(files)
    out = model_files.parse_entities(model_files.read_statements(spark, files))
    return out.select(F.substring(F.get("args", 1), 2, 20).cast("bigint").alias("model_id"), "entity_id", "entity_type",
                      F.size("args").cast("bigint").alias("n_args"), F.get("args", 2).alias("arg_name"))


def scan_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return model_files.by_type(Buildings(spark, folder).elements(), SCANNED).select(
        "model_id", "express_id", "ifc_type", "name")


def mesh_explode(spark: SparkSession, folder: str) -> DataFrame:
    t = meshes.triangles(Buildings(spark, folder).meshes())
    corners = [F.col(f"p{i}.{a}").alias(f"{a}{i}") for i in (1, 2, 3) for a in "xyz"]
    return t.select("model_id", "express_id", "face", *corners)


def doc_text_concat(spark: SparkSession, folder: str) -> DataFrame:
    return meshes.document_text(Buildings(spark, folder).reg_pages()).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def pset_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return meshes.flatten_psets(Buildings(spark, folder).psets())


def containment_edges(spark: SparkSession, folder: str) -> DataFrame:
    return meshes.containment_edges(Buildings(spark, folder).rel_contained())


def dims(b: Buildings) -> DataFrame:
    return features.dimensions(b.meshes())


def bbox_dims(spark: SparkSession, folder: str) -> DataFrame:
    return dims(Buildings(spark, folder)).select("model_id", "express_id", "bbox_dx", "bbox_dy", "bbox_dz")


def aspect_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return dims(Buildings(spark, folder)).select("model_id", "express_id", "width", "depth", "aspect_ratio")


def typed_measures(spark: SparkSession, folder: str) -> DataFrame:
    return dims(Buildings(spark, folder)).select("model_id", "express_id", "ifc_type", "area", "thickness", "volume")


def missing_geometry(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    # A tenth of the elements goes without a mesh on purpose: that case is what the query is about.
    with_mesh = features.dimensions(b.meshes().where("express_id % 10 <> 3"))
    return features.with_dimensions(b.element_base().select("model_id", "express_id", "ifc_type"), with_mesh).select(
        "model_id", "express_id", "height", "area", "aspect_ratio", "note")


def is_external(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return features.external_flag(b.element_base().select("model_id", "express_id"), b.psets())


def floor_span(spark: SparkSession, folder: str) -> DataFrame:
    return dims(Buildings(spark, folder)).select(
        "model_id", "express_id", features.floor_span(F.col("height")).alias("floor_span"))


def space_flags(spark: SparkSession, folder: str) -> DataFrame:
    return features.space_flags(Buildings(spark, folder).space_contents())


def boundary_material(spark: SparkSession, folder: str) -> DataFrame:
    return features.boundary_material(Buildings(spark, folder).bounded_by())


def node_name(spark: SparkSession, folder: str) -> DataFrame:
    e, i = Buildings(spark, folder).elements(), F.col("express_id")
    kind = F.when(i % 97 == 0, "IFCPROJECT").when(i % 97 == 1, "IFCSITE").when(i % 97 == 2, "IFCBUILDING").when(
        i % 53 == 0, None).otherwise(F.upper("ifc_type"))
    given = F.when(i % 4 == 0, "Default").when(i % 4 == 1, None).otherwise(F.col("name"))
    long_name = F.when(i % 3 == 0, F.concat(F.lit("Long "), i))
    return e.select("model_id", "express_id", features.node_name(
        given, F.lit(None).cast("string"), long_name, kind, i).alias("node_name"))


def entity_id(spark: SparkSession, folder: str) -> DataFrame:
    e, i = Buildings(spark, folder).element_base(), F.col("express_id")
    text = F.when(i % 10 == 0, F.concat(F.lit("no id "), i)).otherwise(F.concat(F.lit("#"), i, F.lit("=IfcWall('x')")))
    return e.select("model_id", "express_id", features.entity_id(text).alias("entity_id"))


def rule_context(spark: SparkSession, folder: str) -> DataFrame:
    return rules.rule_context(Buildings(spark, folder).rules())


def ring_wkt(spark: SparkSession, folder: str) -> DataFrame:
    return Buildings(spark, folder).footprints().select(
        "model_id", "poly_id", geometry.wkt(F.col("ring")).alias("wkt"))


def dynamic_categories(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return classify.active_categories(b.table("region").select(F.col("r_name").alias("region")), b.rules()).select(
        "region", "cat_ord", "name", F.array_join("valid_types", ",").alias("valid_types"))


def element_features(b: Buildings) -> DataFrame:
    """All features of spaces and slabs.

    `area` is the measure calibration reads (spaces only); `plan_area` is the area
    the later stages read: the same for spaces, the footprint of the top faces for slabs.
    """
    e = b.elements().where(F.col("ifc_type").isin(SCANNED))
    f = features.with_dimensions(e, dims(b).where(F.col("ifc_type").isin(SCANNED)))
    f = features.external_flag(f, b.psets())
    f = features.with_space_context(f, features.space_flags(b.space_contents()),
                                    features.boundary_material(b.bounded_by()))
    slab_faces = clearance.face_border(b.meshes().where("ifc_type = 'IfcSlab'"), "top")
    plans = clearance.footprint_area(slab_faces).select("model_id", "express_id", F.col("area").alias("slab_area"))
    f = f.join(plans, ["model_id", "express_id"], "left").withColumn(
        "plan_area", rounded(F.coalesce("slab_area", "area"), 4)).drop("slab_area")
    f = f.join(b.models().select("model_id", "region"), "model_id")
    return f.withColumn("mode", classify.class_mode(F.col("ifc_type"), F.col("floor_span"), F.col("name")))


def class_mode(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    f = features.with_dimensions(b.elements(), dims(b))
    return f.select("model_id", "guid", classify.class_mode(
        F.col("ifc_type"), features.floor_span(F.col("height")), F.col("name")).alias("mode"))


def regions(b: Buildings) -> DataFrame:
    return b.table("region").select(F.col("r_name").alias("region"))


def candidate_features(b: Buildings) -> DataFrame:
    return classify.with_candidates(element_features(b), classify.active_categories(regions(b), b.rules()))


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    f = features.with_dimensions(b.elements(), dims(b)).join(b.models().select("model_id", "region"), "model_id")
    f = f.withColumn("mode", classify.class_mode(F.col("ifc_type"), features.floor_span(F.col("height")), F.col("name")))
    return classify.with_candidates(f, classify.active_categories(regions(b), b.rules())).select(
        "model_id", "guid", F.array_join("candidates", ",").alias("candidates"))


def prompt_rows(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    f = candidate_features(b).join(rules.rule_context(b.rules()), "region")
    ordered = F.array_sort(F.collect_list(F.struct("pset_ord", "pset", F.to_json("props").alias("props"))))
    texts = F.transform(ordered, lambda p: F.concat_ws(" ", p["pset"], p["props"]))
    every = b.psets().groupBy("model_id", "express_id").agg(F.array_join(texts, "; ").alias("psets_text"))
    return classify.prompt_rows(f.join(every, ["model_id", "express_id"], "left"))


def reply_parse(spark: SparkSession, folder: str) -> DataFrame:
    return classify.parse_replies(Buildings(spark, folder).replies())


def review_status(spark: SparkSession, folder: str) -> DataFrame:
    return Buildings(spark, folder).alignment().select(
        "model_id", "guid", classify.review_status(F.col("confidence")).alias("status"))


def scored(b: Buildings, mode: str, calibrate) -> DataFrame:
    f = element_features(b).where(F.col("mode") == mode).join(
        classify.parse_replies(b.replies()).where("not failed"), ["model_id", "guid"])
    return f.select("model_id", "guid", "category", "raw_confidence",
                    calibrate(classify.feature_columns()).alias("confidence"))


def calibrate_general(spark: SparkSession, folder: str) -> DataFrame:
    return scored(Buildings(spark, folder), "GENERAL", classify.calibrate_general)


def calibrate_vertical(spark: SparkSession, folder: str) -> DataFrame:
    return scored(Buildings(spark, folder), "VERTICAL", classify.calibrate_vertical)


def baseline_classify(spark: SparkSession, folder: str) -> DataFrame:
    return classify.baseline_classify(candidate_features(Buildings(spark, folder))).select(
        "model_id", "guid", "category", "raw_confidence")


def align(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return classify.align(element_features(b), classify.parse_replies(b.replies())).select(
        "model_id", "guid", "name", "ifc_type", "semantic_category", "confidence", "status", "reasoning",
        F.col("plan_area").alias("area"))


def latest_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = Buildings(spark, folder).alignment().select(
        "model_id", "guid", "semantic_category", "confidence", F.lit(1).alias("ord"))
    again = rows.where("cast(substring(guid, 2) as bigint) % 9 = 0").select(
        "model_id", "guid", F.lit("CORRIDOR").alias("semantic_category"), (F.col("confidence") / 2).alias("confidence"),
        F.lit(2).alias("ord"))
    return classify.latest(rows.unionByName(again), ["model_id", "guid"], "ord")


def alignment_meta(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    all_elements = b.element_base().where(F.col("ifc_type").isin(SCANNED))
    # Some elements go without an alignment on purpose, so that missing ones are counted.
    return classify.alignment_meta(all_elements, b.alignment().where("express_id % 43 <> 0"))


def confidence_hist(spark: SparkSession, folder: str) -> DataFrame:
    return classify.confidence_hist(Buildings(spark, folder).alignment())


def treatment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return classify.treatment_counts(Buildings(spark, folder).alignment())


def review_impact(spark: SparkSession, folder: str) -> DataFrame:
    return classify.review_impact(Buildings(spark, folder).alignment())


QUERIES = {f.__name__: f for f in (
    scan_entities, scan_by_type, mesh_explode, doc_text_concat, pset_flatten, containment_edges, bbox_dims,
    aspect_ratio, typed_measures, missing_geometry, is_external, floor_span, space_flags, boundary_material, node_name,
    entity_id, rule_context, ring_wkt, dynamic_categories, class_mode, candidates, prompt_rows, reply_parse,
    review_status, calibrate_general, calibrate_vertical, baseline_classify, align, latest_alignment, alignment_meta,
    confidence_hist, treatment_counts, review_impact)}
