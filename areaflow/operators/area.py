"""Regulated area per storey: component arms, buckets, residual, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.numbers import exact_sum, float_text, rounded
from areaflow.operators.rules import balcony_coefficients, height_coefficients, special_matches

# Fixed values.
OUTSIDE_COEF = 0.5
OUTSIDE_TOLERANCE = 0.01
VOIDS = ["SHAFT", "VOID", "ATRIUM"]
SILENT = ["STAIRWELL", "ELEVATOR_SHAFT"]
OUTSIDE_NAME = "Geometric Balcony/Outside"
RESIDUAL_NAME = "General Floor Area (Enclosed)"
NOTES = {"outside": "Derived from geometry difference (Slab - Wall Outline)",
         "manual": "Manual Factor Override", "balcony": "Semantic Balcony Adjustment", "void": "Excluded/Void",
         "residual": "Remaining area after specific element adjustments"}
DEFAULT_REGION = "Unknown"

COMPONENT = ["model_id", "storey_id", "ord", "arm", "category", "raw_area", "coefficient", "effective_area", "note",
             "adjustment", "consumed", "to_full", "to_half", "to_excluded", "detail"]


def storey_facts(storeys: DataFrame, rules: DataFrame) -> DataFrame:
    """Storeys (with region, base_area, outside_area) with their height and balcony coefficients."""
    return balcony_coefficients(height_coefficients(storeys, rules), rules)


def arm_of(items: DataFrame, rules: DataFrame) -> DataFrame:
    """The arm an item takes; manual before balcony before void before special rule."""
    named = items.withColumn("category", F.upper("category"))
    pairs = named.where("category is not null").select("region", "category").distinct()
    matched = special_matches(pairs, rules)
    arm = F.when(F.col("category").isNull(), "none").when(F.col("manual_factor").isNotNull(), "manual").when(
        F.col("category").contains("BALCONY"), "balcony").when(F.col("category").isin(VOIDS), "void").when(
        F.col("category").isin(SILENT), "none").when(F.col("special_coef").isNotNull(), "special").otherwise("none")
    return named.join(matched, ["region", "category"], "left").withColumn("arm", arm)


def bucket_moves(k: Column, coef: Column, area: Column, arm: Column) -> dict[str, Column]:
    """Signed change of each bucket: leave the bucket of k, enter the bucket of coef."""
    leaves_excluded = arm.isin("manual", "balcony")
    out = {}
    for name, level in (("to_full", 1.0), ("to_half", 0.5), ("to_excluded", 0.0)):
        leave = (k == level) & (F.lit(level > 0) | leaves_excluded)
        out[name] = F.when(coef == level, area).otherwise(0.0) - F.when(leave, area).otherwise(0.0)
    return out


def item_components(items: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Component rows of semantic items: model_id, storey_id, item_ord, category, area, manual_factor."""
    levels = facts.select("model_id", "storey_id", "region", "height_coef", "balcony_coef")
    rows = arm_of(items.join(levels, ["model_id", "storey_id"]), rules).where("arm <> 'none'")
    k, arm, cat = F.col("height_coef"), F.col("arm"), F.col("category")
    area = F.coalesce("area", F.lit(0.0))
    coef = F.when(arm == "manual", F.col("manual_factor")).when(arm == "balcony", F.col("balcony_coef")).when(
        arm == "void", 0.0).otherwise(F.col("special_coef"))
    change = F.when(arm == "void", -area).when(arm == "special", area * (coef - 1.0)).otherwise(area * (coef - k))
    at, ct = float_text(area), float_text(coef)
    detail = F.when(arm == "manual", F.concat(F.lit("Manual Adjustment "), cat, F.lit(" ("), at, F.lit("m2 * "), ct, F.lit(")"))) \
        .when(arm == "balcony", F.concat(F.lit("Adjusted "), cat, F.lit(" ("), at, F.lit("m2 * "), ct,
                                         F.lit(" [Base "), float_text(k), F.lit("])"))) \
        .when(arm == "void", F.concat(F.lit("Subtracted "), cat, F.lit(" ("), at, F.lit("m2)"))) \
        .otherwise(F.concat(F.lit("Adjusted "), cat, F.lit(" ("), at, F.lit("m2 * "), ct, F.lit(")")))
    note = F.when(arm == "special", F.concat(F.lit("Special Rule: "), F.col("special_description")))
    for name in ("manual", "balcony", "void"):
        note = F.when(arm == name, NOTES[name]).otherwise(note)
    return rows.select(
        "model_id", "storey_id", (F.col("item_ord") + 2).alias("ord"), "arm", "category", area.alias("raw_area"),
        coef.alias("coefficient"), (area * coef).alias("effective_area"), note.alias("note"),
        change.alias("adjustment"), area.alias("consumed"),
        *[c.alias(n) for n, c in bucket_moves(k, coef, area, arm).items()], detail.alias("detail"))


def outside_components(facts: DataFrame) -> DataFrame:
    """F8: area outside the outline counts by half when above the tolerance."""
    a = F.col("outside_area")
    return facts.where(a > OUTSIDE_TOLERANCE).select(
        "model_id", "storey_id", F.lit(1).cast("bigint").alias("ord"), F.lit("outside").alias("arm"),
        F.lit(OUTSIDE_NAME).alias("category"), a.alias("raw_area"), F.lit(OUTSIDE_COEF).alias("coefficient"),
        (a * OUTSIDE_COEF).alias("effective_area"), F.lit(NOTES["outside"]).alias("note"),
        (a * OUTSIDE_COEF).alias("adjustment"), F.lit(0.0).alias("consumed"), F.lit(0.0).alias("to_full"),
        a.alias("to_half"), F.lit(0.0).alias("to_excluded"),
        F.concat(F.lit(OUTSIDE_NAME + " ("), float_text(rounded(a, 2)), F.lit(f"m2 * {OUTSIDE_COEF})")).alias("detail"))


def adjustments(facts: DataFrame, items: DataFrame, rules: DataFrame) -> DataFrame:
    """Outside and item components of all storeys."""
    return outside_components(facts).unionByName(item_components(items, facts, rules))


def storey_sums(facts: DataFrame, parts: DataFrame) -> DataFrame:
    """Summed adjustments, consumption and bucket moves per storey; storeys without parts keep zeros."""
    sums = parts.groupBy("model_id", "storey_id").agg(
        *[exact_sum(c).alias(c) for c in ("adjustment", "consumed", "to_full", "to_half", "to_excluded")],
        F.count(F.lit(1)).alias("n_parts"))
    out = facts.join(sums, ["model_id", "storey_id"], "left")
    for c in ("adjustment", "consumed", "to_full", "to_half", "to_excluded"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0.0)))
    return out.withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))


def residuals(sums: DataFrame) -> DataFrame:
    """What is left of the base area after its parts, first in each storey."""
    left = F.greatest(F.lit(0.0), F.col("base_area") - F.col("consumed"))
    zero = F.lit(0.0)
    return sums.select(
        "model_id", "storey_id", F.lit(0).cast("bigint").alias("ord"), F.lit("residual").alias("arm"),
        F.lit(RESIDUAL_NAME).alias("category"), left.alias("raw_area"), F.col("height_coef").alias("coefficient"),
        (left * F.col("height_coef")).alias("effective_area"), F.lit(NOTES["residual"]).alias("note"),
        zero.alias("adjustment"), zero.alias("consumed"), zero.alias("to_full"), zero.alias("to_half"),
        zero.alias("to_excluded"), F.lit(None).cast("string").alias("detail"))


def components(sums: DataFrame, parts: DataFrame) -> DataFrame:
    """All component rows: residual, outside, items; `ord` gives their order in a storey."""
    return residuals(sums).unionByName(parts)


def storey_report(sums: DataFrame) -> DataFrame:
    """One row per storey with unrounded `exact_area` for totals."""
    k, base = F.col("height_coef"), F.col("base_area")
    area = F.greatest(F.lit(0.0), base * k + F.col("adjustment"))

    def bucket(level: float, move: str) -> Column:
        return rounded(F.greatest(F.lit(0.0), F.when(k == level, base).otherwise(0.0) + F.col(move)), 2)

    return sums.select(
        "model_id", "region", "storey_id", F.col("name").alias("story_name"), rounded("elevation", 4).alias("elevation"),
        rounded("height", 4).alias("height"), rounded(base, 2).alias("base_area"), k.alias("height_coefficient"),
        rounded("adjustment", 2).alias("adjustments_area"), rounded(area, 2).alias("calculated_area"),
        bucket(1.0, "to_full").alias("area_full"), bucket(0.5, "to_half").alias("area_half"),
        bucket(0.0, "to_excluded").alias("area_excluded"), F.col("n_parts").cast("bigint").alias("n_parts"),
        area.alias("exact_area"))


def model_total(report: DataFrame) -> DataFrame:
    """Model totals from unrounded storey areas, with the summary sentence."""
    sums = report.groupBy("model_id").agg(
        F.coalesce(F.first("region", True), F.lit(DEFAULT_REGION)).alias("regulation_applied"),
        rounded(exact_sum("exact_area"), 2).alias("total_area"), F.count(F.lit(1)).alias("story_count"))
    return sums.withColumn("summary_text", F.concat(
        F.lit("Total Calculated Area: "), float_text("total_area"), F.lit(" sq.m across "), "story_count", F.lit(" stories.")))


def area_rollup(component_rows: DataFrame) -> DataFrame:
    """Component, storey and model level in one grouping-sets pass."""
    return component_rows.groupingSets(
        [["model_id", "storey_id", "category"], ["model_id", "storey_id"], ["model_id"]],
        "model_id", "storey_id", "category").agg(
        rounded(exact_sum("raw_area"), 2).alias("raw_area"), rounded(exact_sum("effective_area"), 2).alias("effective_area"),
        F.grouping_id().alias("level"))
