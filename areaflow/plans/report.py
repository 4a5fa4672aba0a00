"""K1-K4: the report tables and their sinks.

Summary, story, detail and component tables are plain DataFrames written by Spark, one
file set each.  A storey is one row of the story table and one JSON document, however
many components it has; the same details stand as rows in a table of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.functions.numbers import exact_sum, float_text, rounded

NOTE = "See 'Detailed Components' sheet for full breakdown"


def summary(report: DataFrame, totals: DataFrame) -> DataFrame:
    """K1: item/value pairs per model, from rounded storey values."""
    sums = report.groupBy("model_id").agg(*[
        rounded(exact_sum(c), 2).alias(c) for c in ("area_full", "area_half", "area_excluded")])
    wide = totals.join(sums, "model_id").select(
        "model_id", F.col("regulation_applied").alias("v1"), float_text("total_area").alias("v2"),
        float_text("area_full").alias("v3"), float_text("area_half").alias("v4"),
        float_text("area_excluded").alias("v5"), F.col("story_count").cast("string").alias("v6"),
        F.lit(NOTE).alias("v7"))
    items = ["Region", "Total Calculated Area (sq.m)", "Total Full Area (100%)", "Total Half Area (50%)",
             "Total Excluded Area", "Story Count", "Note"]
    pairs = ", ".join(f"'{name}', v{i}" for i, name in enumerate(items, 1))
    return wide.selectExpr("model_id", f"stack({len(items)}, {pairs}) AS (item, value)")


def summary_date(pairs: DataFrame) -> DataFrame:
    """The run date as one more pair per model; kept apart so that `summary` is deterministic."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return pairs.where("item = 'Note'").select("model_id", F.lit("Date").alias("item"), now.alias("value"))


def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
    """model_id, storey_id and the values of each storey as one array, in component order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.col(value).alias("v"))))
    return rows.groupBy("model_id", "storey_id").agg(F.transform(ordered, lambda r: r["v"]).alias(name))


def details(component_rows: DataFrame) -> DataFrame:
    """Adjustment details, one row each."""
    return component_rows.where("detail is not null").select("model_id", "storey_id", "ord", "detail")


def stories(report: DataFrame, component_rows: DataFrame) -> DataFrame:
    """K2: one row per storey, its adjustment details joined by '; '."""
    joined = listed(details(component_rows), "detail", "_details")
    return report.join(joined, ["model_id", "storey_id"], "left").select(
        "model_id", "storey_id", "story_name", "elevation", "height",
        "base_area", "height_coefficient", "adjustments_area",
        F.coalesce(F.array_join("_details", "; "), F.lit("")).alias("adjustment_details"),
        "area_full", "area_half", "area_excluded", "calculated_area")


def component_sheet(report: DataFrame, component_rows: DataFrame) -> DataFrame:
    """K3: one row per component."""
    names = report.select("model_id", "storey_id", "story_name")
    return component_rows.join(names, ["model_id", "storey_id"]).select(
        "model_id", "storey_id", "story_name", "ord", "category", rounded("raw_area", 2).alias("raw_area"),
        "coefficient", rounded("effective_area", 2).alias("effective_area"), "note")


def json_documents(report: DataFrame, component_rows: DataFrame, totals: DataFrame, detail_rows: DataFrame) -> DataFrame:
    """K4: JSON text per storey, with the totals of its model, its components and its adjustment details."""
    item = F.struct("category", "raw_area", "coefficient", "effective_area", "note")
    parts = listed(component_rows.withColumn("_item", item), "_item", "components")
    notes = listed(details(detail_rows), "detail", "_details")
    empty = F.array().cast("array<string>")
    story = F.struct("story_name", "elevation", "height", "base_area", "height_coefficient", "adjustments_area",
                     F.coalesce("_details", empty).alias("adjustment_details"),
                     "calculated_area", "area_full", "area_half", "area_excluded", "outline_polygon", "components")
    return report.join(parts, ["model_id", "storey_id"]).join(notes, ["model_id", "storey_id"], "left").join(
        totals, "model_id").select("model_id", "storey_id", F.to_json(F.struct(
            "total_area", "regulation_applied", "summary_text", story.alias("story")), {"ignoreNullFields": "false"}).alias("json"))


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write each report table below `folder` in parallel files."""
    for name, df in tables.items():
        writer = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(f"{folder}/{name}")
