"""Storey table: elevations in metres, greedy gap filter, heights, names, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.operators.ordered import greedy_keep, largest_key, with_neighbours, with_position

# Fixed values.
MIN_STOREY_GAP = 0.2
TOP_STOREY_HEIGHT = 3.0
ROOF_WORDS = ["屋顶", "屋面", "ROOF", "RF", "RL"]


def to_metres(storeys_raw: DataFrame, models: DataFrame) -> DataFrame:
    """Raw elevation times the unit scale of its model."""
    scale = models.select("model_id", "unit_scale")
    return storeys_raw.join(scale, "model_id").withColumn(
        "elevation", F.coalesce(F.col("raw_elevation") * F.col("unit_scale"), F.lit(0.0))).drop("unit_scale")


def greedy_gap(storeys: DataFrame, gap: float = MIN_STOREY_GAP, peak: int | None = None) -> DataFrame:
    """Walking upwards, keep a storey only when it is more than `gap` above the last kept one."""
    return greedy_keep(storeys, ["model_id"], ["elevation", "storey_id"],
                       lambda row, last: row["elevation"] - last["elevation"] > gap, peak=peak)


def storey_heights(kept: DataFrame, peak: int | None = None) -> DataFrame:
    """Next elevation minus own; the top storey gets the default height."""
    near = with_neighbours(kept, ["model_id"], ["elevation", "storey_id"], ["elevation"], peak)
    return near.withColumn("height", F.coalesce(
        F.col("next_elevation") - F.col("elevation"), F.lit(TOP_STOREY_HEIGHT)))


def storeys(storeys_raw: DataFrame, models: DataFrame) -> DataFrame:
    """Distinct storeys of every model with elevation, height and neighbours, in metres."""
    peak = largest_key(storeys_raw, ["model_id"])
    return storey_heights(greedy_gap(to_metres(storeys_raw, models), peak=peak), peak)


def is_roof(name: Column) -> Column:
    hit = F.lit(False)
    for word in ROOF_WORDS:
        hit = hit | F.upper(name).contains(word)
    return F.coalesce(hit, F.lit(False))


def drop_roofs(table: DataFrame) -> DataFrame:
    """leave out storeys whose name holds a roof word; a null name stays."""
    return table.where(~is_roof(F.col("name")))


def storey_names(storeys_raw: DataFrame) -> DataFrame:
    """P10: missing names become 'Level n' with n the place of the storey in its model."""
    placed = with_position(storeys_raw, ["model_id"], ["storey_id"], "n")
    given = F.when(F.length("name") > 0, F.col("name"))
    return placed.select(
        "model_id", "storey_id",
        F.replace(F.coalesce(given, F.concat(F.lit("Level "), F.col("n"))), F.lit("标高"), F.lit("Level")).alias(
            "display_name"))


def wall_tolerance(kept: DataFrame) -> DataFrame:
    """Smallest storey gap per model and the wall tolerance it implies."""
    near = kept if "next_elevation" in kept.columns else storey_heights(kept)
    gap = F.min(F.col("next_elevation") - F.col("elevation"))
    return near.groupBy("model_id").agg(gap.alias("min_gap")).withColumn(
        "tolerance", F.when(F.col("min_gap").isNull(), 2.0).otherwise(
            F.greatest(F.lit(1.5), F.col("min_gap") / 2.0)))
