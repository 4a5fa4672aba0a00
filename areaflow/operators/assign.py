"""Joins that put slabs, elements and walls on storeys.

The reference order "first window that holds z" makes the windows of one model
disjoint: only the lowest one keeps its tolerance.  So each element meets at most
one storey and the join needs no aggregation after it.  All joins are equi-joins
on model_id with a range residual; Spark picks broadcast or sort-merge by size,
and a model that owns many elements is split by the skew join of AQE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.operators.ordered import with_neighbours
from areaflow.operators.storeys import wall_tolerance

# Fixed values.
SLAB_TOLERANCE = 0.5
SEMANTIC_TOLERANCE = 0.1
OUTLINE_TOLERANCE = 0.1
ENVELOPE_TYPES = ["IfcWall", "IfcWallStandardCase", "IfcCurtainWall", "IfcPlate", "IfcCovering",
                  "IfcMember", "IfcColumn", "IfcBuildingElementProxy", "IfcWindow", "IfcDoor"]


def windows(storeys: DataFrame, tolerance: float) -> DataFrame:
    """Disjoint height windows [lo, hi) per storey; hi is null on the top storey."""
    lowest = F.col("prev_elevation").isNull()
    return storeys.select(
        F.col("model_id").alias("w_model"), F.col("storey_id").alias("w_storey"),
        (F.col("elevation") - F.when(lowest, tolerance).otherwise(0.0)).alias("lo"),
        F.col("next_elevation").alias("hi"))


def in_window(z: Column) -> Column:
    return (z >= F.col("lo")) & (F.col("hi").isNull() | (z < F.col("hi")))


def by_height(items: DataFrame, storeys: DataFrame, tolerance: float, how: str = "inner") -> DataFrame:
    """Storey whose window holds z_m."""
    w = windows(storeys, tolerance)
    return items.join(w, (F.col("model_id") == F.col("w_model")) & in_window(F.col("z_m")), how).withColumn(
        "storey_id", F.col("w_storey")).drop("w_model", "w_storey", "lo", "hi")


def slab_storey(slabs: DataFrame, contained_in: DataFrame, storeys: DataFrame) -> DataFrame:
    """Containment in a kept storey first, else the height window; unmatched slabs drop out."""
    kept = storeys.select(F.col("model_id").alias("k_model"), F.col("storey_id").alias("k_storey"))
    links = contained_in.join(kept, (F.col("model_id") == F.col("k_model")) & (
        F.col("parent_id") == F.col("k_storey"))).groupBy(
        F.col("model_id").alias("c_model"), F.col("child_id").alias("c_child")).agg(
        F.min("parent_id").alias("c_storey"))
    linked = slabs.join(links, (F.col("model_id") == F.col("c_model")) & (
        F.col("express_id") == F.col("c_child")), "left").drop("c_model", "c_child")
    placed = by_height(linked, storeys, SLAB_TOLERANCE, "left")
    return placed.withColumn("storey_id", F.coalesce("c_storey", "storey_id")).drop("c_storey").where(
        F.col("storey_id").isNotNull())


def slab_storey_asof(slabs: DataFrame, element_parents: DataFrame, storeys_all: DataFrame,
                     peak: int | None = None) -> DataFrame:
    """Storey whose placement is the parent of the slab's, else the storey at or below its middle."""
    s = with_neighbours(storeys_all, ["model_id"], ["elevation", "storey_id"], ["elevation"], peak)
    by_parent = s.select(F.col("model_id").alias("p_model"), F.col("placement_id").alias("p_placement"),
                         F.col("storey_id").alias("p_storey"))
    spans = s.select(F.col("model_id").alias("w_model"), F.col("storey_id").alias("w_storey"),
                     F.col("elevation").alias("lo"), F.col("next_elevation").alias("hi"))
    parents = element_parents.select("model_id", "express_id", "parent_id")
    first = slabs.join(parents, ["model_id", "express_id"], "left").join(
        by_parent, (F.col("model_id") == F.col("p_model")) & (F.col("parent_id") == F.col("p_placement")), "left")
    return first.join(spans, (F.col("model_id") == F.col("w_model")) & in_window(F.col("mid_z")), "left").select(
        "model_id", "express_id", F.coalesce("p_storey", "w_storey").alias("storey_id"))


def nearest_storey(walls: DataFrame, storeys: DataFrame, tolerance: float | None = None) -> DataFrame:
    """Nearest storey by elevation inside the tolerance of the model; the lower storey wins a tie.

    Half-way points between neighbours cut the height axis into disjoint windows,
    so this is a range join with one partner per wall.
    """
    e, below, above = F.col("elevation"), F.col("prev_elevation"), F.col("next_elevation")
    w = storeys.select(F.col("model_id").alias("w_model"), F.col("storey_id").alias("w_storey"),
                       e.alias("w_elev"), below.alias("w_below"), above.alias("w_above"))
    if tolerance is None:
        tol = wall_tolerance(storeys).select(F.col("model_id").alias("w_model"), F.col("tolerance").alias("w_tol"))
        w = w.join(tol, "w_model")
    else:
        w = w.withColumn("w_tol", F.lit(tolerance))
    z = F.col("z_m")
    own = F.abs(z - F.col("w_elev"))
    nearest = (F.col("w_below").isNull() | (own < F.abs(z - F.col("w_below")))) & (
        F.col("w_above").isNull() | (own <= F.abs(z - F.col("w_above"))))
    return walls.join(w, (F.col("model_id") == F.col("w_model")) & nearest & (own < F.col("w_tol"))).withColumn(
        "storey_id", F.col("w_storey")).drop("w_model", "w_storey", "w_below", "w_above", "w_tol").withColumnRenamed(
        "w_elev", "storey_elevation")


def envelope(elements: DataFrame) -> DataFrame:
    """The ten envelope classes as one scan, each element once."""
    return elements.where(F.col("ifc_type").isin(ENVELOPE_TYPES)).dropDuplicates(["model_id", "express_id"])


def outline_lookup(storeys: DataFrame, outlines: DataFrame) -> DataFrame:
    """First outline within 0.1 of the storey elevation; its area, or 0 without an outline.

    Both sides get a cell of twice the tolerance and outlines are copied to the
    neighbour cell they may reach, so the join is an equi-join on (model, cell).
    """
    cell = 2 * OUTLINE_TOLERANCE
    reach = OUTLINE_TOLERANCE * 1.001
    keys = F.sequence(F.floor((F.col("outline_elev") - reach) / cell), F.floor((F.col("outline_elev") + reach) / cell))
    spread = outlines.select(F.col("model_id").alias("o_model"), "outline_ord", "outline_elev", "outline_area",
                             F.explode(keys).alias("o_cell"))
    near = (F.col("model_id") == F.col("o_model")) & (F.floor(F.col("elevation") / cell) == F.col("o_cell")) & (
        F.abs(F.col("outline_elev") - F.col("elevation")) < OUTLINE_TOLERANCE)
    hits = storeys.select("model_id", "storey_id", "elevation").join(spread, near, "left")
    return hits.groupBy("model_id", "storey_id").agg(
        F.min_by("outline_ord", "outline_ord").alias("outline_ord"),
        F.coalesce(F.min_by("outline_area", "outline_ord"), F.lit(0.0)).alias("outline_area"))


def root_groups(storey_roots: DataFrame) -> DataFrame:
    """One elevation per root placement: the storey scanned last under that root."""
    return storey_roots.groupBy("model_id", "root_id").agg(
        F.round(F.max_by("raw_elevation", "storey_id"), 3).alias("root_key"))


def wall_grouping(walls: DataFrame, target_hits: DataFrame, roots: DataFrame,
                  bin_size: float = 1000.0) -> DataFrame:
    """One grouping key per wall from the first grouping that gives enough groups.

    Order of trial: target elevation (when any wall matches one), root placement,
    local height bins, global height bins; a grouping with one group or none hands
    over to the next one.  `walls` carries root_id, local_z and global_z in model
    units, `roots` the elevation of each root placement that owns a storey.
    """
    def bin_of(z: Column) -> Column:
        return F.round(z / bin_size) * bin_size

    target = target_hits.select("model_id", "express_id", F.col("storey_elevation").alias("target_key"))
    keyed = walls.join(target, ["model_id", "express_id"], "left").join(
        roots, ["model_id", "root_id"], "left").select(
        "model_id", "express_id", "target_key", "root_key",
        bin_of(F.col("local_z")).alias("local_key"), bin_of(F.col("global_z")).alias("global_key"))
    votes = keyed.groupBy("model_id").agg(
        F.count("target_key").alias("n_target"), F.count_distinct("local_key").alias("n_local"))
    n_root = roots.groupBy("model_id").agg(F.count_distinct("root_key").alias("n_root"))
    chosen = votes.join(n_root, "model_id", "left").select(
        "model_id", F.when(F.col("n_target") > 0, "target").when(F.col("n_root") > 1, "root").when(
            F.col("n_local") > 1, "local").otherwise("global").alias("grouping"))
    key = F.lit(None).cast("double")
    for g in ("target", "root", "local", "global"):
        key = F.when(F.col("grouping") == g, F.col(f"{g}_key")).otherwise(key)
    return keyed.join(chosen, "model_id").select(
        "model_id", "express_id", "grouping", key.alias("group_key")).where(F.col("group_key").isNotNull())


def walls_per_storey(walls: DataFrame, storeys: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Number of walls nearest to each storey, zero included."""
    hits = nearest_storey(walls, storeys, tolerance).groupBy("model_id", "storey_id").agg(
        F.count(F.lit(1)).alias("n"))
    return storeys.select("model_id", "storey_id", "elevation").join(
        hits, ["model_id", "storey_id"], "left").withColumn("n_walls", F.coalesce("n", F.lit(0))).drop("n")


def first_n(items: DataFrame, n: int) -> DataFrame:
    """O3: the first n rows of each model by id; Spark limits each group before the shuffle."""
    window = Window.partitionBy("model_id").orderBy("express_id")
    return items.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= n)
