"""Spatial tree from the root of each model down to contained elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.session import cut_lineage


def walk(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """model_id, node_id, node_type, depth, path for every node below the chosen root.

    The root is the first building of the model in tree order, else the first child
    of the top node, else the top node.  The tree is walked level by level: one
    equi-join of the frontier with the edges on (model_id, parent_id) per level.
    """
    tops = nodes.join(edges.select("model_id", F.col("child_id").alias("node_id")), ["model_id", "node_id"], "left_anti")
    start = tops.groupBy("model_id").agg(F.min_by(F.struct("node_id", "node_type"), "node_id").alias("t")).select(
        "model_id", "t.*")
    whole = descend(start, nodes, edges)
    building = F.min_by("node_id", F.when(F.col("node_type") == "IFCBUILDING", F.col("path")))
    child = F.min_by("node_id", F.when(F.col("depth") == 1, F.col("path")))
    roots = whole.groupBy("model_id").agg(F.coalesce(building, child, F.min_by("node_id", "path")).alias("node_id"))
    chosen = whole.join(roots, ["model_id", "node_id"]).select(
        "model_id", F.col("path").alias("root_path"), F.col("depth").alias("root_depth"))
    below = whole.join(chosen, "model_id").where(
        (F.col("path") == F.col("root_path")) | F.startswith(F.col("path"), F.concat("root_path", F.lit("/"))))
    return below.select("model_id", "node_id", "node_type", (F.col("depth") - F.col("root_depth")).alias("depth"),
                        F.expr("substring(path, length(root_path) - length(substring_index(root_path, '/', -1)) + 1)").alias("path"))


def descend(start: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes reachable from `start` with depth and path; ids in a path are padded so paths sort in tree order."""
    def pad(c: str):
        return F.lpad(F.col(c).cast("string"), 19, "0")

    kinds = nodes.select("model_id", F.col("node_id").alias("child_id"), F.col("node_type").alias("child_type"))
    step = cut_lineage(edges.join(kinds, ["model_id", "child_id"]))
    frontier = cut_lineage(start.select("model_id", "node_id", "node_type", F.lit(0).alias("depth"), pad("node_id").alias("path")))
    levels, depth = [frontier], 0
    while True:
        depth += 1
        below = frontier.select("model_id", F.col("node_id").alias("parent_id"), "path").join(step, ["model_id", "parent_id"])
        # A child that stands on its own path closes a cycle; the walk ends there.
        frontier = cut_lineage(below.where(~F.contains("path", pad("child_id"))).select(
            "model_id", F.col("child_id").alias("node_id"), F.col("child_type").alias("node_type"),
            F.lit(depth).alias("depth"), F.concat_ws("/", "path", pad("child_id")).alias("path")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
