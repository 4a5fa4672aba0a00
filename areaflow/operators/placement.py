"""Global height and root of a placement chain by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.session import cut_lineage


def resolve_placements(placements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """model_id, placement_id, root_id, depth, z: each relative height counted once (sums are decimal); and rejects.

    Every round joins each pointer with the pointer it points at, so a chain of
    depth d takes about log2(d) equi-joins on (model_id, placement_id).  After as
    many rounds as the number of placements has binary digits every chain has ended;
    what still points on leads into a cycle and is rejected.
    """
    rounds = max(1, placements.count()).bit_length()
    state = placements.select(
        "model_id", "placement_id", F.col("parent_id").alias("up"), F.col("placement_id").alias("root_id"),
        F.lit(0).alias("depth"), F.col("dz").cast("decimal(18,6)").alias("z"))
    state = cut_lineage(state.withColumns({
        "root_id": F.coalesce("up", "root_id"),
        "depth": F.when(F.col("up").isNotNull(), 1).otherwise(0)}))
    # `z` covers the nodes from the placement up to, not including, `up`.
    for _ in range(rounds):
        ahead = state.select(F.col("model_id").alias("m2"), F.col("placement_id").alias("p2"),
                             F.col("up").alias("up2"), F.col("z").alias("z2"), F.col("depth").alias("d2"),
                             F.col("root_id").alias("r2"))
        state = cut_lineage(state.join(
            ahead, (F.col("model_id") == F.col("m2")) & (F.col("up") == F.col("p2")), "left").select(
            "model_id", "placement_id", F.col("up2").alias("up"),
            F.coalesce("r2", "root_id").alias("root_id"),
            (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            (F.col("z") + F.coalesce("z2", F.lit(0).cast("decimal(18,6)"))).cast("decimal(18,6)").alias("z")))
        if state.where("up is not null").isEmpty():
            break
    placed = state.where("up is null").drop("up").withColumn("z", F.col("z").cast("double"))
    return placed, state.where("up is not null").select("model_id", "placement_id")
