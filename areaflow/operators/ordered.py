"""Ordered operators that hold when one key owns a large share of all rows.

Spark evaluates a window partition in one task.  Keys up to `HOT_ROWS` rows use
plain windows.  When a larger key exists, rows are range-partitioned by (key,
order), numbered inside each range, and the ranges are stitched by their counts,
so no task ever holds a whole key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.session import cut_lineage

HOT_ROWS = 1_000_000
CHUNK = 512


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest key: counted map-side, one number comes back."""
    return df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "pos",
                  peak: int | None = None) -> DataFrame:
    """Add the exact 1-based rank of each row inside its key. `order` must be unique per key.

    `peak` is the size of the largest key when the caller knows a bound for it.
    """
    if (largest_key(df, keys) if peak is None else peak) <= HOT_ROWS:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    ranged = cut_lineage(df.repartitionByRange(*keys, *order)).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = ranged.withColumn("_rn", F.row_number().over(inside))
    joined = numbered.join(offsets.withColumnsRenamed({k: f"_k_{k}" for k in keys} | {"_part": "_p"}),
                           same_keys(keys, "_k_") & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_rn") + F.col("_off")).alias(name))


def same_keys(keys: list[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(prefix + k))
    return cond


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str],
                    peak: int | None = None) -> DataFrame:
    """Add prev_<c> and next_<c> for each column, the values on the adjacent rows of the key."""
    peak = largest_key(df, keys) if peak is None else peak
    if peak <= HOT_ROWS:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.select("*", *[F.lag(c).over(window).alias(f"prev_{c}") for c in columns],
                         *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    ranked = cut_lineage(with_position(df, keys, order, "_pos", peak))
    out = ranked
    for side, step in (("prev", 1), ("next", -1)):
        other = ranked.select(*[F.col(k).alias(f"_k_{k}") for k in keys], (F.col("_pos") + step).alias("_q"),
                              *[F.col(c).alias(f"{side}_{c}") for c in columns])
        out = out.join(other, same_keys(keys, "_k_") & (F.col("_pos") == F.col("_q")), "left").drop(
            "_q", *[f"_k_{k}" for k in keys])
    return out.drop("_pos")


def greedy_keep(df: DataFrame, keys: list[str], order: list[str],
                keeps: Callable[[Column, Column], Column], chunk: int = CHUNK,
                peak: int | None = None) -> DataFrame:
    """Keep a row when `keeps(row, last kept row)` holds; the first row of a key is always kept.

    A key of up to `chunk` rows is folded as one sorted array.  Larger keys are cut
    into chunks by position.  A chunk is folded from the last kept row before it,
    which is first guessed and then replaced by the true exit of the previous chunk
    until no entry changes: the first chunk is right from the start, so the
    fixpoint is the sequential result.
    """
    peak = largest_key(df, keys) if peak is None else peak
    rest = [c for c in df.columns if c not in keys and c not in order]
    item = F.struct(*order, *rest)
    whole = peak <= chunk
    placed = df.withColumn("_chunk", F.lit(0)) if whole else with_position(df, keys, order, "_pos", peak).withColumn(
        "_chunk", F.floor((F.col("_pos") - 1) / chunk))
    chunks = placed.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    array_type = chunks.schema["_items"].dataType
    item_type = array_type.elementType

    def fold(entry: Column) -> Column:
        start = F.struct(entry.alias("last"), F.array().cast(array_type).alias("kept"))

        def step(acc, row):
            ok = acc["last"].isNull() | keeps(row, acc["last"])
            return F.when(ok, F.struct(row.alias("last"), F.concat(acc["kept"], F.array(row)).alias("kept"))).otherwise(acc)

        return F.aggregate("_items", start, step)

    def kept_rows(folded: DataFrame) -> DataFrame:
        rows = folded.select(*keys, F.explode("_f.kept").alias("_r"))
        return rows.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])

    nothing = F.lit(None).cast(item_type)
    if whole:
        return kept_rows(chunks.select(*keys, fold(nothing).alias("_f")))
    state = cut_lineage(chunks.withColumn("_entry", nothing))
    while True:
        done = state.select(*keys, "_chunk", "_items", "_entry", fold(F.col("_entry")).alias("_f"))
        exits = done.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                            (F.col("_chunk") + 1).alias("_c"), F.col("_f.last").alias("_exit"))
        moved = cut_lineage(done.join(
            exits, same_keys(keys, "_k_") & (F.col("_chunk") == F.col("_c")), "left").select(
            *keys, "_chunk", "_items", F.col("_exit").alias("_entry"),
            (~F.col("_exit").eqNullSafe(F.col("_entry"))).alias("_changed")))
        state = moved.drop("_changed")
        if moved.where("_changed").isEmpty():
            return kept_rows(state.select(*keys, fold(F.col("_entry")).alias("_f")))
