"""Contiguous shards of nearly equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import table, whole_text, with_prefix_sums

SHARDS = 40
ROW_BYTES = 16


def assign_shards(docs: DataFrame, n_shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """Shard and slot of every document, in ascending doc_id order (nulls first, then size and checksum).

    A row belongs to the shard that holds the middle of its byte range in the
    global order, so a shard differs from total / n_shards by less than its two
    border rows, and shards follow each other without gaps.  A null text has no
    bytes and keeps the row overhead; repeated rows count each; an empty table
    gives no rows; shards stay empty when single rows are larger than a share.
    Only doc_id and text are read, so further columns cannot clash.
    """
    rows = docs.select("doc_id", (F.octet_length(whole_text()) + row_bytes).cast("bigint").alias("size"),
                       F.crc32(whole_text().cast("binary")).alias("text_crc32"), F.lit(1).cast("bigint").alias("row"))
    placed = with_prefix_sums(rows, ["doc_id", "size", "text_crc32"], ["size", "row"]).withColumn(
        "shard", F.expr(f"cast((2 * before_size + size) * {n_shards} div (2 * total_size) as int)"))
    # One row for each shard.
    first = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("before_row").alias("_first"))
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(table(spark, folder, "documents"))
