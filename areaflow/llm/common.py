"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areaflow.session import cut_lineage, ship_package  # noqa: F401

# The white space of every contract here: [\x20\x09-\x0D], nothing else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def ascii_lower(word: Column) -> Column:
    """word with A-Z in lower case and every other letter as it is; cheap where the word is all ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(
        F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def body_key(text: str = "text") -> Column:
    """64-bit key of a text that tells a null from an empty one; used beside doc_id, never alone."""
    return F.xxhash64(F.col(text), F.col(text).isNull())


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Bound what an Arrow batch holds, so that very long texts fit a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that this job has written, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def first_by_hash(rows: DataFrame, hashed: Column, ties: list[str], n: int) -> DataFrame:
    """The n rows of smallest hash (a 64-bit one), then ties, of any number of rows.

    Rows are counted first, and those above a hash that leaves about 2 n are dropped
    where they are, so that what comes together for the order does not grow with the
    partitions.  If chance leaves fewer than n, the bound is raised.
    """
    rows = rows.withColumn("_hash", hashed)
    total = rows.count()
    share, low = min(1.0, 2 * n / max(total, 1)), rows
    while share < 1.0:
        low = rows.where(F.col("_hash") < int(-(1 << 63) + share * (1 << 64)))
        if low.count() >= n:
            break
        share, low = min(1.0, 2 * share), rows
    return low.orderBy("_hash", *ties).limit(n).drop("_hash")


def keep_copies(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of docs, each as often as `decisions` (doc_id, body, copies; one row a document) says.

    Documents are found again by doc_id (nulls match) and text.  Rows that repeat both
    are one document here, which stays as often as their copies add up to.  Other
    columns pass through whatever their names.
    """
    per = cut_lineage(decisions.groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).agg(
        F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows")))
    rows = docs.select(F.struct("*").alias("doc"), body_key().alias("_key"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_body"))
    staying = per.where("_copies > 0")
    found = rows.join(staying.where("_rows = 1"), same)
    if not staying.where("_rows > 1").isEmpty():
        again = rows.join(staying.where("_rows > 1"), same).withColumns({"_i": F.col("doc.doc_id"), "_k": F.col("_key")})
        found = found.unionByName(again.dropDuplicates(["_i", "_k"]).drop("_i", "_k"))
    return found.select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("doc.*")


def keep_one(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of docs that `decisions` (doc_id, body, kept) keeps; of rows that repeat doc_id and text one stays.

    What goes is the smaller side of the join, as a rule, and the documents that stay
    are not moved when it is small enough to be broadcast.
    """
    per = cut_lineage(decisions.groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "kept").agg(
        F.count("*").alias("_rows")))
    rows = docs.select(F.struct("*").alias("doc"), body_key().alias("_key"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_body"))
    found = rows.join(per.where("not kept or _rows > 1"), same, "left_anti")
    again = per.where("kept and _rows > 1")
    if not again.isEmpty():
        repeated = rows.join(again, same, "left_semi").withColumn("_i", F.col("doc.doc_id"))
        found = found.unionByName(repeated.dropDuplicates(["_i", "_key"]).drop("_i"))
    return found.select("doc.*")


def with_prefix_sums(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """Add before_<v>, the sum of v over all earlier rows, and total_<v>, its sum over all rows.

    Rows are range-partitioned by `order` and written once, so that partitions and
    their contents stay what they are.  Per-partition totals (one row for each
    partition, which bounds the broadcast) give the offsets, and running sums stay
    inside a partition.  Rows that tie on `order` may swap; a last key that numbers
    rows spreads them over partitions when one value holds most rows.
    """
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*[F.col(c).asc_nulls_first() for c in order], F.col("_tie")]
    ranged = cut_lineage(tie.repartitionByRange(*keys)).withColumn("_part", F.spark_partition_id())
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(everything).alias(f"total_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_r_{v}") for v in values])
    joined = running.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return joined.select(
        *df.columns, *[(F.col(f"_o_{v}") + F.col(f"_r_{v}")).alias(f"before_{v}") for v in values],
        *[F.col(f"total_{v}") for v in values])
