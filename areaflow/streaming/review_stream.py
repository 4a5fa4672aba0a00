"""H4: review actions as a stream; the folded table equals the batch fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from areaflow.operators.review import KEY, apply_fold

ACTION_SCHEMA = ("model_id bigint, seq bigint, guid string, op string, new_type string, reason string, ts timestamp")


def action_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ACTION_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start_review_log(actions: DataFrame, table_folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Fold each micro-batch to one partial row per element and append it to the log table.

    A batch is written under its own id and overwritten on replay, so a restart adds
    nothing twice.  Partial rows combine in any order: the last update is decided by
    seq, not by arrival.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{table_folder}/batch={batch_id}")

    writer = actions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def partial(actions: DataFrame) -> DataFrame:
    """Partial fold of some actions: counts, last update, notes with their seq."""
    update = F.col("op") == "update"
    note = F.when(update & (F.length("reason") > 0), F.struct(
        "seq", F.concat(F.lit(" [Manual Edit: "), "reason", F.lit("]")).alias("note")))
    return actions.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_actions"), F.count_if(update).alias("n_updates"),
        F.max(F.when(update, F.struct("seq", "new_type"))).alias("last_update"), F.collect_list(note).alias("notes"))


def combined(log: DataFrame) -> DataFrame:
    """Partial rows of all batches as one row per element."""
    notes = F.array_sort(F.flatten(F.collect_list("notes")))
    return log.groupBy(*KEY).agg(
        F.sum("n_actions").alias("n_actions"), F.sum("n_updates").alias("n_updates"),
        F.max("last_update").alias("last_update"), notes.alias("notes")).select(
        *KEY, "n_actions", "n_updates", F.col("last_update.new_type").alias("last_type"),
        F.array_join(F.transform("notes", lambda n: n["note"]), "").alias("notes"))


def reviewed(alignment: DataFrame, log: DataFrame) -> DataFrame:
    """The alignment table as the log leaves it."""
    return apply_fold(alignment.join(combined(log), KEY, "left"))
