"""H5: alignment over a stream of element features that can be stopped at any time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from areaflow.operators.classify import align

Scorer = Callable[[DataFrame], DataFrame]


def feature_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def start_alignment(features: DataFrame, scorer: Scorer, table_folder: str, checkpoint: str,
                    once: bool = True) -> StreamingQuery:
    """Score and calibrate each micro-batch; finished batches stay when the query is stopped.

    `scorer` maps features to parsed answers: the rule-based one, a join with stored
    replies, or a mapInPandas function around a remote model.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        align(batch, scorer(batch)).write.mode("overwrite").parquet(f"{table_folder}/batch={batch_id}")

    writer = features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
