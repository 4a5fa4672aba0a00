"""Rows of whole keys in numpy: sorted by a hash of their key and handed to a task's function in bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areaflow.session import ship_package

CHUNK = 200_000


def key_chunks(batches: Iterator[pa.RecordBatch], rows: int, weigh: Callable[[pa.RecordBatch], int] = len) -> Iterator[pa.Table]:
    """Tables of about `rows` rows (or of that weight) that end where `_key` changes; only a key of more rows is cut inside."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += weigh(batch)
        if n >= rows:
            chunk = pa.Table.from_batches(held)
            keys = chunk["_key"].to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) or len(keys)
            yield chunk.slice(0, cut)
            held = chunk.slice(cut).to_batches()
            n = sum(map(weigh, held))
    if held:
        yield pa.Table.from_batches(held)


def in_chunks(df: DataFrame, keys: list[str], solve: Callable[[pa.Table], pa.Table], schema: str | StructType, rows: int | None = None,
              weigh: Callable[[pa.RecordBatch], int] = len, whole: bool = False) -> DataFrame:
    """`solve` over chunks of df, whose rows of the same keys are in one chunk unless there are too many of them.

    Partitions are rebalanced, so Spark splits one that a few large keys make too large;
    callers finish what a chunk does not hold whole.  With `whole` no partition is split:
    callers see to it that no key is larger than a chunk.
    """
    ship_package(df.sparkSession)
    size = rows or CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in key_chunks(batches, size, weigh):
            yield from solve(chunk).to_batches(max_chunksize=20_000)

    keyed = df.withColumn("_key", F.xxhash64(*keys))
    dealt = keyed.repartition("_key") if whole else keyed.hint("rebalance", F.col("_key"))
    return dealt.sortWithinPartitions("_key").mapInArrow(run, schema)
