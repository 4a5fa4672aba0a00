"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import body_key, keep_one, ship_package, small_batches, table
from areaflow.session import cut_lineage

SLICE_BITS = 10
ROUTE_BITS = 20
SPACE_BYTES = b" \t\n\x0b\x0c\r"


# --- counting quotient filter: fingerprints of one slice as runs of sorted remainders ---

def build_filter(fingerprints: np.ndarray, quotient_bits: int) -> dict[str, np.ndarray]:
    """Filter of 64-bit fingerprints, split into quotient (high bits) and remainder.

    occupied holds the quotients in use, run_ends where the run of each ends, and
    remainders and counters the sorted remainders of the runs with their counts.
    Nothing of a fingerprint is lost.
    """
    values, counts = np.unique(fingerprints, return_counts=True)
    return pack(values, counts, quotient_bits)


def pack(values: np.ndarray, counts: np.ndarray, quotient_bits: int) -> dict[str, np.ndarray]:
    shift = np.uint64(64 - quotient_bits)
    quotients = values >> shift
    occupied, starts = np.unique(quotients, return_index=True)
    return {"occupied": occupied, "run_ends": np.append(starts[1:], len(values))[:len(occupied)].astype(np.int64),
            "remainders": values & np.uint64((1 << int(shift)) - 1), "counters": counts.astype(np.int64)}


def unpack(filter_: dict[str, np.ndarray], quotient_bits: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(filter_["run_ends"], prepend=0)
    quotients = np.repeat(filter_["occupied"], lengths)
    return (quotients << np.uint64(64 - quotient_bits)) | filter_["remainders"], filter_["counters"]


def merge_filters(filters: list[dict[str, np.ndarray]], quotient_bits: int) -> dict[str, np.ndarray]:
    """Merge by sorted remainders; counts of equal fingerprints add up."""
    parts = [unpack(f, quotient_bits) for f in filters]
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")  # runs that are sorted already: a merge
    values, counts = values[order], counts[order]
    if not len(values):
        return pack(values, counts, quotient_bits)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return pack(values[first], np.add.reduceat(counts, first), quotient_bits)


FIELDS = ["occupied", "run_ends", "remainders", "counters"]


def _filters_of_partition(bits: int, slice_bits: int):
    """One filter for each slice (high bits) of the fingerprints of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One fingerprint of 8 bytes a row; compacted while reading.
        seen = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        whole = build_filter(np.concatenate(seen) if seen else np.zeros(0, np.uint64), bits)
        values, counts = unpack(whole, bits)
        slices = values >> np.uint64(64 - slice_bits)
        at = np.append(np.flatnonzero(np.append(True, slices[1:] != slices[:-1])) if len(slices) else [], len(slices))
        rows = []
        for a, b in zip(at[:-1].astype(int), at[1:].astype(int)):
            part = pack(values[a:b], counts[a:b], bits)
            rows.append([int(slices[a])] + [part[k].tobytes() for k in FIELDS])
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32())] + [
                pa.array(c, pa.binary()) for c in columns[1:]], ["slice", *FIELDS])
    return run


def _merged_repeats(bits: int):
    """Fingerprints with a count above one, from all filters of each slice."""
    types = {"occupied": np.uint64, "run_ends": np.int64, "remainders": np.uint64, "counters": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new = {k: np.frombuffer(row[k], types[k]) for k in FIELDS}
                old = held.get(row["slice"])
                held[row["slice"]] = merge_filters([old, new], bits) if old else new
        for merged in held.values():
            values, counts = unpack(merged, bits)
            twice = values[counts > 1]
            yield pa.RecordBatch.from_arrays([pa.array(twice.view(np.int64))], ["fp"])
    return run


def repeated_fingerprints(facts: DataFrame, slice_bits: int = SLICE_BITS, quotient_bits: int = 32) -> DataFrame:
    """Fingerprints (`fp`) that two or more rows share: filters per partition, merged per slice of the value range."""
    ship_package(facts.sparkSession)
    filters = facts.select("fp").mapInArrow(
        _filters_of_partition(quotient_bits, slice_bits),
        "slice int, occupied binary, run_ends binary, remainders binary, counters binary")
    return filters.repartition("slice").mapInArrow(_merged_repeats(quotient_bits), "fp bigint")


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, SPACE_BYTES)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        norms = [normalised(t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("body"),
            pa.array([len(t or "") for t in texts], pa.int64()),
            pa.array(np.array([xxhash.xxh64_intdigest(n) for n in norms], np.uint64).view(np.int64)),
            pa.array([hashlib.sha256(n).hexdigest() for n in norms])], ["doc_id", "body", "n_code", "fp", "text_sha256"])


def _routed(route: np.ndarray, route_bits: int):
    """Rows whose fingerprint may be repeated, with the bytes of their normalised text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [normalised(t) for t in batch.column("text").to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(n) for n in norms], np.uint64)
            slot = fp & np.uint64((1 << route_bits) - 1)
            hit = np.flatnonzero((route[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            if len(hit):
                part = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("body"), pa.array([len(t or "") for t in part.column("text").to_pylist()], pa.int64()),
                    pa.array(fp[hit].view(np.int64)), pa.array([norms[i] for i in hit], pa.binary())],
                    ["doc_id", "body", "n_code", "fp", "bytes"])
    return run


def routing_bits(repeated: DataFrame, route_bits: int) -> np.ndarray:
    """Bitmap of 2^route_bits bits, set at the low bits of each repeated fingerprint; its size is fixed."""
    mask = (1 << route_bits) - 1
    words = repeated.select((F.col("fp").bitwiseAND(F.lit(mask))).alias("slot")).groupBy(
        F.expr("slot div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits"))
    route = np.zeros(1 << (route_bits - 3), np.uint8)
    got = words.toPandas()  # at most one row for each byte of the bitmap
    route[got["byte"].to_numpy(np.int64)] = got["bits"].to_numpy(np.uint8)
    return route


def exact_duplicates(docs: DataFrame, slice_bits: int = SLICE_BITS, route_bits: int = ROUTE_BITS) -> DataFrame:
    """One row per document: doc_id, body, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without [\\x20\\x09-\\x0D].  Rows whose 64-bit
    fingerprint has a filter count above one go to verification, which groups them by
    the bytes themselves; a routing bitmap of fixed size keeps other texts from being
    moved, and when it fills up more texts are verified, with the same result.  Of a
    group stays the row with most code points, then the smallest doc_id (null last).
    A null text is an empty one, and all empty texts are one group.  Rows that repeat
    the kept doc_id and text are all `kept`; `deduplicate` leaves one of them.  Only
    doc_id and text are read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", "text")
    facts = cut_lineage(source.withColumn("body", body_key()).mapInArrow(
        _facts, f"doc_id {id_type}, body bigint, n_code bigint, fp bigint, text_sha256 string"))
    repeated = cut_lineage(repeated_fingerprints(facts, slice_bits))
    route = routing_bits(repeated, route_bits)
    routed = source.withColumn("body", body_key()).mapInArrow(
        _routed(route, route_bits), f"doc_id {id_type}, body bigint, n_code bigint, fp bigint, bytes binary")
    rank = F.struct((-F.col("n_code")).alias("short"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                    F.col("body").alias("body"))
    groups = routed.withColumn("rank", rank).groupBy("fp", "bytes").agg(
        F.count("*").alias("group_size"), F.min("rank").alias("best")).where("group_size > 1").select(
        F.col("fp").alias("_fp"), F.sha2("bytes", 256).alias("_sha"), "group_size",
        F.col("best.id").alias("keep_id"), F.col("best.body").alias("keep_body"))
    joined = facts.join(groups, (F.col("fp") == F.col("_fp")) & (F.col("text_sha256") == F.col("_sha")), "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", "body", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("body") == F.col("keep_body")))).alias("kept"),
        "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of docs that stay, all columns: one of each group of equal texts."""
    return keep_one(docs, exact_duplicates(docs).select("doc_id", "body", "kept"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")
