"""SimHash near-dedup: fingerprints linked within a few bits through BK-trees of pigeonhole shards."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaflow.llm.common import body_key, keep_one, ship_package, small_batches, table
from areaflow.operators.components import smallest_reachable
from areaflow.session import cut_lineage

SHINGLE = 4
RADIUS = 4
SHARD_LOAD = 32
PAIRS_AT_ONCE = 2_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE_TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACE_TO_BLANK).translate(_LOWER).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(
        starts[:-shingle].tolist(), (starts[shingle:] - 1).tolist())), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(
                np.array(values, np.uint64).view(np.int64))], ["doc_id", "body", "fp"])
    return run


# --- a forest of BK-trees over one array of fingerprints ---

class Forest:
    """BK-trees, one for each shard: children hang at the integer Hamming distance to their parent.

    `values` are sorted by `shards`.  Trees are grown level by level: in each set of
    values that share a parent and a distance, the first becomes the child and the
    others go on below it.
    """

    def __init__(self, shards: np.ndarray, values: np.ndarray):
        n = len(values)
        self.values = values
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        group = np.cumsum(np.append(True, shards[1:] != shards[:-1])) - 1 if n else np.zeros(0, np.int64)
        self.root = np.searchsorted(group, group)  # first position of each shard
        waiting = np.flatnonzero(np.arange(n) != self.root)
        above = self.root[waiting]
        while len(waiting):
            apart = np.bitwise_count(values[waiting] ^ values[above]).astype(np.int64)
            order = np.lexsort((waiting, apart, above))
            waiting, above, apart = waiting[order], above[order], apart[order]
            first = np.append(True, (above[1:] != above[:-1]) | (apart[1:] != apart[:-1]))
            heads = np.flatnonzero(first)
            child = waiting[heads]
            self.parent[child], self.edge[child] = above[heads], apart[heads]
            below = child[np.cumsum(first) - 1]
            waiting, above = waiting[~first], below[~first]
        kids = np.flatnonzero(self.parent >= 0)
        order = np.lexsort((self.edge[kids], self.parent[kids]))
        self.kids = kids[order]
        # Children of a node by distance: keys parent * 65 + edge are sorted.
        self.keys = self.parent[self.kids] * 65 + self.edge[self.kids]

    def near(self, radius: int, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), j before i in the array, of one shard within `radius`; a bounded set at a time."""
        stack = [(np.arange(len(self.values)), self.root)]
        while stack:
            asked, node = stack.pop()
            if len(asked) > at_once:
                half = len(asked) // 2
                stack += [(asked[half:], node[half:]), (asked[:half], node[:half])]
                continue
            apart = np.bitwise_count(self.values[asked] ^ self.values[node]).astype(np.int64)
            hit = (apart <= radius) & (node < asked)
            if hit.any():
                yield asked[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(apart - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(apart + radius, 64), side="right")
            count = high - low
            if count.sum():
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                stack.append((np.repeat(asked, count), self.kids[np.repeat(low, count) + step]))


def roots_of(label: np.ndarray) -> np.ndarray:
    while True:
        up = label[label]
        if (up == label).all():
            return label
        label = up


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after uniting each a[k] with b[k]: larger roots hook to smaller ones until none differ."""
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        label = roots_of(label)


def _tree_links(radius: int, hold: int = 400_000):
    """Spanning links of each shard: every fingerprint to the first one it is connected with in the shard."""
    def links(shards: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((values, shards))
        values = values[order]
        forest = Forest(shards[order], values)
        label = np.arange(len(values))
        for a, b in forest.near(radius):
            label = hook(label, a, b)
        own = np.flatnonzero(label != np.arange(len(values)))
        return pa.RecordBatch.from_arrays([pa.array(values[own].view(np.int64)), pa.array(
            values[label[own]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # sorted by shard: all but the last shard are whole
            shards = np.append(shards, batch.column("shard").to_numpy())
            values = np.append(values, batch.column("fp").to_numpy().view(np.uint64))
            whole = np.searchsorted(shards, shards[-1]) if len(shards) >= hold else 0
            if whole:
                yield links(shards[:whole], values[:whole])
                shards, values = shards[whole:], values[whole:]
        if len(shards):
            yield links(shards, values)
    return run


def shard_plan(n: int, radius: int, load: int = SHARD_LOAD) -> list[int]:
    """Masks such that two fingerprints within `radius` bits agree on all bits of at least one mask.

    The 64 bits are cut into radius + k blocks; at most `radius` of them differ, so k
    agree.  The smallest k from 2 on is taken that leaves about `load` values on a shard
    when n values are spread evenly; every choice finds every pair.  With k of 2 a
    fingerprint goes to 15 shards for up to some 60 million of them.
    """
    for k in range(2, 5):
        blocks = radius + k
        if (64 * k // blocks >= np.log2(max(n, 1) / load)) or k == 4:
            cuts = [64 * i // blocks for i in range(blocks + 1)]
            parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
            masks = [sum(c) for c in combinations(parts, k)]
            assert len(masks) == comb(blocks, k)
            return masks


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_links(fingerprints: DataFrame, radius: int = RADIUS, load: int = SHARD_LOAD) -> DataFrame:
    """Links u, v between distinct fingerprints (`fp`) that connect all pairs within `radius` bits."""
    masks = shard_plan(fingerprints.count(), radius, load)
    spread = fingerprints.select("fp", F.explode(F.array(*[F.struct(
        F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits")) for i, m in enumerate(masks)])).alias(
        "s")).select("fp", F.xxhash64("s.mask", "s.bits").alias("shard"))
    # Shards that hold one value link nothing.
    return spread.repartition("shard").sortWithinPartitions("shard").mapInArrow(_tree_links(radius), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, load: int = SHARD_LOAD) -> DataFrame:
    """One row per document: doc_id, body, fingerprint, component_id (smallest doc_id reachable), kept.

    Fingerprints are taken over whole texts; rows with equal fingerprints meet as one,
    so copies never multiply.  Distinct fingerprints are dealt to shards on which every
    pair within the radius meets at least once; each shard is a BK-tree.  All trees of
    the corpus have no size bound, so a tree goes to the task of its shard and is not
    broadcast.  Null and empty texts have fingerprint zero, linked like any other.  A
    null doc_id counts as the largest; kept marks one doc_id and text of each component
    (rows that repeat both are marked alike).  Reads doc_id and text only.
    """
    spark = docs.sparkSession
    ship_package(spark)
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = cut_lineage(docs.select("doc_id", "text", body_key().alias("body")).mapInArrow(
        _fingerprints(shingle), f"doc_id {id_type}, body bigint, fp bigint"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("body").alias("body")))
    distinct = cut_lineage(prints.groupBy("fp").agg(first.alias("first")))
    labels = smallest_reachable(near_links(distinct.select("fp"), radius, load))
    rooted = distinct.join(labels, F.col("fp") == F.col("id"), "left").select(
        "fp", "first", F.coalesce("label", "fp").alias("label"))
    best = rooted.groupBy("label").agg(F.min("first").alias("best"))
    answer = rooted.select(F.col("fp").alias("_fp"), "label").join(best, "label").select("_fp", "best")
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("body").alias("body"))
    return prints.join(answer, F.col("fp") == F.col("_fp")).select(
        "doc_id", "body", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.id").alias("component_id"), mine.eqNullSafe(F.col("best")).alias("kept"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows of docs that stay, all columns: the first document of each component."""
    return keep_one(docs, near_duplicates(docs, shingle, radius).select("doc_id", "body", "kept"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")
