"""Connected components of links between ids, of any number of small and very large graphs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaflow.operators.chunks import in_chunks
from areaflow.session import cut_lineage


def components(nodes: DataFrame, links: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add `label`, the smallest id of the component, to nodes (unique `id`); links hold u, v, and keys if these part the graphs."""
    found = smallest_reachable(links) if keys is None else reachable_by_key(links, keys)
    joined = nodes.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return cut_lineage(joined.withColumn("label", F.coalesce("label", "id")).drop("_id"))


def smallest_reachable(links: DataFrame) -> DataFrame:
    """id, label: the smallest id connected with each id of the links (u, v), for ids that are not the smallest.

    Each round points every larger neighbour of a node at the smallest id around the
    node, then does the same with its smaller neighbours, until all links are stars.
    Rounds grow with the logarithm of the longest path.  Minima are aggregated before
    the shuffle and neighbours are never gathered in a row, so the centre of a large
    star is no single task's burden.
    """
    edges = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        "u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least("n", F.min("v")).alias("m"))
        # Large star: neighbours above n go to m; what is below goes on to the small star.
        large = both.where("v > u").join(low, F.col("u") == F.col("n")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("n")).select(
            F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select(
            F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct()
        edges = cut_lineage(small)
        # Stars: no centre is a leaf of another, and every leaf has one centre.
        leaves = edges.groupBy(F.col("u").alias("leaf")).agg(F.count("*").alias("centres"))
        open_ends = edges.select(F.col("v").alias("leaf")).distinct().join(leaves, "leaf", "left_semi")
        if leaves.where("centres > 1").isEmpty() and open_ends.isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def stars(links: pa.Table) -> pa.Table:
    """Links u, v of a chunk as stars: each id with the smallest one that the chunk connects it with."""
    ends = np.concatenate([links["u"].to_numpy(), links["v"].to_numpy()])
    ids, at = np.unique(ends, return_inverse=True)
    a, b = at[:len(links)], at[len(links):]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        a, b = low[apart], high[apart]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]
    leaf = root != np.arange(len(ids))
    return pa.table({"u": ids[leaf], "v": ids[root[leaf]]})


def reachable_by_key(links: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """smallest_reachable of links (keys, u, v) that never lead from one key to another.

    Graphs of whole keys are contracted where their links lie.  What several chunks hold
    parts of, a graph of a very large key, goes on in rounds.
    """
    found = cut_lineage(in_chunks(links.select(*keys, "u", "v"), keys, stars, "u bigint, v bigint", rows))
    roles = found.select(F.col("u").alias("n"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        found.select("v", F.lit(0), F.lit(1))).groupBy("n").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    # A star is whole when its centre is no leaf and its leaves have no other centre and are none.
    loose = cut_lineage(roles.where("leaf > 1 or (leaf = 1 and centre = 1)").select("n"))
    if loose.isEmpty():
        return found.select(F.col("u").alias("id"), F.col("v").alias("label"))
    joined = found.join(loose, F.col("u") == F.col("n"), "left_semi").select(F.col("v").alias("n")).union(loose).distinct()
    joined = cut_lineage(joined)
    whole = found.join(joined, F.col("v") == F.col("n"), "left_anti")
    rest = smallest_reachable(found.join(joined, F.col("v") == F.col("n"), "left_semi"))
    return whole.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(rest)
