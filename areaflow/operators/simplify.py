"""A2 repair: fewer corners within a tolerance, without new crossings, in rounds of independent removals.

Rings of keys of usual size go through all rounds in one task; those of very large keys
go through rounds of Spark.  Both remove the same corners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.geometry import RING, cross
from areaflow.operators import spatial
from areaflow.operators.chunks import in_chunks
from areaflow.session import cut_lineage

TOLERANCE = 0.01
FEW_CORNERS = 6
LARGE_KEY = 20_000  # corners of a key beyond which its rings go through rounds of Spark
PAIRS = 4_000_000  # of corners and triangles that are looked at together in a task


def _segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(x - ax - t * dx, 2) + F.pow(y - ay - t * dy, 2))


def _with_cost(corners: DataFrame, tolerance: float) -> DataFrame:
    """Neighbours of each corner and the bound on the distance that its removal leaves; null where it must stay.

    err bounds how far the first ring runs from the edge behind a corner, so the cost
    is what both edges have already and the corner's distance from the new edge.
    """
    ring = Window.partitionBy("ring_no").orderBy("pos")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(c: str) -> Column:
        return F.coalesce(F.lag(c).over(ring), F.last(c).over(whole))

    def after(c: str) -> Column:
        return F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))

    near = corners.withColumns({"px": before("x"), "py": before("y"), "qx": after("x"), "qy": after("y"), "perr": before("err"),
                                "n": F.count("*").over(Window.partitionBy("ring_no"))})
    far = _segment_distance(*(F.col(c) for c in ("x", "y", "px", "py", "qx", "qy")))
    cost = F.greatest("err", "perr") + far
    priced = near.withColumn("cost", F.when((cost <= tolerance) & (F.col("n") > 3), cost))
    rank = F.struct(F.coalesce("cost", F.lit(float("inf"))).alias("c"), "pos")
    own = priced.withColumn("rank", rank)
    # A corner goes before its neighbours only if it is cheaper; a ring of few corners loses one at a time.
    low = F.when(F.col("n") <= FEW_CORNERS, F.min("rank").over(Window.partitionBy("ring_no"))).otherwise(
        F.least(before("rank"), after("rank")))
    return own.withColumn("least", low).withColumn("chosen", F.col("cost").isNotNull() & (F.col("rank") <= F.col("least"))).drop("least")


def _free(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Chosen corners whose triangle with both neighbours holds no other corner and meets no triangle chosen before it."""
    box = {f"{m}{a}": f(a, f"p{a}", f"q{a}") for m, f in (("min", F.least), ("max", F.greatest)) for a in "xy"}
    chosen = priced.where("chosen").withColumns(box)
    points = priced.select(*keys, F.col("ring_no").alias("v_ring"), F.col("pos").alias("v_pos"), F.col("x").alias("vx"), F.col("y").alias("vy"),
                           *[F.col(c).alias(m + c) for c in "xy" for m in ("min", "max")])

    def point(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    p, v, q, o = point("r_px", "r_py"), point("r_x", "r_y"), point("r_qx", "r_qy"), point("vx", "vy")
    sides = [cross(p, v, o), cross(v, q, o), cross(q, p, o)]
    same = [(F.col("vx") == F.col(f"r_{a}x")) & (F.col("vy") == F.col(f"r_{a}y")) for a in ("p", "q")]
    itself = ((F.col("vx") == F.col("r_x")) & (F.col("vy") == F.col("r_y")))
    within = (F.least(*sides) >= 0) | (F.greatest(*sides) <= 0)
    held = spatial.box_join(points, chosen, keys, within & ~same[0] & ~same[1] & ~itself).select(
        F.col("r_ring_no").alias("ring_no"), F.col("r_pos").alias("pos"))
    first = F.struct(F.col("rank"), F.col("ring_no"))
    later = F.struct(F.col("r_rank"), F.col("r_ring_no"))
    crowded = spatial.box_join(chosen, chosen, keys, first < later).select(
        F.col("r_ring_no").alias("ring_no"), F.col("r_pos").alias("pos"))
    return chosen.select("ring_no", "pos", "cost").join(held.unionByName(crowded).distinct(), ["ring_no", "pos"], "left_anti")


def in_rounds(rings: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """`simplified` in rounds of Spark, for keys of any size."""
    rows = cut_lineage(rings.withColumn("ring_no", F.monotonically_increasing_id()))
    corners = cut_lineage(rows.where(F.size("ring") >= 3).select(*keys, "ring_no", F.posexplode("ring").alias("pos", "p")).select(
        *keys, "ring_no", "pos", "p.x", "p.y", F.lit(0.0).alias("err")))
    while True:
        priced = cut_lineage(_with_cost(corners, tolerance))
        if priced.where("chosen").isEmpty():
            break
        gone = cut_lineage(_free(priced, keys))
        if gone.isEmpty():
            break
        # Marks meet their corners by grouping: Spark takes a join of joins for ever larger.
        marked = priced.select(*keys, "ring_no", "pos", "x", "y", "err").unionByName(
            gone.select("ring_no", "pos", F.col("cost").alias("gone")), allowMissingColumns=True).groupBy("ring_no", "pos").agg(
            *[F.max(c).alias(c) for c in (*keys, "x", "y", "err", "gone")])
        ring = Window.partitionBy("ring_no").orderBy("pos")
        following = F.coalesce(F.lead(F.struct("gone")).over(ring), F.first(F.struct("gone")).over(
            ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        corners = cut_lineage(marked.withColumn("err", F.coalesce(following["gone"], "err")).where("gone is null").drop("gone"))
    found = corners.groupBy("ring_no").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "x", "y"))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))).cast(RING).alias("_ring"))
    return rows.join(found, "ring_no", "left").withColumn("ring", F.coalesce("_ring", "ring")).drop("_ring", "ring_no")


def ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with low[i] <= j < high[i], some millions at a time."""
    n = high - low
    ends = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - n[a] + PAIRS, side="right")))
        i = np.repeat(np.arange(a, b), n[a:b])
        yield i, np.arange(len(i)) + (low - ends + n)[i] + ends[a] - n[a]
        a = b


def removable(key: np.ndarray, ring: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, err: np.ndarray,
              tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round, as in `_with_cost` and `_free`, over corners in the order of ring and pos.

    Returns the corners that go, those before them, and the costs of all.
    """
    m = len(ring)
    first = np.flatnonzero(np.append(True, ring[1:] != ring[:-1]))
    size = np.diff(np.append(first, m))
    before, after = np.arange(m) - 1, np.arange(m) + 1
    before[first], after[first + size - 1] = first + size - 1, first
    px, py, qx, qy, n = x[before], y[before], x[after], y[after], np.repeat(size, size)
    dx, dy = qx - px, qy - py
    square = dx * dx + dy * dy
    t = np.clip(np.divide((x - px) * dx + (y - py) * dy, square, out=np.zeros(m), where=square > 0), 0.0, 1.0)
    cost = np.maximum(err, err[before]) + np.sqrt((x - px - t * dx) ** 2 + (y - py - t * dy) ** 2)
    may = (cost <= tolerance) & (n > 3)
    rank = np.empty(m, np.int64)
    rank[np.lexsort((ring, pos, np.where(may, cost, np.inf)))] = np.arange(m)
    least = np.where(n <= FEW_CORNERS, np.repeat(np.minimum.reduceat(rank, first), size), np.minimum(rank[before], rank[after]))
    c = np.flatnonzero(may & (rank <= least))
    if not len(c):
        return c, c, cost
    # Along x corners and boxes are compared by the rank of their x, so one order holds all keys.
    xs, at = np.unique(x, return_inverse=True)
    place, three = key * len(xs) + at, (before[c], c, after[c])
    minx, maxx = (f.reduce([place[k] for k in three]) for f in (np.minimum, np.maximum))
    miny, maxy = (f.reduce([y[k] for k in three]) for f in (np.minimum, np.maximum))
    stays = np.zeros(len(c), bool)
    order = np.argsort(place, kind="stable")
    for i, j in ranges(np.searchsorted(place, minx, sorter=order), np.searchsorted(place, maxx, side="right", sorter=order)):
        j = order[j]
        near = (y[j] >= miny[i]) & (y[j] <= maxy[i]) & ~stays[i]
        i, j = i[near], j[near]
        p, v, q = ((x[k[i]], y[k[i]]) for k in three)
        o = (x[j], y[j])
        sides = [(b[0] - a[0]) * (o[1] - a[1]) - (b[1] - a[1]) * (o[0] - a[0]) for a, b in ((p, v), (v, q), (q, p))]
        within = (np.minimum.reduce(sides) >= 0) | (np.maximum.reduce(sides) <= 0)
        corner = np.logical_or.reduce([(o[0] == a[0]) & (o[1] == a[1]) for a in (p, v, q)])
        stays[i[within & ~corner]] = True
    order = np.argsort(minx, kind="stable")
    for i, j in ranges(np.arange(1, len(c) + 1), np.searchsorted(minx, maxx[order], side="right", sorter=order)):
        i, j = order[i], order[j]
        meet = (miny[i] <= maxy[j]) & (miny[j] <= maxy[i])
        i, j = i[meet], j[meet]
        stays[np.where(rank[c[i]] > rank[c[j]], i, j)] = True
    return c[~stays], before[c[~stays]], cost


def thinned(chunk: pa.Table, tolerance: float) -> pa.Table:
    """The rows of whole keys with their rings simplified."""
    column = chunk["ring"].combine_chunks()
    n = column.value_lengths().fill_null(0).to_numpy()
    points, start = column.flatten(), np.cumsum(n) - n
    ring = np.repeat(np.arange(len(n)), n)
    x, y = (points.field(a).to_numpy(zero_copy_only=False) for a in "xy")
    keys = chunk["_key"].to_numpy()
    key = np.cumsum(np.append(0, keys[1:] != keys[:-1]))[ring]
    kept, err = np.ones(len(ring), bool), np.zeros(len(ring))
    left = np.flatnonzero(n[ring] >= 3)
    while len(left):
        gone, before, cost = removable(key[left], ring[left], (left - start[ring[left]]), x[left], y[left], err[left], tolerance)
        err[left[before]] = cost[gone]
        kept[left[gone]] = False
        # A key that loses nothing in a round loses nothing in the next ones.
        left = left[kept[left] & np.isin(key[left], key[left[gone]])]
    sizes = np.bincount(ring[kept], minlength=len(n))
    rings = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), points.filter(pa.array(kept)), type=column.type,
                                     mask=column.is_null())
    return chunk.set_column(chunk.schema.get_field_index("ring"), chunk.schema.field("ring"), rings).drop_columns(["_key"])


def simplified(rings: DataFrame, keys: list[str], tolerance: float = TOLERANCE, large: int = LARGE_KEY) -> DataFrame:
    """The rings (column ring, other columns kept) with fewer corners, no point of a ring further than `tolerance` from its new border.

    Rings of the same keys are looked at together.  In each round corners go that are
    cheaper than both neighbours, whose triangle is empty and touches no other such
    triangle, so rings that were simple and apart stay so.  Rings keep three corners
    at least; null and shorter rings stay as they are.
    """
    rings = cut_lineage(rings.withColumn("ring", F.col("ring").cast(RING)))
    corners = F.coalesce(F.greatest(F.size("ring"), F.lit(1)), F.lit(1))
    many = cut_lineage(rings.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.sum(corners).alias("_n")).where(F.col("_n") > large).drop("_n"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    some = not many.isEmpty()
    usual = in_chunks(rings.join(many, same, "left_anti") if some else rings, keys, lambda chunk: thinned(chunk, tolerance), rings.schema,
                      weigh=lambda batch: len(batch) + len(batch["ring"].flatten()), whole=True)
    if not some:
        return usual
    far = rings.join(many, same, "left_semi").withColumn("_key", F.xxhash64(*keys))  # null keys meet in joins as well
    return usual.unionByName(in_rounds(far, ["_key"], tolerance).drop("_key"))
