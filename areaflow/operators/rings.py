"""Rings from border edges: list ranking by pointer doubling, holes nested into shells, polygon text.

Border edges are directed with the region on their left, so shells run counter-clockwise
and holes clockwise.  Each edge learns the smallest edge of its ring and its distance to
it in rounds that double the stretch it has seen: in a task for keys of usual size, in
rounds of Spark where a key is too large for one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.geometry import RING, area, cross, let, signed_area, wkt
from areaflow.operators import spatial
from areaflow.operators.chunks import in_chunks
from areaflow.operators.simplify import simplified
from areaflow.session import cut_lineage

STRAIGHT = 1e-12
POINTS = ["x1", "y1", "x2", "y2"]


def closed_edges(edges: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Edges with snapped ends; pieces that run both ways cancel and points are no edges."""
    snapped = edges.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) for c in POINTS]).where(
        "x1 <> x2 or y1 <> y2")
    forward = F.struct("x1", "y1") < F.struct("x2", "y2")

    def pick(a: str, b: str) -> Column:
        return F.when(forward, F.col(a)).otherwise(F.col(b))

    summed = snapped.select(*keys, pick("x1", "x2").alias("xa"), pick("y1", "y2").alias("ya"), pick("x2", "x1").alias("xb"),
                            pick("y2", "y1").alias("yb"), F.when(forward, 1).otherwise(-1).alias("_s")).groupBy(
        *keys, "xa", "ya", "xb", "yb").agg(F.sum("_s").alias("_s")).where("_s <> 0")
    copies = summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("_s").cast("int"))))
    ahead = F.col("_s") > 0
    return copies.select(*keys, *[F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (
        ("x1", "xa", "xb"), ("y1", "ya", "yb"), ("x2", "xb", "xa"), ("y2", "yb", "ya"))])


def straightened(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges along an axis that follow one another as one edge each; the rings are the same, with fewer steps around them.

    Only a point that a single edge leaves is passed: where borders meet, all of them keep their ends.
    """
    level, upright = F.col("y1") == F.col("y2"), F.col("x1") == F.col("x2")
    kind = F.when(level, F.signum(F.col("x2") - F.col("x1"))).when(upright, 2 * F.signum(F.col("y2") - F.col("y1"))).otherwise(0.0)
    along = F.when(level, F.col("_kind") * F.col("x1")).otherwise(F.signum("_kind") * F.col("y1"))
    leaving = F.count(F.lit(1)).over(Window.partitionBy(*keys, "x1", "y1"))
    line = [*keys, "_kind", "_line"]
    up = Window.partitionBy(*line).orderBy("_at")
    rows = edges.select(*keys, *POINTS, leaving.alias("_n"), kind.alias("_kind")).withColumns(
        {"_line": F.when(level, F.col("y1")).otherwise(F.col("x1")), "_at": along})
    follows = (F.col("_kind") != 0) & (F.col("_n") == 1) & (F.lag("x2").over(up) == F.col("x1")) & (F.lag("y2").over(up) == F.col("y1"))
    runs = rows.withColumn("_s", F.when(follows, 0).otherwise(1)).withColumn(
        "_run", F.sum("_s").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*line, "_run").agg(
        F.min_by("x1", "_at").alias("x1"), F.min_by("y1", "_at").alias("y1"),
        F.max_by("x2", "_at").alias("x2"), F.max_by("y2", "_at").alias("y2")).select(*keys, *POINTS)


def successors(edges: DataFrame, keys: list[str], pinches: DataFrame | None = None) -> DataFrame:
    """id, nxt: the edge that goes on where an edge (keys, id, x1, y1, x2, y2) ends.

    Where several leave a point, the first one clockwise from the way back does, so
    that regions that touch at a corner keep rings of their own.  At `pinches` (keys,
    x2, y2) it is the first one the other way.  Edges without a next one (an open
    border) are left out.
    """
    leaving = edges.select(*keys, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("nxt"),
                           F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    back = F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))
    out = F.atan2(F.col("y3") - F.col("y2"), F.col("x3") - F.col("x2"))
    turn = F.pmod(back - out, F.lit(2 * math.pi))
    turn = F.when(turn < STRAIGHT, 2 * math.pi).otherwise(turn)
    meets = edges.join(leaving, [*keys, "x2", "y2"])
    if pinches is not None:
        meets = meets.join(pinches.withColumn("_pinch", F.lit(True)), [*keys, "x2", "y2"], "left")
        turn = F.when(F.col("_pinch"), 2 * math.pi - turn).otherwise(turn)
    return meets.groupBy("id").agg(F.min_by("nxt", F.struct(turn, "x3", "y3", "nxt")).alias("nxt"))


def walked(steps: pa.Table) -> pa.Table:
    """id, nxt, first, ahead for the edges of a chunk; first is null where a ring leaves the chunk.

    Pointers double as in `ranked`; one more place stands for the edges outside.
    """
    ids, nxt = steps["id"].to_numpy(), steps["nxt"].to_numpy()
    n = len(ids)
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, nxt, sorter=order), n - 1)]
    to = np.append(np.where(ids[at] == nxt, at, n), n)
    by_rank = np.lexsort([ids, *[steps[c].to_numpy() for c in reversed(POINTS)]])
    best = np.empty(n + 1, np.int64)
    best[by_rank], best[n] = np.arange(n), n
    ahead, reach = np.zeros(n + 1, np.int64), 1
    longest = np.unique(steps["_key"].to_numpy(), return_counts=True)[1].max()
    while reach < 2 * longest:
        other = best[to]
        ahead = np.where(other < best, ahead[to] + reach, ahead)
        best, to, reach = np.minimum(best, other), to[to], reach * 2
    return pa.table({"id": ids, "nxt": nxt, "first": pa.array(ids[by_rank[best[:n]]], mask=to[:n] == n), "ahead": ahead[:n]})


def ranked(edges: DataFrame, keys: list[str], pinches: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Edges with `first`, the smallest edge (by x1, y1, x2, y2, id) of their ring, and `ahead`, the steps to it.

    Rings of whole keys are walked where their edges lie, those of very large keys in
    rounds.  A round brings each edge together with the one at the end of the stretch it
    knows, which doubles the stretch; it ends when no edge learns of a smaller one, after
    the logarithm of the longest ring.  (Joins would do the same, but the size that Spark
    expects of a join is a product, which squares itself from round to round.)
    """
    edges = cut_lineage(edges.withColumn("id", F.monotonically_increasing_id()))
    steps = edges.join(successors(edges, keys, pinches), "id").select(*keys, "id", "nxt", *POINTS)
    near = cut_lineage(in_chunks(steps, keys, walked, "id bigint, nxt bigint, first bigint, ahead bigint", rows))
    whole = near.where("first is not null").select("id", "first", "ahead")
    far = near.where("first is null")
    if far.isEmpty():
        return edges.join(whole, "id")
    own = F.struct(*POINTS, "id")
    state = cut_lineage(edges.join(far.select("id", "nxt"), "id").select("id", "nxt", own.alias("first"), F.lit(0).cast("bigint").alias("ahead")))
    reach = 1
    while True:
        # Every edge is the next one of exactly one other: both meet under its id.
        asked = state.select(F.col("nxt").alias("k"), F.struct("id", "first", "ahead").alias("s"))
        told = state.select(F.col("id").alias("k"), F.struct("nxt", "first", "ahead").alias("t"))
        met = asked.unionByName(told, allowMissingColumns=True).groupBy("k").agg(F.max("s").alias("s"), F.max("t").alias("t"))
        smaller = F.col("t.first") < F.col("s.first")
        state = cut_lineage(met.select(
            "s.id", "t.nxt", F.least("s.first", "t.first").alias("first"),
            F.when(smaller, F.col("t.ahead") + reach).otherwise(F.col("s.ahead")).alias("ahead"), smaller.alias("learned")))
        reach *= 2
        if state.where("learned").isEmpty():
            return edges.join(whole.unionByName(state.select("id", F.col("first.id").alias("first"), "ahead")), "id")


def corners(ring: Column) -> Column:
    """The ring without points on a straight line between their neighbours."""
    def keep(r: Column) -> Column:
        n = F.size(r)
        return F.filter(r, lambda p, i: F.abs(cross(F.get(r, F.pmod(i - 1, n)), p, F.get(r, F.pmod(i + 1, n)))) > STRAIGHT)

    return let(ring, keep)


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ring_id, ring, is_hole: rings of closed border edges, each from its smallest point on, with its corners only.

    A ring that comes to a point twice is cut there into two, by another choice of the
    next edge at that point.
    """
    edges = cut_lineage(straightened(edges, keys))
    placed = ranked(edges, keys)
    pinches = placed.groupBy(*keys, F.col("first").alias("_ring"), F.col("x1").alias("x2"), F.col("y1").alias("y2")).agg(
        F.count("*").alias("_n")).where("_n > 1").select(*keys, "x2", "y2").distinct()
    pinches = cut_lineage(pinches)
    if not pinches.isEmpty():
        placed = ranked(edges, keys, pinches)
    points = F.array_sort(F.collect_list(F.struct(F.when(F.col("ahead") == 0, F.lit(None)).otherwise(-F.col("ahead")).alias("o"),
                                                  F.col("x1").alias("x"), F.col("y1").alias("y"))))
    # The first edge has no distance; array_sort puts nulls inside structs first.
    ring = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).cast(RING)
    built = placed.groupBy(*keys, F.col("first").alias("ring_id")).agg(ring.alias("_r")).select(
        *keys, "ring_id", corners(F.col("_r")).alias("ring"))
    return built.withColumn("is_hole", signed_area(F.col("ring")) < 0).where(F.size("ring") >= 3)


def polygons(edges: DataFrame, keys: list[str], tolerance: float | None = None) -> DataFrame:
    """keys, ring_id, shell, holes: each shell with the holes in it, smallest shell around a hole first.

    With a tolerance the rings of a key are simplified together, before holes are nested.
    """
    found = rings(edges, keys)
    found = cut_lineage(simplified(found, keys, tolerance) if tolerance else found)
    shells = found.where("not is_hole").select(*keys, "ring_id", "ring")
    a, b = F.col("ring")[0], F.col("ring")[1]
    # The middle of a hole's edge cannot lie on a shell: they meet at corners at most.
    holes = found.where("is_hole").select(*keys, F.col("ring").alias("hole"), ((a["x"] + b["x"]) / 2).alias("px"),
                                          ((a["y"] + b["y"]) / 2).alias("py"))
    points = holes.withColumns({"minx": F.col("px"), "maxx": F.col("px"), "miny": F.col("py"), "maxy": F.col("py"),
                                "hole_id": F.monotonically_increasing_id()})
    around = spatial.box_join(points, spatial.with_bbox(shells), keys, spatial.inside(F.col("px"), F.col("py"), F.col("r_ring")))
    held = around.groupBy(*keys, "hole_id").agg(
        F.min_by("r_ring_id", F.struct(area(F.col("r_ring")), "r_ring_id")).alias("ring_id"), F.first("hole").alias("hole"))
    inner = held.groupBy(*keys, "ring_id").agg(F.array_sort(F.collect_list("hole")).alias("holes"))
    return shells.withColumnRenamed("ring", "shell").join(inner, [*keys, "ring_id"], "left").withColumn(
        "holes", F.coalesce("holes", F.array().cast(f"array<{RING}>")))


def polygon_text(edges: DataFrame, keys: list[str], tolerance: float | None = None) -> DataFrame:
    """Keys, outline_polygon: POLYGON or, with several shells, MULTIPOLYGON text of the region inside the edges.

    Rings start at their leftmost, then lowest corner; shells follow each other in the
    order of these corners, and so do the holes of a shell.
    """
    def body(ring: Column) -> Column:
        return F.regexp_extract(wkt(ring), r"^POLYGON \((.*)\)$", 1)

    one = polygons(edges, keys, tolerance).withColumn("text", F.concat(F.lit("("), F.concat_ws(", ", body(F.col("shell")), F.transform("holes", body)), F.lit(")")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("shell", "text"))), lambda s: s["text"])
    return one.groupBy(*keys).agg(texts.alias("_t")).select(*keys, F.when(
        F.size("_t") == 1, F.concat(F.lit("POLYGON "), F.col("_t")[0])).otherwise(
        F.concat(F.lit("MULTIPOLYGON ("), F.array_join("_t", ", "), F.lit(")"))).alias("outline_polygon"))
