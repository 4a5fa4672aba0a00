"""whether a single ring is a simple polygon, and why not.

Edges of a ring meet on a grid of its own, fine enough that a cell holds a few of them,
so a ring of many edges is not compared edge by edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.geometry import closed_next, cross, let
from areaflow.session import cut_lineage

TOO_FEW, SPIKE, CROSSES, TOUCHES = "fewer than 3 points", "spike", "crosses itself", "touches itself"
PAD = 1e-9


def without_repeats(ring: Column) -> Column:
    """The ring without points that equal the one before (the last one comes before the first)."""
    return let(ring, lambda r: F.filter(r, lambda p, i: (F.size(r) == 1) | (p != F.get(r, F.pmod(i - 1, F.size(r))))))


def has_spike(ring: Column) -> Column:
    """The border runs back over the edge it came by."""
    def spike(r: Column) -> Column:
        def at(i: Column) -> Column:
            return F.get(r, F.pmod(i, F.size(r)))

        def back(i: Column) -> Column:
            o, p, q = at(i - 1), at(i), at(i + 1)
            ahead = (p["x"] - o["x"]) * (q["x"] - p["x"]) + (p["y"] - o["y"]) * (q["y"] - p["y"])
            return (cross(o, p, q) == 0) & (ahead < 0)

        return F.exists(F.sequence(F.lit(0), F.size(r) - 1), back)

    return let(ring, spike)


def ring_cells(edges: DataFrame) -> DataFrame:
    """Copy each edge to the cells of its ring's grid (column `side`) that it runs through."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    columns = edges.withColumn("cx", F.explode(F.sequence(F.floor((low - PAD) / F.col("side")), F.floor((high + PAD) / F.col("side")))))
    left, right = F.greatest(low, F.col("cx") * F.col("side") - PAD), F.least(high, (F.col("cx") + 1) * F.col("side") + PAD)

    def y_at(x: Column) -> Column:
        return F.col("y1") + (x - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))

    steep = F.col("x1") == F.col("x2")
    bottom = F.when(steep, F.least("y1", "y2")).otherwise(F.least(y_at(left), y_at(right))) - PAD
    top = F.when(steep, F.greatest("y1", "y2")).otherwise(F.greatest(y_at(left), y_at(right))) + PAD
    return columns.withColumn("cy", F.explode(F.sequence(F.floor(bottom / F.col("side")), F.floor(top / F.col("side")))))


def meetings(edges: DataFrame) -> DataFrame:
    """ring_no, crosses: rings with edges that are no neighbours but share a point, and whether some pass through each other.

    Spark expects no more copies than edges and edges than rings, and would broadcast
    them all from the driver; so both sides are shuffled and sorted.
    """
    cells = ring_cells(edges)
    other = cells.hint("merge").select("ring_no", "cx", "cy", F.col("i").alias("j"), *[F.col(c).alias("o" + c) for c in ("x1", "y1", "x2", "y2")])

    def point(x: str, y: str) -> Column:
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    a, b, c, d = point("x1", "y1"), point("x2", "y2"), point("ox1", "oy1"), point("ox2", "oy2")
    one, two = cross(a, b, c) * cross(a, b, d), cross(c, d, a) * cross(c, d, b)
    boxes = (F.least("x1", "x2") <= F.greatest("ox1", "ox2")) & (F.least("ox1", "ox2") <= F.greatest("x1", "x2")) & (
        F.least("y1", "y2") <= F.greatest("oy1", "oy2")) & (F.least("oy1", "oy2") <= F.greatest("y1", "y2"))
    apart = (F.col("j") - F.col("i") > 1) & (F.col("j") - F.col("i") < F.col("n") - 1)
    met = cells.join(other, ["ring_no", "cx", "cy"]).where(apart & boxes & (one <= 0) & (two <= 0))
    return met.groupBy("ring_no").agg(F.bool_or((one < 0) & (two < 0)).alias("crosses"))


def with_shape_fault(polys: DataFrame) -> DataFrame:
    """Add `fault`, null for a simple ring: fewer than 3 points, spike, crosses itself or touches itself.

    Points that repeat the one before count once, the closing point too, and a null ring
    has none.  A point that the border comes to twice, or that lies on another edge, is
    touching.  Rows stay as they are and repeated rows are judged each; an empty table
    gives no rows.
    """
    names = polys.columns
    rows = cut_lineage(polys.select(F.struct("*").alias("row"), without_repeats(F.col("ring")).alias("points")).withColumn(
        "ring_no", F.monotonically_increasing_id()))
    proper = rows.where(F.size("points") >= 3).withColumn("n", F.size("points"))
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    extent = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    ends = F.arrays_zip(F.col("points").alias("a"), closed_next(F.col("points")).alias("b"))
    edges = proper.select("ring_no", "n", (extent / F.ceil(F.sqrt("n"))).alias("side"), F.posexplode(ends).alias("i", "e")).select(
        "ring_no", "n", "side", "i", F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    found = meetings(edges)
    few = F.coalesce(F.size("points") < 3, F.lit(True)) | F.col("points").isNull()
    again = F.size(F.array_distinct("points")) < F.size("points")
    fault = F.when(few, TOO_FEW).when(has_spike(F.col("points")), SPIKE).when(F.col("crosses"), CROSSES).when(
        again | F.col("crosses").isNotNull(), TOUCHES)
    return rows.join(found, "ring_no", "left").select("row", fault.alias("fault")).select(*[F.col("row")[c].alias(c) for c in names], "fault")
