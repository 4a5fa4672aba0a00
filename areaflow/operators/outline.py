"""A2: enclosed outline of each storey from its wall polygons.

Hulls are widened by 5 cm, united, the largest connected part is narrowed by
5 cm again, slivers are dropped and holes filled.  Regions are sets of spans: a
span is a trapezoid between two sides in one strip of the overlay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.geometry import area, dilate, is_proper, perimeter
from areaflow.functions.numbers import exact_area
from areaflow.operators import overlay, rings
from areaflow.operators.components import components
from areaflow.operators.simplify import TOLERANCE
from areaflow.operators.validity import with_shape_fault
from areaflow.session import cut_lineage

# Fixed values.
BUFFER = 0.05
MIN_PART_AREA = 2.0
MIN_PART_SHARE = 0.1
MIN_OUTLINE_AREA = 0.1
MIN_OUTLINE_LENGTH = 1.0
THIN = 1e-7
RING_DIGITS = 6
SIDES = ["a", "b", "ya", "yb", "ta", "tb"]


def drop_degenerate(polys: DataFrame) -> DataFrame:
    """no ring, fewer than 3 points or no area."""
    return polys.where(is_proper(F.col("ring")))


def valid_outline(ring_area: Column, ring_length: Column) -> Column:
    """F3."""
    return (ring_area >= MIN_OUTLINE_AREA) & (ring_length >= MIN_OUTLINE_LENGTH)


def validate_outlines(polys: DataFrame) -> DataFrame:
    """F3 on single rings: area, length, the verdict and the reason against a ring; rejects keep their row.

    A fault of the shape comes before a small area, and that before a small length.
    """
    measured = with_shape_fault(polys).withColumn("area", area(F.col("ring"))).withColumn("length", perimeter(F.col("ring")))
    reason = F.coalesce("fault", F.when(F.col("area") < MIN_OUTLINE_AREA, "area").when(F.col("length") < MIN_OUTLINE_LENGTH, "length"))
    return measured.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("fault")


def biggest() -> Column:
    """The part of the largest area; among equals the leftmost, then lowest, corner decides."""
    return F.min_by("part", F.struct(-F.round("area", 6), "corner"))


def sliver_filter(parts: DataFrame, keys: list[str]) -> DataFrame:
    """parts above 2 m2 and a tenth of the largest; without any, the largest alone."""
    top = parts.groupBy(*keys).agg(F.max("area").alias("_max"), biggest().alias("_top"))
    keep = F.when(F.col("_max") > MIN_PART_AREA, (F.col("area") > MIN_PART_AREA) & (
        F.col("area") > MIN_PART_SHARE * F.col("_max"))).otherwise(F.col("part") == F.col("_top"))
    return parts.join(top, keys).where(keep).drop("_max", "_top")


def largest_part(parts: DataFrame, keys: list[str]) -> DataFrame:
    """O2: the largest part of each group."""
    return parts.groupBy(*keys).agg(biggest().alias("part"), F.max("area").alias("area"))


def covered_spans(gaps: DataFrame, keys: list[str], covered: Column) -> DataFrame:
    """Covered gaps of a strip merged into spans, each with the id of its bar."""
    strip = [*keys, "tile", "a", "b"]
    up = Window.partitionBy(*strip).orderBy(F.col("ya") + F.col("yb"), "ya")
    starts = F.when(covered & ~F.coalesce(F.lag(covered).over(up), F.lit(False)), 1).otherwise(0)
    runs = gaps.select(*strip, "ya", "yb", "ta", "tb", covered.alias("_in"), starts.alias("_s"))
    return cut_lineage(with_bars(merge_runs(runs, strip, keys, F.col("_in"), up), keys))


def with_bars(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Add `bar`, the same id for level spans of one height that follow each other from strip to strip.

    A bar is connected by itself, so components need one node for it instead of one for
    each strip.  Ids are given after the shuffle, in the stage that also reads them.
    """
    level = (F.col("ya") == F.col("yb")) & (F.col("ta") == F.col("tb"))
    same = [*keys, "ya", "yb", "ta", "tb"]
    along = Window.partitionBy(*same).orderBy("a")
    follows = level & (F.lag("b").over(along) == F.col("a"))
    runs = spans.withColumn("_s", F.when(follows, 0).otherwise(1)).withColumn(
        "_bar", F.sum("_s").over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_id", F.monotonically_increasing_id())
    return runs.withColumn("bar", F.min("_id").over(Window.partitionBy(*same, "_bar"))).drop("_s", "_bar", "_id")


def merge_runs(rows: DataFrame, strip: list[str], keys: list[str], use: Column, up) -> DataFrame:
    """Rows of a strip joined into one span from each row with _s = 1 to the next."""
    runs = rows.withColumn("_run", F.sum("_s").over(up.rowsBetween(Window.unboundedPreceding, 0))).where(use)
    low, top = F.col("ya") + F.col("yb"), F.col("ta") + F.col("tb")
    spans = runs.groupBy(*strip, "_run").agg(
        F.min_by("ya", low).alias("ya"), F.min_by("yb", low).alias("yb"),
        F.max_by("ta", top).alias("ta"), F.max_by("tb", top).alias("tb"))
    thick = (F.col("ta") - F.col("ya") > THIN) | (F.col("tb") - F.col("yb") > THIN)
    return spans.where(thick).select(*keys, *SIDES)


def united_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of spans that share their strips: overlapping or touching ones of a strip become one."""
    strip = [*keys, "a", "b"]
    low, top = F.col("ya") + F.col("yb"), F.col("ta") + F.col("tb")
    up = Window.partitionBy(*strip).orderBy(low, "ya", top)
    reach = F.max(top).over(up.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (low > reach + THIN), 1).otherwise(0)
    return cut_lineage(merge_runs(spans.select(*strip, "ya", "yb", "ta", "tb", starts.alias("_s")), strip, keys, F.lit(True), up))


def span_links(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Bars with spans of adjacent strips that share a piece of their common side (a corner is not enough)."""
    left = spans.select(*keys, F.col("b").alias("x"), F.col("bar").alias("u"), F.col("yb").alias("u_lo"), F.col("tb").alias("u_hi"))
    right = spans.select(*keys, F.col("a").alias("x"), F.col("bar").alias("v"), F.col("ya").alias("v_lo"), F.col("ta").alias("v_hi"))
    share = F.least("u_hi", "v_hi") - F.greatest("u_lo", "v_lo") > THIN
    return left.join(right, [*keys, "x"]).where(share & (F.col("u") != F.col("v"))).select(*keys, "u", "v")


def label_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (with_bars) with `label`, the same for all spans of a part."""
    return components(spans.withColumnRenamed("bar", "id"), span_links(spans, keys), keys)


def part_areas(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, F.col("label").alias("part")).agg(
        exact_area(overlay.gap_area()).alias("area"), F.min(F.struct("a", "ya")).alias("corner"))


def span_edges(spans: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """Lower and upper sides as directed edges of a counter-clockwise region."""
    sides = F.array(F.struct(F.col("a").alias("x1"), F.col("ya").alias("y1"), F.col("b").alias("x2"), F.col("yb").alias("y2")),
                    F.struct(F.col("b").alias("x1"), F.col("tb").alias("y1"), F.col("a").alias("x2"), F.col("ta").alias("y2")))
    return spans.select(*keys, F.lit(layer).alias("layer"), F.explode(sides).alias("e")).select(*keys, "layer", "e.*")


def upright_edges(spans: DataFrame, keys: list[str], thin: float = THIN) -> DataFrame:
    """Vertical border pieces: where only one of the two strips at an x is covered."""
    def ends(x: str, lo: str, hi: str, side: str) -> DataFrame:
        marks = F.array(F.struct(F.col(lo).alias("y"), F.lit(1).alias("s")), F.struct(F.col(hi).alias("y"), F.lit(-1).alias("s")))
        rows = spans.select(*keys, F.col(x).alias("x"), F.explode(marks).alias("m"))
        return rows.select(*keys, "x", "m.y", F.when(F.lit(side == "l"), F.col("m.s")).otherwise(0).alias("l"),
                           F.when(F.lit(side == "r"), F.col("m.s")).otherwise(0).alias("r"))

    marks = ends("b", "yb", "tb", "l").unionByName(ends("a", "ya", "ta", "r")).groupBy(*keys, "x", "y").agg(
        F.sum("l").alias("l"), F.sum("r").alias("r"))
    up = Window.partitionBy(*keys, "x").orderBy("y")
    run = up.rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.select(*keys, "x", "y", F.lead("y").over(up).alias("top"),
                         (F.sum("l").over(run) > 0).alias("in_l"), (F.sum("r").over(run) > 0).alias("in_r"))
    border = swept.where((F.col("in_l") != F.col("in_r")) & (F.col("top") - F.col("y") > thin))
    rises = F.col("in_l")  # covered on the left: the border runs upwards
    return border.select(*keys, F.col("x").alias("x1"), F.when(rises, F.col("y")).otherwise(F.col("top")).alias("y1"),
                         F.col("x").alias("x2"), F.when(rises, F.col("top")).otherwise(F.col("y")).alias("y2"))


def border_edges(spans: DataFrame, keys: list[str]) -> DataFrame:
    return span_edges(spans, keys, "a").drop("layer").unionByName(upright_edges(spans, keys))


def ring_border(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The border as closed edges to chain: corners are snapped first, so that none of the pieces between them is missing."""
    snapped = spans.select(*keys, *[F.round(c, RING_DIGITS).alias(c) for c in ("a", "b", "ya", "yb", "ta", "tb")])
    edges = span_edges(snapped, keys, "a").drop("layer").unionByName(upright_edges(snapped, keys, 0.0))
    return rings.closed_edges(edges, keys, RING_DIGITS)


def bars(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled spans with those of a bar joined into one: the same region, with the strips' ends gone."""
    return spans.groupBy(*keys, F.col("id"), "ya", "yb", "ta", "tb").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("id")


def erode(spans: DataFrame, keys: list[str], distance: float, k: int, tile: float | None) -> DataFrame:
    """Region minus the capsules of its border edges, as gaps of a new sweep.

    Straight borders are joined first: a capsule for each piece would cover the same and
    add its ends to the strips of the sweep.
    """
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    border = rings.straightened(border_edges(spans, keys).distinct(), keys)
    capsules = border.select(*keys, F.lit("b").alias("layer"), F.lit(0).alias("poly_id"), dilate(ends, distance, k).alias("ring"))
    edges = span_edges(spans, keys, "a").unionByName(overlay.ring_edges(capsules, keys).drop("poly_id"))
    return overlay.sweep(edges, keys, tile)


def hole_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between the spans of one part that no path connects to its outside."""
    up = Window.partitionBy(*keys, "a", "b").orderBy(F.col("ya") + F.col("yb"), "ya")
    gaps = spans.select(*keys, "a", "b", F.col("ta").alias("ya"), F.col("tb").alias("yb"),
                        F.lead("ya").over(up).alias("ta"), F.lead("yb").over(up).alias("tb")).where("ta is not null")
    holes = cut_lineage(with_bars(gaps.where((F.col("ta") - F.col("ya") > THIN) | (F.col("tb") - F.col("yb") > THIN)), keys))
    if holes.isEmpty():
        return holes.select(*keys, *SIDES)
    labelled = label_spans(holes, keys)
    # Only the strips of parts with a gap are looked at.
    strip = spans.join(holes.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "a", "b").agg(
        F.min("ya").alias("lo_a"), F.min("yb").alias("lo_b"), F.max("ta").alias("hi_a"), F.max("tb").alias("hi_b"))
    before = strip.select(*keys, F.col("b").alias("a"), F.col("lo_b").alias("l_lo"), F.col("hi_b").alias("l_hi"))
    after = strip.select(*keys, F.col("a").alias("b"), F.col("lo_a").alias("r_lo"), F.col("hi_a").alias("r_hi"))
    seen = labelled.join(before, [*keys, "a"], "left").join(after, [*keys, "b"], "left")

    def leaks(lo: str, hi: str, next_lo: str, next_hi: str) -> Column:
        wide = F.col(hi) - F.col(lo) > THIN
        return wide & (F.col(next_lo).isNull() | (F.col(lo) < F.col(next_lo) - THIN) | (F.col(hi) > F.col(next_hi) + THIN))

    out = leaks("ya", "ta", "l_lo", "l_hi") | leaks("yb", "tb", "r_lo", "r_hi")
    closed = seen.groupBy(*keys, "label").agg(F.bool_or(out).alias("leaks")).where("not leaks").drop("leaks")
    return labelled.join(closed, [*keys, "label"], "left_semi").select(*keys, *SIDES)


@dataclass
class Outlines:
    """Measures per group, the directed border edges of the outlines and their spans."""

    measures: DataFrame
    edges: DataFrame
    spans: DataFrame
    keys: list[str]

    def polygons(self, tolerance: float | None = TOLERANCE) -> DataFrame:
        """keys, outline_polygon: the text of each outline, simplified by `tolerance`; the measures are those of all corners."""
        return rings.polygon_text(ring_border(self.spans, self.keys), self.keys, tolerance)


def enclosed_outline(walls: DataFrame, keys: list[str], distance: float = BUFFER, k: int = 64,
                     tile: float | None = overlay.TILE) -> Outlines:
    """Outlines from convex wall rings. `k` is the number of directions of the buffer; 4 is a mitred square."""
    wide = drop_degenerate(walls).select(*keys, F.lit("a").alias("layer"), "poly_id",
                                         dilate(F.col("ring"), distance, k).alias("ring"))
    merged = covered_spans(overlay.sweep(overlay.ring_edges(wide, keys), keys, tile), keys, F.col("da") > 0)
    labelled = label_spans(merged, keys)
    main = largest_part(part_areas(labelled, keys), keys).select(*keys, F.col("part").alias("label"))
    main_spans = cut_lineage(bars(labelled.join(main, [*keys, "label"], "left_semi"), keys))
    narrow = covered_spans(erode(main_spans, keys, distance, k, tile), keys, (F.col("da") > 0) & (F.col("db") == 0))
    parts = label_spans(narrow, keys)
    kept = sliver_filter(part_areas(parts, keys), keys).select(*keys, F.col("part").alias("label"))
    kept_spans = cut_lineage(parts.join(kept, [*keys, "label"], "left_semi").withColumnRenamed(
        "label", "part").select(*keys, "part", *SIDES))
    filled = kept_spans.unionByName(hole_spans(kept_spans, [*keys, "part"])).drop("part")
    final = united_spans(filled, keys)
    edges = border_edges(final, keys)
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    lengths = edges.groupBy(*keys).agg(exact_area(length).alias("perimeter"))
    areas = final.groupBy(*keys).agg(exact_area(overlay.gap_area()).alias("area"))
    measures = cut_lineage(areas.join(lengths, keys).where(valid_outline(F.col("area"), F.col("perimeter"))))
    valid = measures.select(*keys)
    return Outlines(measures, edges.join(valid, keys, "left_semi"), final.join(valid, keys, "left_semi"), keys)
