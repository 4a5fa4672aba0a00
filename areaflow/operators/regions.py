"""High and low regions of slabs under a crossing roof, as connected sample cells of one side of the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.functions.geometry import area
from areaflow.operators import rings
from areaflow.operators.clearance import SPLIT_GRID, THRESHOLD, sample_heights, sampled_slabs
from areaflow.operators.components import components
from areaflow.operators.spatial import even_points
from areaflow.session import cut_lineage

SLAB = ["model_id", "express_id"]
REGION = [*SLAB, "region"]


def region_cells(open_slabs: DataFrame, crossing: DataFrame, faces: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Sample cells with `height_class` (high or low) and `region`, the smallest cell number of their region.

    Cells that share a side and a class are connected.  A cell under open sky is in no
    region and connects none.  Cells of all slabs are labelled together, each slab's
    links where they lie.
    """
    points = sample_heights(sampled_slabs(open_slabs, crossing), faces)
    side = F.when(F.col("clear") >= threshold, "high").otherwise("low")
    number = (F.col("i") * SPLIT_GRID + F.col("j")).cast("bigint")
    cells = cut_lineage(points.withColumns({"height_class": side, "cell": number, "id": F.monotonically_increasing_id()}))
    ahead = F.array(F.struct((F.col("i") + 1).alias("i"), F.col("j")), F.struct(F.col("i"), (F.col("j") + 1).alias("j")))
    asks = cells.select(*SLAB, "height_class", F.col("id").alias("u"), F.explode(ahead).alias("at")).select(
        *SLAB, "height_class", "u", "at.i", "at.j")
    links = asks.join(cells.withColumnRenamed("id", "v"), [*SLAB, "height_class", "i", "j"]).select(*SLAB, "u", "v")
    labelled = components(cells, links, SLAB)
    first = labelled.groupBy("label").agg(F.min("cell").alias("region"))
    return labelled.join(first, "label").select(*REGION, "height_class", "i", "j", "clear")


def height_regions(cells: DataFrame, slabs: DataFrame) -> DataFrame:
    """Regions with their number of cells, their area and the range of clearances in them.

    Each sample point of a slab stands for an equal share of its area, so the regions
    of a slab without open sky add up to the slab.
    """
    touched = slabs.join(cells.select(*SLAB).distinct(), SLAB, "left_semi")
    shares = even_points(touched, SPLIT_GRID).groupBy(*SLAB).agg(
        (area(F.first("ring")) / F.count(F.lit(1))).alias("share"))
    found = cells.groupBy(*REGION, "height_class").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("clear").alias("lowest"), F.max("clear").alias("highest"))
    return found.join(shares, SLAB).withColumn("area", F.col("n_cells") * F.col("share")).drop("share")


def region_polygons(cells: DataFrame, slabs: DataFrame) -> DataFrame:
    """Text of each region: the squares around its points, a step of the grid wide, united."""
    steps = slabs.select(*SLAB, "minx", "miny", ((F.col("maxx") - F.col("minx")) / (SPLIT_GRID - 1)).alias("dx"),
                         ((F.col("maxy") - F.col("miny")) / (SPLIT_GRID - 1)).alias("dy"))
    left, low = F.col("i") - F.lit(0.5), F.col("j") - F.lit(0.5)

    def edge(a: tuple[float, float], b: tuple[float, float]) -> Column:
        def at(p: tuple[float, float], n: int) -> list[Column]:
            return [(F.col("minx") + (left + p[0]) * F.col("dx")).alias(f"x{n}"),
                    (F.col("miny") + (low + p[1]) * F.col("dy")).alias(f"y{n}")]
        return F.struct(*at(a, 1), *at(b, 2))

    around = [(0, 0), (1, 0), (1, 1), (0, 1)]
    sides = F.array(*[edge(around[k], around[(k + 1) % 4]) for k in range(4)])
    squares = cells.join(steps, SLAB).select(*REGION, F.explode(sides).alias("e")).select(*REGION, "e.*")
    return rings.polygon_text(rings.closed_edges(squares, REGION), REGION)
