"""High and low regions of slabs against flood filling."""

import random

import pytest
from conftest import rect
from pyspark.sql import functions as F

from areaflow.operators import clearance, regions, spatial

SLAB = "model_id bigint, express_id bigint, ring array<struct<x:double,y:double>>, min_z double, max_z double"
FACE = "model_id bigint, other bigint, p1 struct<x:double,y:double,z:double>, p2 struct<x:double,y:double,z:double>, p3 struct<x:double,y:double,z:double>"


def slabs_of(spark, rects):
    return spatial.with_bbox(spark.createDataFrame([(1, k, rect(*r), -0.2, 0.0) for k, r in enumerate(rects)], SLAB))


def roofs(spark, boxes):
    rows = []
    for k, box in enumerate(boxes):
        x0, y0, x1, y1, z = map(float, box)
        a, b, c, d = (x0, y0, z), (x1, y0, z), (x1, y1, z), (x0, y1, z)
        rows += [(1, 100 + k, a, b, c), (1, 100 + k, a, c, d)]
    flat = spark.createDataFrame(rows, FACE)
    x, y = [F.col(f"p{i}.x") for i in (1, 2, 3)], [F.col(f"p{i}.y") for i in (1, 2, 3)]
    return flat.withColumns({"minx": F.least(*x), "maxx": F.greatest(*x), "miny": F.least(*y), "maxy": F.greatest(*y)})


def flooded(heights):
    """(smallest cell, class, cells) of each region by flood filling."""
    left, out = dict(heights), []
    while left:
        start = next(iter(left))
        side, todo, seen = left[start] >= 2.2, [start], set()
        while todo:
            at = todo.pop()
            if at in left and (left[at] >= 2.2) == side:
                del left[at]
                seen.add(at)
                i, j = at
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        out.append((min(i * 20 + j for i, j in seen), "high" if side else "low", len(seen)))
    return sorted(out)


def test_two_low_roofs_are_two_regions(spark):
    slabs = slabs_of(spark, [(0, 0, 19, 19)])
    faces = roofs(spark, [(0, 0, 19, 19, 3.0), (-1, -1, 4.5, 19.5, 2.0), (14.5, -1, 20, 19.5, 2.1)])
    cells = regions.region_cells(slabs, slabs.select("model_id", "express_id"), faces)
    rows = {r.region: r for r in regions.height_regions(cells, slabs).collect()}
    assert [(k, rows[k].height_class, rows[k].n_cells) for k in sorted(rows)] == [
        (21, "low", 72), (101, "high", 180), (301, "low", 72)]
    assert sum(r.area for r in rows.values()) == pytest.approx(361.0)
    assert (rows[301].lowest, rows[101].highest) == (2.1, 3.0)
    texts = {r.region: r.outline_polygon for r in regions.region_polygons(cells, slabs).collect()}
    assert texts[101] == "POLYGON ((4.5 0.5, 14.5 0.5, 14.5 18.5, 4.5 18.5, 4.5 0.5))"


def test_a_low_roof_in_the_middle_is_a_hole(spark):
    slabs = slabs_of(spark, [(0, 0, 19, 19)])
    faces = roofs(spark, [(0, 0, 19, 19, 3.0), (7.5, 7.5, 11.5, 11.5, 1.0)])
    cells = regions.region_cells(slabs, slabs.select("model_id", "express_id"), faces)
    texts = {r.region: r.outline_polygon for r in regions.region_polygons(cells, slabs).collect()}
    assert len(texts) == 2 and texts[21].count("(") == 3 and texts[8 * 20 + 8].count("(") == 2


def test_random_roofs_equal_flood_filling(spark):
    rng = random.Random(3)
    rects = [(0, 0, 19, 19), (30, 0, 49, 19)]
    boxes = []
    for k in range(60):
        x, y = rng.uniform(-2, 48), rng.uniform(-2, 18)
        boxes.append((x, y, x + rng.uniform(1, 6), y + rng.uniform(1, 6), rng.choice([1.0, 2.0, 2.2, 2.5, 3.0])))
    slabs = slabs_of(spark, rects)
    cells = regions.region_cells(slabs, slabs.select("model_id", "express_id"), roofs(spark, boxes))
    got = regions.height_regions(cells, slabs).collect()
    for k, (x0, y0, _, _) in enumerate(rects):
        heights = {}
        for i in range(1, 19):
            for j in range(1, 19):
                over = [z for a, b, c, d, z in boxes if a <= x0 + i <= c and b <= y0 + j <= d]
                if over:
                    heights[i, j] = min(over)
        assert len(heights) < 18 * 18  # some open sky
        assert sorted((r.region, r.height_class, r.n_cells) for r in got if r.express_id == k) == flooded(heights)


def test_no_roof_no_region(spark):
    slabs = slabs_of(spark, [(0, 0, 19, 19)])
    cells = regions.region_cells(slabs, slabs.select("model_id", "express_id"), roofs(spark, [(50, 50, 60, 60, 2.0)]))
    assert regions.height_regions(cells, slabs).isEmpty()
    assert clearance.split_samples(slabs, slabs.select("model_id", "express_id"), roofs(spark, [(50, 50, 60, 60, 2.0)])).isEmpty()
