"""Sample points in rectangles along the axes, without a walk along the ring, are those of any ring."""

from conftest import rect, ring
from pyspark.sql import functions as F

from areaflow.operators import spatial

RING = "id int, ring array<struct<x:double,y:double>>"


def test_points_of_boxes_and_other_rings(spark, monkeypatch):
    shapes = [rect(0, 0, 4, 2), rect(0.1, 0.3, 3.4, 0.3), rect(-1.5, 2.25, 7.1, 9.7), ring((0, 0), (0, 3), (2, 3), (2, 0)),
              ring((0, 0), (4, 0), (4, 4)), ring((0, 0), (4, 0), (4, 4), (2, 1)), ring((1, 1), (1, 5)), rect(0, 0, 1e-7, 1e-7)]
    df = spatial.with_bbox(spark.createDataFrame(list(enumerate(shapes)), RING))

    def points():
        return [sorted((r.id, r.px, r.py) for r in found.collect()) for found in (spatial.even_points(df, 9), spatial.grid_points(df, 0.5))]

    walked = []
    monkeypatch.setattr(spatial, "is_box", lambda r: F.lit(False))
    general = points()
    monkeypatch.undo()
    monkeypatch.setattr(spatial, "strictly_inside", lambda px, py, r: walked.append(r) or F.raise_error(F.lit("walked")).cast("boolean"))
    boxes = spatial.with_bbox(spark.createDataFrame(list(enumerate(shapes[:4])), RING))
    assert sorted((r.id, r.px, r.py) for r in spatial.even_points(boxes, 9).collect()) == [p for p in general[0] if p[0] < 4]
    monkeypatch.undo()
    for fast, slow in zip(points(), general):
        assert set(fast) ^ set(slow) == set()
    assert len(general[0]) > 100
