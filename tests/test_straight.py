"""Straight borders joined into one edge leave the polygons as they are."""

import random

from areaflow.operators import rings

EDGE = "k bigint, x1 double, y1 double, x2 double, y2 double"


def loop(*points):
    return [(1, *map(float, a), *map(float, b)) for a, b in zip(points, points[1:] + points[:1])]


def test_pieces_of_a_side_become_one_edge(spark):
    square = loop((0, 0), (1, 0), (2, 0), (4, 0), (4, 3), (4, 4), (1, 4), (0, 4), (0, 1))
    got = {tuple(r) for r in rings.straightened(spark.createDataFrame(square, EDGE), ["k"]).collect()}
    assert got == {(1, 0, 0, 4, 0), (1, 4, 0, 4, 4), (1, 4, 4, 0, 4), (1, 0, 4, 0, 0)}


def test_a_point_where_regions_meet_stays(spark):
    # Two regions over one straight line, parted by a notch that comes down to it.
    edges = loop((0, 0), (2, 0), (1, 3), (0, 3)) + loop((2, 0), (4, 0), (4, 3), (3, 3))
    df = spark.createDataFrame(edges, EDGE)
    assert {tuple(r) for r in rings.straightened(df, ["k"]).collect()} == set(edges)
    assert rings.polygon_text(df, ["k"]).first().outline_polygon == (
        "MULTIPOLYGON (((0 0, 2 0, 1 3, 0 3, 0 0)), ((2 0, 4 0, 4 3, 3 3, 2 0)))")


def test_random_cells_keep_their_polygons(spark, monkeypatch):
    rng = random.Random(5)
    cells = [(x, y) for x in range(9) for y in range(9) if rng.random() < 0.7]
    edges = [e for x, y in cells for e in loop((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]
    df = rings.closed_edges(spark.createDataFrame(edges, EDGE), ["k"])
    joined = rings.polygon_text(df, ["k"]).first().outline_polygon
    assert rings.straightened(df, ["k"]).count() < df.count()
    monkeypatch.setattr(rings, "straightened", lambda e, keys: e)
    assert rings.polygon_text(df, ["k"]).first().outline_polygon == joined
