"""Overlay, outlines, hulls and clearance against hand values and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from conftest import rect, ring
from pyspark.sql import functions as F

from areaflow.functions import geometry
from areaflow.operators import clearance, components, outline, overlay, rings, spatial, walls

POLY = "k bigint, layer string, poly_id bigint, ring array<struct<x:double,y:double>>"


def polys(spark, rows):
    return spark.createDataFrame([(1, layer, i, r) for i, (layer, r) in enumerate(rows)], POLY)


def test_union_of_rectangles(spark):
    df = polys(spark, [("a", rect(0, 0, 12, 10)), ("a", rect(10, 5, 15, 12))])
    assert overlay.overlay_areas(df, ["k"]).first().area_union == pytest.approx(145.0)


@pytest.mark.parametrize("tile", [None, 4.0, 16.0])
def test_random_triangles(spark, tile):
    rng = random.Random(7)
    tri = [("ab"[i % 2], ring(*[(rng.uniform(-9, 11), rng.uniform(0, 10)) for _ in range(3)])) for i in range(12)]
    got = overlay.overlay_areas(polys(spark, tri), ["k"], tile).first()
    n = 1600
    xs, ys = np.meshgrid((np.arange(n) + 0.5) * 20 / n - 9, (np.arange(n) + 0.5) * 10 / n)

    def mask(layer):
        hit = np.zeros(xs.shape, bool)
        for name, r in tri:
            if name == layer:
                s = [(r[(i + 1) % 3]["x"] - r[i]["x"]) * (ys - r[i]["y"]) - (r[(i + 1) % 3]["y"] - r[i]["y"]) * (xs - r[i]["x"])
                     for i in range(3)]
                hit |= np.all([v >= 0 for v in s], axis=0) | np.all([v <= 0 for v in s], axis=0)
        return hit

    a, b, cell = mask("a"), mask("b"), 20 / n * 10 / n
    assert got.area_union == pytest.approx((a | b).sum() * cell, abs=0.15)
    assert got.area_both == pytest.approx((a & b).sum() * cell, abs=0.15)
    assert got.area_a == pytest.approx(got.area_both + got.area_a_only, abs=1e-6)


def test_corner_contact_is_two_parts(spark):
    df = polys(spark, [("a", rect(0, 0, 2, 2)), ("a", rect(2, 2, 4, 4))])
    spans = outline.covered_spans(overlay.sweep(overlay.ring_edges(df, ["k"]), ["k"]), ["k"], F.col("da") > 0)
    areas = outline.part_areas(outline.label_spans(spans, ["k"]), ["k"]).collect()
    assert sorted(r.area for r in areas) == [4.0, 4.0]


def test_outline_fills_ring_of_walls(spark):
    w = [rect(0, 0, 10, 0.2), rect(0, 7.8, 10, 8), rect(0, 0, 0.2, 8), rect(9.8, 0, 10, 8), rect(20, 0, 21, 1)]
    for k, tile in ((64, 16.0), (4, None), (4, 3.0)):
        row = outline.enclosed_outline(polys(spark, [("w", r) for r in w]), ["k"], k=k, tile=tile).measures.first()
        assert row.area == pytest.approx(80.0, abs=1e-3)
        assert row.perimeter == pytest.approx(36.0, abs=2e-2)


def test_island_in_hole_is_absorbed(spark):
    w = [rect(0, 0, 10, 1), rect(0, 9, 10, 10), rect(0, 0, 1, 10), rect(9, 0, 10, 10), rect(4, 4, 6, 6), rect(1, 5, 4.02, 5.05)]
    row = outline.enclosed_outline(polys(spark, [("w", r) for r in w]), ["k"], k=4).measures.first()
    assert row.area == pytest.approx(100.0, abs=1e-3)


def test_hull_and_group_hulls(spark):
    rng = random.Random(3)
    pts = [(rng.gauss(0, 5), rng.gauss(0, 5)) for _ in range(400)]
    df = spark.createDataFrame([(1, x, y) for x, y in pts], "k bigint, x double, y double")
    whole = spatial.group_hulls(df, ["k"]).select("ring", geometry.area(F.col("ring")).alias("a")).first()
    parts = spatial.group_hulls(df, ["k"], chunk=40).select("ring", geometry.area(F.col("ring")).alias("a")).first()
    assert parts.a == pytest.approx(whole.a)

    def edge(p, q):
        return all((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) >= -1e-12 for r in pts)

    brute = sum((p[0] * q[1] - q[0] * p[1]) / 2 for p, q in itertools.permutations(pts, 2) if edge(p, q))
    assert whole.a == pytest.approx(brute)


def test_buffer_of_triangle(spark):
    tri = ring((0, 0), (4, 0), (0, 3))
    a = polys(spark, [("a", tri)]).select(geometry.area(geometry.dilate(F.col("ring"), 0.5, 64)).alias("a")).first().a
    kgon = 32 * 0.25 * math.sin(2 * math.pi / 64)
    assert a == pytest.approx(6 + 12 * 0.5 + kgon, abs=0.02)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    links += [(700, 701 + i) for i in range(300)]
    nodes = spark.createDataFrame([(1, i) for i in range(1001)], "k bigint, id bigint")
    got = {r.id: r.label for r in components.components(nodes, spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    want = {i: i for i in range(1001)}
    for _ in range(400):
        for u, v in links:
            want[u] = want[v] = min(want[u], want[v])
    assert got == want


def test_wall_strip_and_external_share(spark):
    w = [rect(0, 0, 10, 0.2), rect(4, 3, 5, 3.2)]
    outer = polys(spark, [("o", rect(0, 0, 10, 8))])
    edges = overlay.ring_edges(outer, ["k"])
    got = {r.poly_id: r for r in walls.external_walls(polys(spark, [("w", r) for r in w]), edges, ["k"]).collect()}
    assert got[0].is_external and got[0].ratio == pytest.approx((10 + 0.4) / 20.4)
    assert not got[1].is_external
    manual = walls.external_walls(polys(spark, [("w", w[0])]), edges, ["k"], 0.5, manual=True).first()
    assert manual.is_external and manual.ratio == pytest.approx(10.4 / 20.4)


def test_curve_steps(spark):
    pts = [(0.0, 0.0), (0.01, 0.0), (0.1, 0.0), (0.2, 0.1), (5.0, 5.0), (0.3, 0.1), (0.4, 0.1)]
    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "wall_id bigint, pt_ord bigint, x double, y double")
    assert [r.pt_ord for r in walls.thin_curve(df).orderBy("pt_ord").collect()] == [0, 2, 3, 4, 5, 6]
    assert [r.pt_ord for r in walls.guard_curve(df).orderBy("pt_ord").collect()] == [0, 1, 2, 3, 5, 6]
    # The jump point goes, and so do its two neighbours, whose distance to it is too large.
    assert [r.pt_ord for r in walls.smooth_curve(df).orderBy("pt_ord").collect()] == [0, 1, 2, 6]
    same = spark.createDataFrame([(1, i, 0.0, 0.0) for i in range(3)], df.schema)
    assert [r.pt_ord for r in walls.thin_curve(same).orderBy("pt_ord").collect()] == [0, 2]


def test_upper_median(spark):
    sizes = spark.createDataFrame([(1, i, float(v), 9.0) for i, v in enumerate((4, 1, 3, 2))],
                                  "model_id bigint, express_id bigint, dx double, dy double")
    models = spark.createDataFrame([(1,), (2,)], "model_id bigint")
    assert {r.model_id: r.thickness for r in walls.wall_thickness(models, sizes).collect()} == {1: 3.0, 2: 0.2}


def test_nearest_above_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        x, y, z = rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(0, 120)
        rows.append((1, i, rect(x, y, x + rng.uniform(1, 6), y + rng.uniform(1, 6)), z, z + 0.3))
    df = spatial.with_bbox(spark.createDataFrame(
        rows, "model_id bigint, express_id bigint, ring array<struct<x:double,y:double>>, min_z double, max_z double"))
    got = {r.express_id: r.above_id for r in clearance.nearest_above(df).collect()}

    def meets(p, q):
        return (p[0]["x"] <= q[2]["x"] and q[0]["x"] <= p[2]["x"] and p[0]["y"] <= q[2]["y"] and q[0]["y"] <= p[2]["y"])

    want = {}
    for _, i, r, lo, hi in rows:
        above = [(z, j) for _, j, s, z, _ in rows if z > hi and meets(r, s)]
        if above:
            want[i] = min(above)[1]
    assert got == want


def test_sloped_roof_gives_variable_class(spark):
    slab = ("model_id bigint, express_id bigint, ring array<struct<x:double,y:double>>, min_z double, max_z double")
    slabs = spatial.with_bbox(spark.createDataFrame([(1, 1, rect(0, 0, 10, 10), -0.2, 0.0)], slab))
    verts = [0, 0, 1.0, 10, 0, 4.0, 10, 10, 4.0, 0, 10, 1.0]
    mesh = spark.createDataFrame([(1, 2, "IfcRoof", [float(v) for v in verts], [0, 1, 2, 0, 2, 3, 0, 1, 99])],
                                 "model_id bigint, express_id bigint, ifc_type string, verts array<double>, faces array<int>")
    covers = clearance.solids(mesh).withColumn("name", F.lit("屋檐"))
    cand = clearance.lowest_vertex_above(clearance.above_candidates(slabs, covers), mesh)
    faces = clearance.mesh_faces(mesh)
    assert faces.count() == 2
    low = clearance.effective_heights(cand, slabs, faces).first().effective_z
    assert low == pytest.approx(1.15)
    crossing = clearance.section_crossing(cand)
    samples = clearance.split_samples(slabs, crossing, faces).first()
    assert 0 < samples.n_high < samples.n_points
    levels = spark.createDataFrame([(1, 1, 7, 3.0)], "model_id bigint, express_id bigint, storey_id bigint, next_elevation double")
    none = spark.createDataFrame([], "model_id bigint, express_id bigint, above_id bigint, above_z double")
    cleared = clearance.clearances(slabs, none, clearance.effective_heights(cand, slabs, faces), levels)
    row = clearance.clearance_classes(cleared, clearance.split_samples(slabs, crossing, faces)).first()
    assert row.height_class == "variable"
    lines = clearance.section_lines(clearance.triangles(mesh.withColumn("section_z", F.lit(2.2)))).collect()
    assert sum(r.length for r in lines) == pytest.approx(10.0)


def test_footprint_of_l_shape(spark):
    pts = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 5), (0, 5)]
    verts = [float(v) for x, y in pts for v in (x, y, 1.0)]
    faces = [0, 1, 2, 0, 2, 3, 0, 3, 4, 0, 4, 5]
    mesh = spark.createDataFrame([(1, 1, verts, faces)], "model_id bigint, express_id bigint, verts array<double>, faces array<int>")
    row = clearance.footprint_area(clearance.face_border(mesh, "top")).first()
    assert (row.area, row.n_edges) == (14.0, 6)


# --- rings from border edges ---

def cell_edges(key, cells):
    """Borders of unit squares, counter-clockwise; inner ones cancel."""
    steps = ((0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0))
    return [(key, *(float(v) for v in (x + a, y + b, x + c, y + d))) for x, y in cells for a, b, c, d in steps]


def texts_of(spark, shapes):
    edges = spark.createDataFrame([e for k, cells in shapes.items() for e in cell_edges(k, cells)],
                                  "k string, x1 double, y1 double, x2 double, y2 double").repartition(5)
    return {r.k: r.outline_polygon for r in rings.polygon_text(rings.closed_edges(edges, ["k"]), ["k"]).collect()}


def test_rings_of_shapes_with_notches_holes_and_islands(spark):
    shapes = {
        "u": [(0, 0), (1, 0), (2, 0), (0, 1), (2, 1)],
        "hole": [(x, y) for x in range(5) for y in range(5) if (x, y) != (2, 2)],
        "corner": [(0, 0), (1, 1), (5, 5)],
        "nested": [(x, y) for x in range(9) for y in range(9) if not (2 <= x <= 6 and 2 <= y <= 6) or (x, y) == (4, 4)],
        "pinched hole": [(x, y) for x in range(4) for y in range(4) if (x, y) not in ((1, 1), (2, 2))],
        "pinched shell": [(x, y) for x in range(3) for y in range(3) if (x, y) not in ((1, 1), (2, 2))],
        "bar": [(x, 0) for x in range(300)]}
    assert texts_of(spark, shapes) == {
        "u": "POLYGON ((0 0, 3 0, 3 2, 2 2, 2 1, 1 1, 1 2, 0 2, 0 0))",
        "hole": "POLYGON ((0 0, 5 0, 5 5, 0 5, 0 0), (2 2, 2 3, 3 3, 3 2, 2 2))",
        "corner": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((1 1, 2 1, 2 2, 1 2, 1 1)), ((5 5, 6 5, 6 6, 5 6, 5 5)))",
        "nested": "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 2 7, 7 7, 7 2, 2 2)), ((4 4, 5 4, 5 5, 4 5, 4 4)))",
        "pinched hole": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1), (2 2, 2 3, 3 3, 3 2, 2 2))",
        "pinched shell": "POLYGON ((0 0, 3 0, 3 2, 2 2, 2 3, 0 3, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))",
        "bar": "POLYGON ((0 0, 300 0, 300 1, 0 1, 0 0))"}


def test_rings_of_no_edges(spark):
    none = spark.createDataFrame([], "k string, x1 double, y1 double, x2 double, y2 double")
    assert rings.polygon_text(rings.closed_edges(none, ["k"]), ["k"]).collect() == []


@pytest.mark.parametrize("sides", [8])
def test_outline_ring_has_the_measured_area(spark, sides):
    walls = [rect(0, 0, 8, 0.3), rect(0, 0, 0.3, 6), rect(7.7, 0, 8, 6), rect(0, 5.7, 5, 6), ring((2, 0), (3, -2), (3.2, -1.9), (2.2, 0.1))]
    polys = spark.createDataFrame([(1, i, w) for i, w in enumerate(walls)], "storey int, poly_id int, ring array<struct<x:double,y:double>>")
    found = outline.enclosed_outline(polys, ["storey"], k=sides)
    measured = found.measures.collect()[0]
    parts = rings.polygons(outline.ring_border(found.spans, ["storey"]), ["storey"]).select(
        F.sum(geometry.area(F.col("shell")) - F.aggregate("holes", F.lit(0.0), lambda s, h: s + geometry.area(h))).alias("area")).collect()[0]
    assert parts.area == pytest.approx(measured.area, abs=1e-3)
    assert found.polygons().collect()[0].outline_polygon.startswith("POLYGON ((")
