"""Shape faults of rings against a comparison of every two edges."""

import math
import random

from conftest import ring

from areaflow.operators import validity

RING = "fault_id int, ring array<struct<x:double,y:double>>, n int, row string"


def turn(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (b[0] - o[0]) * (a[1] - o[1])


def plain(points):
    if points is None:
        return validity.TOO_FEW
    pts = [p for k, p in enumerate(points) if len(points) == 1 or p != points[k - 1]]
    n = len(pts)
    if n < 3:
        return validity.TOO_FEW
    for k in range(n):
        o, p, q = pts[k - 1], pts[k], pts[(k + 1) % n]
        if turn(o, p, q) == 0 and (p[0] - o[0]) * (q[0] - p[0]) + (p[1] - o[1]) * (q[1] - p[1]) < 0:
            return validity.SPIKE
    crosses = touches = len(set(pts)) < n
    crosses = False
    for i in range(n):
        for j in range(i + 2, n if i else n - 1):
            a, b, c, d = pts[i], pts[i + 1], pts[j], pts[(j + 1) % n]
            one, two = turn(a, b, c) * turn(a, b, d), turn(c, d, a) * turn(c, d, b)
            boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
            if boxes and one <= 0 and two <= 0:
                touches, crosses = True, crosses or (one < 0 and two < 0)
    return validity.CROSSES if crosses else validity.TOUCHES if touches else None


def test_faults_equal_a_comparison_of_all_edges(spark):
    rnd = random.Random(12)
    shapes = [None, [], [(0, 0)], [(0, 0), (1, 1)], [(0, 0), (4, 4), (4, 0), (0, 3)], [(0, 0), (4, 0), (4, 4), (0, 4)],
              [(0, 0), (4, 0), (2, 2), (4, 4), (0, 4), (2, 2)], [(0, 0), (6, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)],
              [(0, 0), (0, 0), (4, 0), (4, 4), (4, 4), (0, 0)], [(1, 1)] * 5]
    shapes += [[(rnd.randrange(5), rnd.randrange(5)) for _ in range(rnd.choice([3, 4, 5, 8]))] for _ in range(150)]
    # A star of many points, once as it is and once with two far points exchanged.
    star = [(round(math.cos(t) * r, 6), round(math.sin(t) * r, 6)) for k in range(2000)
            for t, r in [(2 * math.pi * k / 2000, 50 if k % 2 else 40)]]
    mixed = list(star)
    mixed[100], mixed[900] = mixed[900], mixed[100]
    rows = [(k, None if s is None else ring(*s), 7, "x") for k, s in enumerate([*shapes, star, mixed])]
    got = {r.fault_id: r.fault for r in validity.with_shape_fault(spark.createDataFrame(rows, RING).repartition(3)).collect()}
    want = {k: plain(s) for k, s in enumerate(shapes)} | {len(shapes): None, len(shapes) + 1: validity.CROSSES}
    assert got == want
    assert {None, *(getattr(validity, c) for c in ("TOO_FEW", "SPIKE", "CROSSES", "TOUCHES"))} == set(got.values())


def test_empty_table_and_repeated_rows(spark):
    square = ring((0, 0), (2, 0), (2, 2), (0, 2))
    twice = spark.createDataFrame([(1, square, 0, "x"), (1, square, 0, "x")], RING)
    assert [r.fault for r in validity.with_shape_fault(twice).collect()] == [None, None]
    assert validity.with_shape_fault(twice.limit(0)).collect() == []


def test_edges_are_not_broadcast(spark):
    # Spark sees one small row a ring; the edges in the cells are many times that.
    rings = spark.range(20000).selectExpr(
        "id ring_no", "transform(sequence(0, 40), k -> struct(cos(k / 7D) x, sin(k / 7D) y)) ring")
    edges = rings.selectExpr("ring_no", "40 n", "0.1D side", "posexplode(slice(ring, 1, 40)) (i, a)").selectExpr(
        "ring_no", "n", "side", "i", "a.x x1", "a.y y1", "a.x + 0.1D x2", "a.y y2")
    plan = validity.meetings(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
