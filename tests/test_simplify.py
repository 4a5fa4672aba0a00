"""Simplified rings: tolerance kept, simple rings stay simple and apart."""

import math
import random

from conftest import ring

from areaflow.operators import simplify, validity

RINGS = "storey int, name int, ring array<struct<x:double,y:double>>"


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = 0 if not dx and not dy else max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def crossing(a, b, c, d):
    def turn(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (q[0] - o[0]) * (p[1] - o[1])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def wavy(cx, cy, r, n, rough, rnd):
    return [(cx + math.cos(2 * math.pi * k / n) * (r + rnd.uniform(-rough, rough)), cy + math.sin(2 * math.pi * k / n) * (r + rnd.uniform(-rough, rough)))
            for k in range(n)]


def test_tolerance_and_shape_are_kept(spark):
    rnd = random.Random(3)
    shapes = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (2, 0.004), (4, 0), (4, 2), (4, 4), (0, 4)],
              wavy(20, 20, 5, 120, 0.004, rnd), wavy(20, 20, 5.012, 120, 0.002, rnd), wavy(40, 0, 3, 80, 0.2, rnd)]
    rows = [(1, k, ring(*s)) for k, s in enumerate(shapes)] + [(2, 9, None), (2, 10, ring((0, 0), (1, 0)))]
    got = {r.name: r.ring and [(p.x, p.y) for p in r.ring] for r in simplify.simplified(
        spark.createDataFrame(rows, RINGS).repartition(3), ["storey"]).collect()}
    assert got[9] is None and got[10] == [(0, 0), (1, 0)]
    assert sorted(got[0]) == sorted(shapes[0]) and sorted(got[1]) == sorted(shapes[0])
    assert len(got[2]) < 100 and len(got[4]) >= 70
    for k, before in enumerate(shapes):
        after = got[k]
        assert set(after) <= {(float(x), float(y)) for x, y in before} and len(after) >= 3
        edges = list(zip(after, after[1:] + after[:1]))
        assert all(min(distance(p, a, b) for a, b in edges) <= 0.01 + 1e-9 for p in before)
    everything = [(a, b) for k in range(len(shapes)) for a, b in zip(got[k], got[k][1:] + got[k][:1])]
    # The two circles that lie within the tolerance of each other still do not cross.
    assert not any(crossing(*e, *f) for i, e in enumerate(everything) for f in everything[i + 1:])
    simple = spark.createDataFrame([(1, k, ring(*got[k])) for k in range(len(shapes))], RINGS)
    assert [r.fault for r in validity.with_shape_fault(simple).collect()] == [None] * len(shapes)


def test_no_rings(spark):
    assert simplify.simplified(spark.createDataFrame([], RINGS), ["storey"]).collect() == []
