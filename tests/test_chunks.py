"""Graphs and rings of whole keys are worked out in chunks; those of larger keys go on in rounds, with the same results."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from areaflow.functions.geometry import dilate
from areaflow.operators import chunks, components, rings


def test_chunks_end_where_keys_change():
    keys = [1] * 3 + [2] * 4 + [5] * 12 + [7]
    batches = pa.table({"_key": keys}).to_batches(max_chunksize=2)
    got = [t["_key"].to_pylist() for t in chunks.key_chunks(iter(batches), 5)]
    assert sum(got, []) == keys
    assert got[:2] == [[1] * 3, [2] * 4]


@pytest.mark.parametrize("rows", [None, 7])
def test_graphs_of_keys(spark, rows):
    rng = random.Random(3)
    links = [(k, 100 * k + rng.randrange(40), 100 * k + rng.randrange(40)) for k in range(6) for _ in range(5 * k + 3)]
    links += [(9, 900 + i, 901 + i) for i in range(60)]
    root = {n: n for _, u, v in links for n in (u, v)}
    for _ in root:
        for _, u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    found = components.reachable_by_key(spark.createDataFrame(links, "k bigint, u bigint, v bigint").repartition(3), ["k"], rows)
    assert {r.id: r.label for r in found.collect()} == {n: r for n, r in root.items() if n != r}


def test_rings_cut_by_chunks(spark):
    def loop(k, n):
        at = [(k * 10.0 + i, 0.0) for i in range(n)] + [(k * 10.0 + n - 1 - i, 1.0) for i in range(n)]
        return [(k, *a, *b) for a, b in zip(at, at[1:] + at[:1])]

    df = spark.createDataFrame(loop(1, 2) + loop(2, 9) + loop(3, 30), "k bigint, x1 double, y1 double, x2 double, y2 double")
    whole, cut = [{(r.k, r.x1, r.y1): r.ahead for r in rings.ranked(df, ["k"], rows=n).collect()} for n in (None, 5)]
    assert whole == cut and len(whole) == 82
    assert {k: max(a for (j, _, _), a in whole.items() if j == k) for k in (1, 2, 3)} == {1: 3, 2: 17, 3: 59}


def test_mitred_buffer_has_no_points_on_its_sides(spark):
    shapes = [[(0, 0), (4, 0), (4, 2), (0, 2)], [(1, 1), (1, 3)], [(0, 0), (4, 0), (4, 2), (2, 3), (0, 2)]]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in s],) for s in shapes], "ring array<struct<x:double,y:double>>")
    got = [[(p.x, p.y) for p in r.wide] for r in df.select(dilate(F.col("ring"), 0.5, 4).alias("wide")).collect()]
    assert got == [[(-0.5, -0.5), (4.5, -0.5), (4.5, 2.5), (-0.5, 2.5)], [(0.5, 0.5), (1.5, 0.5), (1.5, 3.5), (0.5, 3.5)],
                   [(-0.5, -0.5), (4.5, -0.5), (4.5, 2.5), (2.5, 3.5), (1.5, 3.5), (-0.5, 2.5)]]
