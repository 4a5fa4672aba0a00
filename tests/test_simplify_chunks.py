"""Rings of usual keys are simplified in tasks, those of large keys in rounds of Spark, with the same corners left."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from conftest import ring

from areaflow.operators import chunks, simplify

RINGS = "storey int, name int, note string, at timestamp, ring array<struct<x:double,y:double>>"


def wavy(cx, cy, r, n, rough, rnd):
    return ring(*[(cx + math.cos(2 * math.pi * k / n) * (r + rnd.uniform(-rough, rough)), cy + math.sin(2 * math.pi * k / n) * (r + rnd.uniform(-rough, rough)))
                  for k in range(n)])


def rings(rnd):
    rows = []
    for storey in [*range(12), None]:
        near = rnd.choice([0.0, 4.0])
        rows += [(storey, near, 5, 40 + 10 * (storey or 0), 0.004), (storey, near, 5.01, 60, 0.003), (storey, 30.0, 3, 30, 0.2), (storey, 30.0, 0.02, 5, 0.004)]
    rows = [(s, k, f"r{k}", datetime(2020, 1, 1 + k % 28), wavy(c, c, r, n, e, rnd)) for k, (s, c, r, n, e) in enumerate(rows)]
    return rows + [(3, 90, None, None, None), (3, 91, "", None, ring((0, 0), (1, 0))), (99, 92, "alone", None, None),
                   (98, 93, "dents", None, ring((0, 0), (2, 0.004), (4, 0), (3.996, 2), (4, 4), (2, 3.996), (0, 4), (0.004, 2)))]


def rows_of(df):
    return {r.name: (r.storey, r.note, r.at, r.ring and [(p.x, p.y) for p in r.ring]) for r in df.collect()}


def test_tasks_and_rounds_leave_the_same_corners(spark):
    df = spark.createDataFrame(rings(random.Random(8)), RINGS).repartition(5)
    usual, mixed, rounds = (rows_of(simplify.simplified(df, ["storey"], large=n)) for n in (20_000, 150, 0))
    assert usual == mixed == rounds and len(usual) == df.count()
    assert usual[93][3] == [(0, 0), (4, 0), (4, 4), (0, 4)] and usual[90][3] is None and usual[91][3] == [(0, 0), (1, 0)]
    assert sum(len(r[3] or []) for r in usual.values()) < sum(len(r.ring or []) for r in df.collect()) * 0.9


def test_usual_keys_take_no_rounds_of_spark(spark, monkeypatch):
    monkeypatch.setattr(simplify, "in_rounds", lambda *a: pytest.fail("rounds"))
    df = spark.createDataFrame(rings(random.Random(9)), RINGS)
    assert len(rows_of(simplify.simplified(df, ["storey"]))) == df.count()


def test_many_pairs_in_parts(spark, monkeypatch):
    rnd = random.Random(2)
    low = np.array([rnd.randrange(20) for _ in range(50)])
    high = low + np.array([rnd.randrange(9) for _ in range(50)])
    want = [(i, j) for i in range(50) for j in range(low[i], high[i])]
    for pairs in (1, 7, 1000):
        monkeypatch.setattr(simplify, "PAIRS", pairs)
        assert [p for i, j in simplify.ranges(low, high) for p in zip(i.tolist(), j.tolist())] == want


def test_chunks_by_weight():
    import pyarrow as pa
    batches = pa.table({"_key": [1, 1, 2, 3, 3, 3], "w": [5, 1, 9, 1, 1, 1]}).to_batches(max_chunksize=1)
    got = [t["_key"].to_pylist() for t in chunks.key_chunks(iter(batches), 8, lambda b: sum(b["w"].to_pylist()))]
    assert got == [[1, 1], [2], [3, 3, 3]]
