"""Ordered operators on ordinary and on oversized keys."""

import random

import pytest

from areaflow.operators import ordered, storeys
from areaflow.operators.placement import resolve_placements
from areaflow.sources import meshes


@pytest.fixture
def tiny_hot(monkeypatch):
    monkeypatch.setattr(ordered, "HOT_ROWS", 5)


def levels(spark, n=80):
    rng = random.Random(1)
    rows = [(k, i, round(rng.uniform(0, 6), 2)) for k in (1, 2) for i in range(n if k == 1 else 4)]
    return rows, spark.createDataFrame(rows, "model_id bigint, storey_id bigint, elevation double")


def expected(rows):
    out = set()
    for k in {r[0] for r in rows}:
        last = None
        for _, i, e in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is None or e - last > 0.2:
                out.add((k, i))
                last = e
    return out


def test_greedy_gap_golden(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate((0.0, 0.15, 0.3, 0.45, 3.0))],
                               "model_id bigint, storey_id bigint, elevation double")
    kept = storeys.greedy_gap(df)
    assert sorted(r.elevation for r in kept.collect()) == [0.0, 0.3, 3.0]
    assert storeys.greedy_gap(kept).count() == 3


def test_greedy_gap_in_chunks(spark, tiny_hot):
    rows, df = levels(spark)
    want = expected(rows)
    rule = lambda row, last: row["elevation"] - last["elevation"] > 0.2
    whole = ordered.greedy_keep(df, ["model_id"], ["elevation", "storey_id"], rule)
    cut = ordered.greedy_keep(df, ["model_id"], ["elevation", "storey_id"], rule, chunk=7)
    assert {(r.model_id, r.storey_id) for r in whole.collect()} == want
    assert {(r.model_id, r.storey_id) for r in cut.collect()} == want


def test_positions_and_neighbours_of_hot_keys(spark, tiny_hot):
    rows, df = levels(spark)
    placed = ordered.with_position(df, ["model_id"], ["elevation", "storey_id"])
    got = {(r.model_id, r.storey_id): r.pos for r in placed.collect()}
    for k in (1, 2):
        order = [r[1] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]))]
        assert [got[k, i] for i in order] == list(range(1, len(order) + 1))
    near = ordered.with_neighbours(df, ["model_id"], ["elevation", "storey_id"], ["elevation"])
    plain = ordered.with_neighbours(df, ["model_id"], ["elevation", "storey_id"], ["elevation"], peak=1)
    assert sorted(map(str, near.collect())) == sorted(map(str, plain.select(*near.columns).collect()))


def test_deep_placement_chain(spark):
    rows = [(1, i, i - 1 if i else None, 0.1) for i in range(40)] + [(2, 0, None, 5.0)]
    df = spark.createDataFrame(rows, "model_id bigint, placement_id bigint, parent_id bigint, dz double")
    got = {(r.model_id, r.placement_id): (r.z, r.depth, r.root_id) for r in resolve_placements(df)[0].collect()}
    assert got[1, 39] == (pytest.approx(4.0), 39, 0)
    assert got[2, 0] == (5.0, 0, 0)


def test_placement_cycles_are_rejected(spark):
    rows = [(1, 1, None, 1.0), (1, 2, 1, 2.0), (1, 3, 4, 1.0), (1, 4, 5, 1.0), (1, 5, 3, 1.0), (1, 6, 4, 1.0), (1, 7, 7, 1.0)]
    placed, rejected = resolve_placements(spark.createDataFrame(
        rows, "model_id bigint, placement_id bigint, parent_id bigint, dz double"))
    assert {r.placement_id: r.z for r in placed.collect()} == {1: 1.0, 2: 3.0}
    assert {r.placement_id for r in rejected.collect()} == {3, 4, 5, 6, 7}


def test_document_text_is_whole(spark):
    pages = spark.createDataFrame([(1, p, "x" * 1000) for p in range(300)] + [(2, 0, None)],
                                  "doc_id bigint, page int, text string")
    got = {r.doc_id: r.text for r in meshes.document_text(pages).collect()}
    assert got == {1: ("x" * 1000 + "\n") * 300, 2: "\n"}


def test_document_text_cap(spark):
    pages = spark.createDataFrame([(1, p, str(p) * 4) for p in range(9)] + [(2, 0, "ab")],
                                  "doc_id bigint, page int, text string")
    got = {r.doc_id: r.text for r in meshes.document_text(pages, cap=12).collect()}
    assert got == {1: "0000\n1111\n22", 2: "ab\n"}
