"""Goldens of the area calculation, worked out by hand."""

import json

import pytest
from conftest import rect
from pyspark.sql import functions as F

from areaflow.operators import area, assign, rules, storeys
from areaflow.plans import report
from areaflow.plans.floor_area import ModelTables, calculate, floor_area, items_on_storeys
from areaflow.sources.derived import BOX_FACES

RULES = "region string, category string, rule_ord int, description string, condition_logic string, coefficient double, citation string"
ITEMS = "model_id bigint, item_ord bigint, category string, area double, manual_factor double, z_m double"


def rule_rows(spark):
    return spark.createDataFrame([
        ("Test Region", "height", 1, "low", "h < 2.2", 0.5, "1"),
        ("Test Region", "enclosure", 1, "Unenclosed Balcony", "", 0.5, "2")], RULES)


def two_storeys(spark):
    raw = spark.createDataFrame([(1, 1, "Level 1", 0.0), (1, 2, "Level 2", 3.0), (1, 3, "ROOF", 5.0)],
                                "model_id bigint, storey_id bigint, name string, raw_elevation double")
    models = spark.createDataFrame([(1, "Test Region", 1.0)], "model_id bigint, region string, unit_scale double")
    return raw, models


def golden_run(spark):
    raw, models = two_storeys(spark)
    kept = storeys.storeys(raw, models)
    areas = spark.createDataFrame([(1, 1, 100.0, 20.0), (1, 2, 100.0, 0.0), (1, 3, 0.0, 0.0)],
                                  "model_id bigint, storey_id bigint, base_area double, outside_area double")
    items = spark.createDataFrame([(1, 1, "BALCONY", 10.0, None, 0.0), (1, 2, "VOID", 2.0, None, 0.0)], ITEMS)
    inputs = kept.join(areas, ["model_id", "storey_id"]).join(models.select("model_id", "region"), "model_id")
    return calculate(inputs, items_on_storeys(items, kept), rule_rows(spark))


def test_golden_storeys(spark):
    run = golden_run(spark)
    rows = {r.story_name: r for r in run.report.collect()}
    assert set(rows) == {"Level 1", "Level 2"}
    one, two = rows["Level 1"], rows["Level 2"]
    assert (one.base_area, one.height_coefficient, one.adjustments_area, one.calculated_area) == (100.0, 1.0, 3.0, 103.0)
    assert (one.area_full, one.area_half, one.area_excluded) == (88.0, 30.0, 2.0)
    assert (two.height, two.height_coefficient, two.calculated_area, two.area_half) == (2.0, 0.5, 50.0, 100.0)
    total = run.totals.first()
    assert total.total_area == 153.0
    assert total.summary_text == "Total Calculated Area: 153.0 sq.m across 2 stories."


def test_golden_components(spark):
    rows = golden_run(spark).components.where("storey_id = 1").orderBy("ord").collect()
    assert [(r.category, r.raw_area, r.coefficient) for r in rows] == [
        ("General Floor Area (Enclosed)", 88.0, 1.0), ("Geometric Balcony/Outside", 20.0, 0.5),
        ("BALCONY", 10.0, 0.5), ("VOID", 2.0, 0.0)]
    assert sum(r.effective_area for r in rows) == 103.0
    assert rows[2].detail == "Adjusted BALCONY (10.0m2 * 0.5 [Base 1.0])"


def test_report_parts_and_sinks(spark, tmp_path):
    run = golden_run(spark)
    whole = report.stories(run.report, run.parts).where("storey_id = 1").first()
    assert whole.adjustment_details.count("; ") == 2
    rows = report.details(run.parts).where("storey_id = 1").orderBy("ord").collect()
    assert "; ".join(r.detail for r in rows) == whole.adjustment_details
    sheets = {"summary": report.summary(run.report, run.totals), "stories": report.stories(run.report, run.parts),
              "components": report.component_sheet(run.report, run.components)}
    report.write_tables(sheets, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").count() == 7
    assert report.summary_date(sheets["summary"]).count() == 1
    docs = report.json_documents(run.report, run.components, run.totals, run.parts)
    story = json.loads(docs.where("storey_id = 1").first().json)["story"]
    assert story["adjustment_details"] == [r.detail for r in rows] and len(story["components"]) == 4


def test_a_storey_with_very_many_details_is_one_row(spark):
    parts = spark.range(25_000).selectExpr("1L AS model_id", "1L AS storey_id", "id AS ord", "'d' || id AS detail")
    stories = spark.createDataFrame([(1, 1, "S", 0.0, 3.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0)], """model_id bigint, storey_id bigint,
        story_name string, elevation double, height double, base_area double, height_coefficient double, adjustments_area double,
        area_full double, area_half double, area_excluded double, calculated_area double""")
    got = report.stories(stories, parts).collect()
    assert len(got) == 1 and got[0].adjustment_details.split("; ") == [f"d{i}" for i in range(25_000)]


def box(x0, y0, x1, y1, z0, z1):
    return [v for z in (z0, z1) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1)) for v in (x, y, z)]


def test_flagship_from_meshes(spark):
    """Four thin walls around 10 x 8, a slab with a 2 m balcony, round buffers."""
    raw, models = two_storeys(spark)
    walls = [(10, (0, 0, 10, 0.2)), (11, (0, 7.8, 10, 8)), (12, (0, 0, 0.2, 8)), (13, (9.8, 0, 10, 8))]
    parts = [(i, "IfcWall", 0.1, box(*r, 0.0, 3.0)) for i, r in walls]
    parts.append((20, "IfcSlab", 0.0, box(0, 0, 12, 8, -0.2, 0.0)))
    elements = spark.createDataFrame([(1, i, t, z) for i, t, z, _ in parts],
                                     "model_id bigint, express_id bigint, ifc_type string, z_m double")
    meshes = spark.createDataFrame([(1, i, t, [float(v) for v in m], BOX_FACES) for i, t, _, m in parts],
                                   "model_id bigint, express_id bigint, ifc_type string, verts array<double>, faces array<int>")
    links = spark.createDataFrame([], "model_id bigint, parent_id bigint, child_id bigint")
    items = spark.createDataFrame([(1, 1, "PARKING", 5.0, 0.5, 0.0)], ITEMS)
    run = floor_area(ModelTables(models, raw, elements, meshes, links, items, rule_rows(spark)))
    row = run.report.where("storey_id = 1").first()
    assert row.base_area == pytest.approx(80.0, abs=1e-3)
    parts = {r.arm: r for r in run.parts.where("storey_id = 1").collect()}
    assert parts["outside"].raw_area == pytest.approx(16.0, abs=2e-3)
    assert parts["manual"].adjustment == -2.5
    empty = run.report.where("storey_id = 2").first()
    assert (empty.base_area, empty.calculated_area) == (0.0, 0.0)


def test_height_rules_last_match_and_rejects(spark):
    rows = spark.createDataFrame([
        ("r", "height", 1, "", "h >= 2.2", 1.0, ""), ("r", "height", 2, "", "h < 2.2", 0.5, ""),
        ("r", "height", 3, "", "h < 1.2", 0.0, ""), ("r", "height", 4, "", "__import__('os')", 0.7, ""),
        ("r", "height", 5, "", "9.0 <= h < 9.5 and h > 9.1", 0.3, "")], RULES)
    heights = spark.createDataFrame([("r", h) for h in (1.0, 2.0, 2.2, 9.0, 9.2, 9.5)], "region string, height double")
    got = {r.height: r.height_coef for r in rules.height_coefficients(heights, rows).collect()}
    assert got == {1.0: 0.0, 2.0: 0.5, 2.2: 1.0, 9.0: 1.0, 9.2: 0.3, 9.5: 1.0}
    assert [r.rule_ord for r in rules.unparsed(rows).collect()] == [4]


def test_conditions_joined_by_or_and_brackets(spark):
    rows = spark.createDataFrame([
        ("r", "height", 1, "", "(h < 1) or (h >= 2 and h < 3) or h == 7", 0.25, ""), ("r", "height", 2, "", "-2 < h and (h < 0)", 0.5, ""),
        ("r", "height", 3, "", "(h < 1 or h > 2) and h < 9", 0.1, ""), ("r", "height", 4, "", "((h > 20))", 0.75, "")], RULES)
    heights = spark.createDataFrame([("r", float(h)) for h in (-1, 0, 1, 2, 3, 7, 8, 21)], "region string, height double")
    got = {r.height: r.height_coef for r in rules.height_coefficients(heights, rows).collect()}
    assert got == {-1: 0.1, 0: 0.1, 1: 1.0, 2: 0.25, 3: 0.1, 7: 0.1, 8: 0.1, 21: 0.75}
    assert rules.unparsed(rows).collect() == []


@pytest.mark.parametrize("text,want", [
    ("Storey height not less than 2.2 m counts full area", [("h >= 2.2", 1.0)]), ("层高不低于2.20m的，应计算全面积", [("h >= 2.20", 1.0)]),
    ("结构层高在1.20m及以上至2.10m以下的部位应计算1/2面积", [("h >= 1.20 and h < 2.10", 0.5)]), ("层高低于1.20m的不应计算面积", [("h < 1.20", 0.0)]),
    ("Storey height under 2.2 metres counts half", [("h < 2.2", 0.5)]), ("Storey height exceeding 5 m or not above 1.2 m is excluded",
                                                                      [("h > 5", 0.0), ("h <= 1.2", 0.0)])])
def test_wording_of_lengths(spark, text, want):
    texts = spark.createDataFrame([(1, f"3.0.1 {text}.")], "doc_id bigint, text string")
    rows = rules.extract_rules(texts).orderBy("hit_ord").collect()
    assert [(r.condition_logic, r.coefficient) for r in rows] == want


def test_special_rule_without_coefficient_counts_whole(spark):
    rows = spark.createDataFrame([("r", "special_use", 1, "Parking", "", None, "")], RULES)
    pairs = spark.createDataFrame([("r", "PARKING")], "region string, category string")
    assert rules.special_matches(pairs, rows).first().special_coef == 1.0


def test_special_match_both_ways_and_empty(spark):
    rows = spark.createDataFrame([("r", "special_use", 1, "Parking Garage", "", 0.5, ""),
                                  ("r", "special_use", 2, "", "", 0.25, "")], RULES)
    pairs = spark.createDataFrame([("r", "PARKING"), ("r", "OFFICE")], "region string, category string")
    got = {r.category: r.special_coef for r in rules.special_matches(pairs, rows).collect()}
    assert got == {"PARKING": 0.5, "OFFICE": 0.25}


def test_sample_clauses_give_five_rules(spark):
    text = ("3.0.1 在主体结构内的阳台，应按其结构外围水平面积计算全面积；在主体结构外的阳台，应按其结构底板水平投影面积计算1/2面积。\n"
            "3.0.2 建筑物的建筑面积应按自然层外墙结构外围水平面积之和计算。结构层高在2.20m及以上的，应计算全面积；"
            "结构层高在2.20m以下的，应计算1/2面积。\n3.0.24 建筑物内的变形缝，应按其自然层合并在建筑物面积内计算。")
    texts = spark.createDataFrame([(1, text), (2, "  ")], "doc_id bigint, text string")
    found = rules.extract_rules(texts).orderBy("clause_ord", "sub_ord").collect()
    assert [(r.citation, r.category, r.coefficient) for r in found] == [
        ("3.0.1", "enclosure", 1.0), ("3.0.1", "enclosure", 0.5), ("3.0.2", "height", 1.0), ("3.0.2", "height", 0.5),
        ("3.0.24", "special_use", 1.0)]
    assert [r.condition_logic for r in found[2:4]] == ["h >= 2.20", "h < 2.20"]
    assert [r.doc_id for r in rules.rejects(texts).collect()] == [2]


def test_storey_windows(spark):
    raw = spark.createDataFrame([(1, 1, "a", 0.0), (1, 2, "b", 3.0)],
                                "model_id bigint, storey_id bigint, name string, raw_elevation double")
    models = spark.createDataFrame([(1, "r", 1.0)], "model_id bigint, region string, unit_scale double")
    kept = storeys.storeys(raw, models)
    z = spark.createDataFrame([(1, v) for v in (-0.4, 2.95, 3.0)], "model_id bigint, z_m double")
    loose = {r.z_m: r.storey_id for r in assign.by_height(z, kept, 0.5).collect()}
    tight = {r.z_m: r.storey_id for r in assign.by_height(z, kept, 0.1).collect()}
    assert loose == {-0.4: 1, 2.95: 1, 3.0: 2}
    assert tight == {2.95: 1, 3.0: 2}


@pytest.mark.parametrize("levels,expected", [([0.0, 3.0, 6.0], 1.5), ([0.0, 5.0], 2.5), ([0.0], 2.0)])
def test_wall_tolerance(spark, levels, expected):
    raw = spark.createDataFrame([(1, i, "s", e) for i, e in enumerate(levels)],
                                "model_id bigint, storey_id bigint, name string, raw_elevation double")
    models = spark.createDataFrame([(1, "r", 1.0)], "model_id bigint, region string, unit_scale double")
    assert storeys.wall_tolerance(storeys.storeys(raw, models)).first().tolerance == expected


def test_roof_words(spark):
    df = spark.createDataFrame([("SURFACE",), ("World",), ("屋顶层",), ("F1",), (None,)], "name string")
    assert [r.name for r in storeys.drop_roofs(df).collect()] == ["F1", None]


def test_buckets_ignore_other_coefficients(spark):
    df = spark.createDataFrame([(0.7, 0.3, 5.0, "special")], "k double, c double, a double, arm string")
    moves = area.bucket_moves(F.col("k"), F.col("c"), F.col("a"), F.col("arm"))
    assert df.select(*[v.alias(n) for n, v in moves.items()]).first().asDict() == {
        "to_full": 0.0, "to_half": 0.0, "to_excluded": 0.0}


def test_rect_helper():
    assert len(rect(0, 0, 1, 1)) == 4


def test_conditions_of_any_form_hold_where_their_text_does(spark):
    texts = ["h >= 1.2 and (h < 2 or h > 3)", "not (h < 2)", "not h < 2", "((((h > 1))))", "not (not (h >= 2.2 or (h < 1 and h > 0.5)))",
             "h < 1 and h > 2", "1.2 <= h < 2.2 or h == 5", "not (1 < h <= 2) and not (h > 4 and not h == 6)", "H >= 2 OR h<1 AND h>0.5", "h > 1 or h <= 1",
             "(h >= 1 or h < 0.5) and (h < 3 or h >= 4) and not h == 2", "2.2 > h", "h >= -1"]
    wrong = ["h > 1 and", "and h > 1", "h > 1 h < 2", "(h > 1", "h > 1)", "__import__('os')", "h > x", "", "hh > 1", "not", "h > 1 not h < 2", None]
    rules_df = spark.createDataFrame([(k, t) for k, t in enumerate(texts + wrong)], "k int, condition_logic string")
    bounds = {}
    for r in rules.with_bounds(rules_df).collect():
        bounds.setdefault(r.k, []).append(r)
    import ast

    def value(node, h):
        """The text as a boolean formula over comparisons of h."""
        if isinstance(node, ast.BoolOp):
            parts = [value(v, h) for v in node.values]
            return all(parts) if isinstance(node.op, ast.And) else any(parts)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return not value(node.operand, h)
        if isinstance(node, ast.Compare):
            at = [h if isinstance(x, ast.Name) else ast.literal_eval(x) for x in (node.left, *node.comparators)]
            test = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
                    ast.Eq: lambda a, b: a == b}
            return all(test[type(o)](a, b) for o, a, b in zip(node.ops, at, at[1:]))
        return value(node.body, h)

    for k, text in enumerate(texts):
        rows = bounds[k]
        assert all(r.parsed for r in rows), text
        for h in (-2, -1, 0, 0.5, 0.7, 1, 1.1, 1.2, 1.5, 2, 2.1, 2.2, 2.5, 3, 3.5, 4, 4.5, 5, 6, 7):
            inside = [r for r in rows if (r.lo is None or h > r.lo or (r.lo_incl and h == r.lo)) and (r.hi is None or h < r.hi or (r.hi_incl and h == r.hi))]
            assert len(inside) == int(value(ast.parse(text.lower(), mode="eval"), h)), (text, h)
    assert len(bounds[0]) == 2 and len(bounds[9]) == 1
    for k in range(len(texts), len(texts) + len(wrong)):
        assert [r.parsed for r in bounds[k]] == [False], (texts + wrong)[k]
