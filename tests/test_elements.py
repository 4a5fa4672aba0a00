"""Features, classification, review, streams and file scans."""

import pytest
from pyspark.sql import functions as F

from areaflow.operators import classify, features, hierarchy, review
from areaflow.sources import meshes, model_files
from areaflow.streaming import align_stream, review_stream

FEATURES = ("model_id bigint, guid string, mode string, name string, ifc_type string, predefined_type string, is_external string, "
            "area double, contains_stair boolean, contains_transport boolean, boundary_material string")
ANSWERS = "model_id bigint, guid string, failed boolean, category string, raw_confidence double, reasoning string"


def test_calibration_goldens(spark):
    f = spark.createDataFrame([
        (1, "a", "GENERAL", "Floor Slab", "IfcSlab", "FLOOR", "TRUE", 0.0, False, False, "UNKNOWN"),
        (1, "b", "VERTICAL", "Atrium", "IfcSpace", None, "UNKNOWN", 10.0, False, False, "RAILING"),
        (1, "c", "GENERAL", "x", "IfcSlab", None, "UNKNOWN", 0.0, False, False, "UNKNOWN"),
        (1, "d", "GENERAL", "x", "IfcSlab", None, "UNKNOWN", 0.0, False, False, "UNKNOWN")], FEATURES)
    a = spark.createDataFrame([
        (1, "a", False, "INTERIOR_FLOOR_SLAB", 0.9, "r"), (1, "b", False, "ATRIUM", 0.8, "r"),
        (1, "c", True, "ERROR", 0.0, "bad"), (1, "d", False, None, 0.9, "r")], ANSWERS)
    got = {r.guid: (r.confidence, r.status) for r in classify.align(f, a).collect()}
    assert got == {"a": (0.68, "AUTO_MAPPED"), "b": (0.65, "AUTO_MAPPED"), "c": (0.0, "NEEDS_REVIEW")}


def test_replies(spark):
    rows = [(1, "a", '```json\n{"category": "ATRIUM", "confidence": 0.9, "reasoning": "x"}\n```'), (1, "b", "no"),
            (1, "c", '{"category": "VOID", "reasoning": "y"}'), (1, "d", '{"category": "VOID", "confidence": "0.7"}'),
            (1, "e", '{"category": "VOID", "confidence": "high"}')]
    got = {r.guid: r for r in classify.parse_replies(
        spark.createDataFrame(rows, "model_id bigint, guid string, content string")).collect()}
    assert (got["a"].category, got["a"].raw_confidence, got["a"].failed) == ("ATRIUM", 0.9, False)
    assert (got["b"].category, got["b"].raw_confidence, got["b"].failed) == ("ERROR", 0.0, True)
    assert got["c"].raw_confidence == 0.5
    assert (got["d"].raw_confidence, got["d"].failed, got["e"].category) == (0.7, False, "ERROR")


def test_external_flag_takes_first_common_set(spark):
    e = spark.createDataFrame([(1, 1), (1, 2)], "model_id bigint, express_id bigint")
    p = spark.createDataFrame([
        (1, 1, 0, "Pset_WallCommon", {"Other": "x"}), (1, 1, 2, "Pset_SlabCommon", {"IsExternal": "false"}),
        (1, 1, 1, "Pset_XCommon", {"IsExternal": "true"}), (1, 2, 0, "Custom", {"IsExternal": "true"})],
        "model_id bigint, express_id bigint, pset_ord int, pset string, props map<string,string>")
    got = {r.express_id: r.is_external for r in features.external_flag(e, p).collect()}
    assert got == {1: "TRUE", 2: "UNKNOWN"}


ALIGNMENT = ("model_id bigint, guid string, express_id bigint, ifc_type string, semantic_category string, confidence double, status string, "
             "reasoning string, manual_factor double")
ACTIONS = "model_id bigint, seq bigint, guid string, op string, new_type string, reason string, ts timestamp"


def review_tables(spark):
    rows = [(1, g, i, "IfcSlab", "CORRIDOR", 0.4, "NEEDS_REVIEW", "r", None) for i, g in enumerate("abcd")]
    acts = [(1, 1, "a", "update", "EXTERIOR_FLOOR_SLAB", "first", None), (1, 4, "a", "update", "CORRIDOR", "second", None),
            (1, 2, "b", "approve", None, None, None), (1, 3, "c", "update", "balcony", "", None), (1, 5, "z", "approve", None, None, None)]
    return spark.createDataFrame(rows, ALIGNMENT), spark.createDataFrame(acts, ACTIONS)


def test_review_fold(spark):
    table, actions = review_tables(spark)
    got = {r.guid: r for r in review.apply_actions(table, actions).collect()}
    assert (got["a"].semantic_category, got["a"].manual_factor, got["a"].status) == ("CORRIDOR", None, "VERIFIED")
    assert got["a"].reasoning == "r [Manual Edit: first] [Manual Edit: second]"
    assert (got["b"].semantic_category, got["b"].status) == ("CORRIDOR", "VERIFIED")
    assert (got["c"].manual_factor, got["c"].reasoning) == (0.5, "r")
    assert got["d"].status == "NEEDS_REVIEW"
    assert [r.guid for r in review.rejected_actions(table, actions).collect()] == ["z"]
    assert [r.guid for r in review.queue_after_review(table, actions).collect()] == ["d"]
    assert review.review_counts(table, actions).first().needs_review == 1
    view = {r.guid: r.calc_factor for r in review.element_view(table, review.apply_actions(table, actions)).collect()}
    assert view == {"a": 1.0, "b": 1.0, "c": 0.5, "d": 1.0}


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    table, actions = review_tables(spark)
    for i, row in enumerate(reversed(actions.collect())):
        spark.createDataFrame([row], ACTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = review_stream.action_stream(spark, f"{tmp_path}/in", 1)
    review_stream.start_review_log(stream, f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    known = spark.read.parquet(f"{tmp_path}/log")
    got = review_stream.reviewed(table, known)
    want = review.apply_actions(table, actions)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_alignment_stream_keeps_finished_batches(spark, tmp_path):
    rows = [(1, f"g{i}", "GENERAL", "Floor Slab", "IfcSlab", "FLOOR", "TRUE", 0.0, False, False, "UNKNOWN") for i in range(6)]
    f = spark.createDataFrame(rows, FEATURES)
    f.repartition(3).write.parquet(f"{tmp_path}/in")
    answers = spark.createDataFrame([(1, f"g{i}", False, "INTERIOR_FLOOR_SLAB", 0.9, "r") for i in range(6)], ANSWERS)
    stream = align_stream.feature_stream(spark, f"{tmp_path}/in", f.schema)
    align_stream.start_alignment(stream, lambda batch: answers, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").where("confidence = 0.68").count() == 6


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_scan_of_exchange_file(spark, tmp_path, line_end):
    text = ("ISO-10303-21;\nDATA;\n#1=IFCWALL('2O2Fr$t4X7Zf8NOew3FLOH',#5,'It''s (a; wall)'  ,$,(1.,2.),.T.);\n"
            "#22= IFCSLAB('x',$,'S');\nENDSEC;\n")
    (tmp_path / "m.ifc").write_bytes(text.replace("\n", line_end).encode())
    rows = model_files.parse_entities(model_files.read_statements(spark, str(tmp_path))).orderBy("entity_id").collect()
    assert [(r.entity_id, r.entity_type) for r in rows] == [(1, "IFCWALL"), (22, "IFCSLAB")]
    assert rows[0].args == ["'2O2Fr$t4X7Zf8NOew3FLOH'", "#5", "'It''s (a; wall)'", "$", "(1.,2.)", ".T."]


def test_scan_of_odd_statements(spark, tmp_path):
    text = ("DATA;\n#1=IFCA('a; wall',#2);#2=IFCB((((1.,(2.,'x)(;'))),$),IFCLABEL('l, m'));\n#3=IFCC(\n 'two',\n $\n);\n"
            "/* #9=IFCX(); */ #4=IFCD('/* kept */',/* gone; */ 5);\n#5=IFCWALL('open);\n#6=(IFCA()IFCB());\n"
            "#99999999999999999999=IFCE();\n#7=IFCF();\nENDSEC;")
    (tmp_path / "m.ifc").write_text(text)
    statements = model_files.read_statements(spark, str(tmp_path))
    got = {r.entity_id: (r.entity_type, r.args) for r in model_files.parse_entities(statements).collect()}
    assert got == {1: ("IFCA", ["'a; wall'", "#2"]), 2: ("IFCB", ["(((1.,(2.,'x)(;'))),$)", "IFCLABEL('l, m')"]),
                   3: ("IFCC", ["'two'", "$"]), 4: ("IFCD", ["'/* kept */'", "5"]), 7: ("IFCF", [])}
    rejected = {r.statement.split("=")[0] for r in model_files.rejected_statements(statements).collect()}
    assert rejected == {"#5", "#6", "#99999999999999999999"}


def test_pset_default_and_containment(spark):
    p = spark.createDataFrame([(1, 1, None, {"a": None, "b": "2"})], "model_id bigint, express_id bigint, pset string, props map<string,string>")
    assert sorted((r.pset, r.prop, r.value) for r in meshes.flatten_psets(p).collect()) == [
        ("Property Set", "a", "-"), ("Property Set", "b", "2")]
    rel = spark.createDataFrame([(1, 7, [1, 2])], "model_id bigint, parent_id bigint, related_ids array<bigint>")
    assert meshes.containment_edges(rel).count() == 2


def test_node_names(spark):
    df = spark.createDataFrame([
        (None, None, "Long", "IFCSITE", 1), ("Default", None, None, "IFCSITE", 2), (None, None, None, "IFCWALL", 3),
        ("", "alt", None, None, 4), (None, None, None, None, None)], "n string, a string, l string, t string, i bigint")
    got = [r[0] for r in df.select(features.node_name(F.col("n"), F.col("a"), F.col("l"), F.col("t"), F.col("i"))).collect()]
    assert got == ["Long", "Site", "IFCWALL (3)", "alt", "Element (?)"]


def test_tree_roots_and_cycles(spark):
    nodes = spark.createDataFrame([(1, 1, "IFCPROJECT"), (1, 2, "IFCSITE"), (1, 3, "IFCBUILDING"), (1, 4, "IFCSTOREY"), (2, 1, "IFCPROJECT"),
                                   (2, 5, "IFCSITE"), (2, 6, "IFCWALL")], "model_id bigint, node_id bigint, node_type string")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 5), (2, 5, 6)], "model_id bigint, parent_id bigint, child_id bigint")
    got = {(r.model_id, r.node_id): r.depth for r in hierarchy.walk(nodes, edges).collect()}
    assert got == {(1, 3): 0, (1, 4): 1, (2, 5): 0, (2, 6): 1}


def test_deep_trees_and_cycles_end(spark):
    n = 90
    nodes = spark.createDataFrame([(1, i, "IFCX") for i in range(n)], "model_id bigint, node_id bigint, node_type string")
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(n - 1)] + [(1, 5, 3)],
                                  "model_id bigint, parent_id bigint, child_id bigint")
    got = {r.node_id: r.depth for r in hierarchy.walk(nodes, edges).collect()}
    assert got == {i: i - 1 for i in range(1, n)}


def test_dynamic_categories(spark):
    rows = spark.createDataFrame([("r", "special_use", 1, "Fire Refuge floor", "x"), ("r", "special_use", 2, "none", "use = basement"),
                                  ("r", "special_use", 3, "basement again", "")],
                                 "region string, category string, rule_ord int, description string, condition_logic string")
    got = classify.active_categories(spark.createDataFrame([("r",)], "region string"), rows).orderBy("cat_ord").collect()
    assert [r.name for r in got][9:] == ["FIRE_REFUGE", "BASEMENT"]


@pytest.mark.parametrize("text,want", [("#123=IfcWall('x')", 123), ("none", None)])
def test_entity_id(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(features.entity_id(F.col("t")).alias("i")).first().i == want


def test_lists_of_any_depth(spark):
    deep = {d: "(" * d + "1.,'a)(''b',$" + ")" * d for d in (1, 6, 7, 8, 50)}
    rows = [(d, f"#{d}=IFCTEST('x',{text},TYPED({text}),.T.)") for d, text in deep.items()]
    rows += [(900, "#900=IFCOPEN('x',((1.)"), (901, "#901=IFCPOINTS((" + ",".join("(1.,2.)" for _ in range(3000)) + "))"), (902, "#902=IFCNONE()"),
             (903, "#903=IFCTOO(" + "(" * 600 + ")" * 600 + ")")]
    statements = spark.createDataFrame(rows, "no int, statement string")
    got = {r.entity_id: r.args for r in model_files.parse_entities(statements).collect()}
    assert got == {**{d: ["'x'", t, f"TYPED({t})", ".T."] for d, t in deep.items()}, 901: [rows[-3][1][len("#901=IFCPOINTS("):-1]], 902: []}
    assert {r.no: r.statement for r in model_files.rejected_statements(statements).collect()} == {900: rows[-4][1], 903: rows[-1][1]}
    assert model_files.nesting_depth(statements.where("no < 60")) == 51
    assert model_files.parse_entities(statements.limit(0)).collect() == []
