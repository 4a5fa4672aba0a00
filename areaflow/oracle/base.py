"""Building tables as DuckDB common table expressions, and SQL assembly.

The SQL here is written for checking only; no Spark code uses it.
"""

from __future__ import annotations

from areaflow.sources import derived as d


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,8)),{n}) AS DOUBLE)"


def esum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,10))) AS DOUBLE)"


def pick(index: str, values: list) -> str:
    items = ",".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"([{items}])[CAST({index} AS BIGINT)+1]"


_RULES = ",".join(f"('{c}',{o},'{t}','{l}',{k}::DOUBLE,'{s}')" for c, o, t, l, k, s in d.BASE_RULES)
_FACES = "[" + ",".join(map(str, d.BOX_FACES)) + "]"
_US = "CASE WHEN {m} % 2 = 0 THEN 1.0::DOUBLE ELSE 0.001::DOUBLE END"

CTES: dict[str, tuple[list[str], str]] = {
    "n": ([], """SELECT (SELECT count(*) FROM part) AS np, ((SELECT count(*) FROM part) + 11)//12 AS nm,
        (SELECT count(*) FROM orders) AS no, (SELECT count(*) FROM events) AS ne"""),
    "models": ([], f"""SELECT p_partkey//12 AS model_id, r_name AS region, {_US.format(m='(p_partkey//12)')} AS unit_scale
        FROM part JOIN region ON (p_partkey//12) % 5 = r_regionkey WHERE p_partkey % 12 = 0"""),
    "storeys_raw": ([], f"""SELECT model_id, storey_id,
        CASE WHEN storey_id % 29 = 0 THEN NULL WHEN j = 11 THEN 'ROOF' ELSE p_type || ' ' || j END AS name,
        CAST(cm AS DOUBLE)/100.0/({_US.format(m='model_id')}) AS raw_elevation, storey_id*4+1 AS placement_id, cm
        FROM (SELECT p_partkey//12 AS model_id, p_partkey AS storey_id, p_partkey % 12 AS j, p_type,
          (p_partkey % 12)*300 + (p_size % 10)*10 - CASE WHEN p_partkey % 12 % 4 = 3 THEN 290 ELSE 0 END AS cm FROM part)"""),
    "base": (["n"], f"""SELECT *, model_id*12 + custkey % least(12, np - model_id*12) AS home_storey FROM (
        SELECT o_orderkey % nm AS model_id, o_orderkey AS express_id, 'E' || o_orderkey AS guid,
        {pick('o_orderkey % 7', d.IFC_TYPES)} AS ifc_type, {pick('o_custkey % 6', d.PREDEFINED)} AS predefined_type,
        o_custkey*7 % 3700 AS z_cm, 20 + o_custkey % 350 AS h_cm, o_custkey % 40 AS gx, o_orderkey % 30 AS gy,
        2 + o_orderkey % 8 AS gw, 1 + o_custkey % 6 AS gd, o_custkey AS custkey, o_orderstatus = 'F' AS is_contained, np
        FROM orders, n)"""),
    "elements": (["base"], f"""SELECT model_id, express_id, guid, ifc_type, predefined_type,
        CASE WHEN express_id % 31 = 0 THEN '' ELSE p_name || {pick('express_id % 13', d.NAME_SUFFIX)} END AS name,
        express_id*4+2 AS placement_id FROM base JOIN part ON express_id % np = p_partkey"""),
    "element_z": (["base"], "SELECT model_id, express_id, guid, ifc_type, z_cm/100.0::DOUBLE AS z_m FROM base"),
    "placements": (["base", "storeys_raw"], f"""SELECT model_id, model_id*4 AS placement_id, NULL::BIGINT AS parent_id, 0.0::DOUBLE AS dz
          FROM storeys_raw WHERE storey_id % 12 = 0
        UNION ALL SELECT model_id, placement_id, model_id*4, raw_elevation FROM storeys_raw
        UNION ALL SELECT b.model_id, express_id*4+2, CASE WHEN is_contained THEN home_storey*4+1 ELSE b.model_id*4 END,
          CAST(z_cm - CASE WHEN is_contained THEN s.cm ELSE 0 END AS DOUBLE)/100.0/({_US.format(m='b.model_id')})
          FROM base b JOIN storeys_raw s ON s.storey_id = home_storey"""),
    "contained_in": (["base"], """SELECT model_id, home_storey AS parent_id, express_id AS child_id FROM base WHERE is_contained"""),
    "space_contents": (["n"], f"""SELECT l_orderkey % nm AS model_id, l_orderkey AS space_id,
        {pick('l_partkey % 11', d.CONTENT_TYPES)} AS child_type FROM lineitem, n WHERE l_orderkey % 7 = 0"""),
    "bounded_by": (["n"], f"""SELECT l_orderkey % nm AS model_id, l_orderkey AS space_id,
        {pick('l_suppkey % 5', d.BOUNDARY_TYPES)} AS element_type FROM lineitem, n WHERE l_orderkey % 7 = 0"""),
    "fp": (["base"], """SELECT model_id, home_storey AS storey_id, express_id AS poly_id, gx, gy, gw, gd,
        CASE WHEN ifc_type = 'IfcSlab' THEN 'slab' ELSE 'wall' END AS layer FROM base
        WHERE ifc_type IN ('IfcSlab','IfcWall','IfcCovering','IfcBuildingElementProxy')"""),
    "mesh": (["base"], """SELECT model_id, express_id, ifc_type, gx*0.5::DOUBLE AS x0, gy*0.5::DOUBLE AS y0, (gx+gw)*0.5::DOUBLE AS x1,
        (gy+gd)*0.5::DOUBLE AS y1, z_cm/100.0::DOUBLE AS z0, (z_cm+h_cm)/100.0::DOUBLE AS z1 FROM base"""),
    "psets": (["base"], """SELECT model_id, express_id, 0 AS pset_ord, 'Pset_Custom' AS pset, 'k' AS prop, json_extract_string(props, '$.k') AS value
          FROM base JOIN events ON express_id % (SELECT count(*) FROM events) = event_id
        UNION ALL SELECT model_id, express_id, 1, 'Pset_' || substr(ifc_type, 4) || 'Common', 'IsExternal', CASE WHEN express_id % 3 = 0 THEN 'true' ELSE 'false' END
          FROM base WHERE express_id % 3 < 2
        UNION ALL SELECT model_id, express_id, 1, 'Pset_' || substr(ifc_type, 4) || 'Common', 'Reference', CASE WHEN express_id % 2 = 0 THEN 'R' || express_id END
          FROM base WHERE express_id % 3 < 2"""),
    "replies": (["base"], f"""SELECT model_id, guid, express_id, express_id % 17 = 0 AS bad, {pick('express_id % 11', d.REPLY_CATEGORIES)} AS category,
        CASE WHEN express_id % 23 = 0 THEN NULL ELSE (express_id*37 % 101)/100.0::DOUBLE END AS raw_conf, 'r' || express_id AS reasoning FROM base"""),
    "rules": ([], f"""SELECT r_name AS region, category, CASE WHEN r_regionkey % 2 = 0 AND category = 'enclosure' THEN 4 - rule_ord ELSE rule_ord END AS rule_ord,
        description, condition_logic, coefficient, citation
        FROM region, (VALUES {_RULES}) v(category, rule_ord, description, condition_logic, coefficient, citation)"""),
    "alignment": (["base"], f"""SELECT model_id, express_id, guid, ifc_type,
        CASE WHEN express_id % 41 = 0 THEN NULL ELSE {pick('express_id % 11', d.AREA_CATEGORIES)} END AS semantic_category,
        (express_id*37 % 101)/100.0::DOUBLE AS confidence,
        CASE WHEN express_id*37 % 101 >= 65 THEN 'AUTO_MAPPED' ELSE 'NEEDS_REVIEW' END AS status,
        'r' || express_id AS reasoning, gw*gd/4.0::DOUBLE AS area,
        CASE WHEN express_id % 19 = 0 THEN 0.5::DOUBLE WHEN express_id % 23 = 0 THEN 0.0::DOUBLE END AS manual_factor, z_cm/100.0::DOUBLE AS z_m
        FROM base WHERE ifc_type IN ('IfcSpace','IfcSlab')"""),
    "review_actions": (["n"], f"""SELECT event_id*7 % no % nm AS model_id, event_id AS seq,
        CASE WHEN event_id % 50 = 0 THEN 'missing' || event_id ELSE 'E' || (event_id*7 % no) END AS guid,
        CASE WHEN event_type = 'click' THEN 'approve' ELSE 'update' END AS op,
        CASE WHEN event_type = 'purchase' THEN {pick('event_id % 4', d.NEW_TYPES)} END AS new_type,
        CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'why ' || event_id END END AS reason
        FROM events, n WHERE event_type IN ('click','purchase')"""),
    "reg_pages": ([], r"""SELECT doc_id, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS page FROM (
        SELECT doc_id, text || chr(10) || '3.0.' || (doc_id % 30) || ' Storey height below 2.' || (doc_id % 5) || ' m counts 1/2 area' AS t FROM documents)"""),
    "wall_curves": ([], """SELECT user_id AS wall_id, event_id AS pt_ord, (event_id*3 % 100)/10.0::DOUBLE AS x, value/10.0::DOUBLE AS y FROM events"""),
    "area_inputs": ([], """SELECT p_partkey//12 AS model_id, p_partkey AS storey_id, CASE WHEN p_partkey % 37 = 0 THEN 0.0::DOUBLE ELSE 60.0 + p_size END::DOUBLE AS base_area,
        CASE WHEN p_partkey % 37 = 0 THEN 0.0::DOUBLE ELSE (p_partkey % 5)*2.5::DOUBLE END AS outside_area FROM part"""),
}


def with_ctes(main: str, *names: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """`main` preceded by the named tables and everything they depend on."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for dep in known[name][0]:
            add(dep)
        order.append(name)

    for name in names:
        add(name)
    parts = ", ".join(f"{name} AS ({known[name][1]})" for name in order)
    return f"WITH RECURSIVE {parts} {main}"
