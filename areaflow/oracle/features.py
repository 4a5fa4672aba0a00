"""Independent SQL for sources, features and classification."""

from areaflow.oracle.base import CTES, esum, rnd, with_ctes

_CAND_VERT = "regexp_matches(name, 'SHAFT|ATRIUM|STAIRWELL|ELEVATOR|VOID') OR name = 'GENERAL_ROOM'"
_DYN = [("PARKING", "parking"), ("AUXILIARY_ROOM", "auxiliary room"), ("DEFORMATION_JOINT", "deformation joint"),
        ("BASEMENT", "basement"), ("SHARED_AREA", "shared area"), ("FIRE_REFUGE", "fire refuge"),
        ("EQUIPMENT_ROOM", "equipment room")]
_DYN_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(description), '{w}') OR contains(lower(condition_logic), '{n.lower()}') THEN '{n}'" for n, w in _DYN) + " END"
_GEN = """GREATEST(0.1::DOUBLE, LEAST(0.99::DOUBLE, s8))"""

CTES.update({
    "dims": (["mesh"], f"""SELECT model_id, express_id, ifc_type, {rnd('x1-x0', 2)} AS bbox_dx, {rnd('y1-y0', 2)} AS bbox_dy, {rnd('z1-z0', 2)} AS bbox_dz,
        {rnd('least(x1-x0, y1-y0)', 2)} AS width, {rnd('greatest(x1-x0, y1-y0)', 2)} AS depth,
        CASE WHEN least(x1-x0, y1-y0) > 0.1 THEN {rnd('greatest(x1-x0, y1-y0)/least(x1-x0, y1-y0)', 1)} ELSE 99.9 END AS aspect_ratio,
        CASE WHEN ifc_type IN ('IfcSpace','IfcOpeningElement') THEN {rnd('(x1-x0)*(y1-y0)', 2)} ELSE 0.0 END AS area,
        CASE WHEN ifc_type = 'IfcSlab' THEN {rnd('z1-z0', 2)} ELSE 0.0 END AS thickness,
        {rnd('(x1-x0)*(y1-y0)*(z1-z0)', 2)} AS volume FROM mesh"""),
    "span": (["dims"], f"SELECT model_id, express_id, CASE WHEN bbox_dz > 0 THEN {rnd('bbox_dz/3.5', 1)} ELSE 1.0 END AS floor_span FROM dims"),
    "ext": (["base"], """SELECT model_id, express_id, CASE express_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'UNKNOWN' END AS is_external FROM base"""),
    "flags": (["space_contents"], """SELECT model_id, space_id, max(CASE WHEN child_type IN ('IfcStair','IfcRamp') THEN 1 ELSE 0 END) = 1 AS contains_stair,
        max(CASE WHEN child_type IN ('IfcTransportElement','IfcElevator') THEN 1 ELSE 0 END) = 1 AS contains_transport,
        max(CASE WHEN child_type LIKE '%Flow%' THEN 1 ELSE 0 END) = 1 AS contains_mep FROM space_contents GROUP BY 1, 2"""),
    "bm": (["bounded_by"], """SELECT model_id, space_id, walls, railings, CASE WHEN walls > railings THEN 'WALL' WHEN railings > 0 THEN 'RAILING' ELSE 'UNKNOWN' END AS boundary_material FROM (
        SELECT model_id, space_id, count(*) FILTER (element_type LIKE 'IfcWall%') AS walls, count(*) FILTER (element_type = 'IfcRailing') AS railings
        FROM bounded_by GROUP BY 1, 2)"""),
    "cats": (["rules"], f"""SELECT r_name AS region, cat_ord, name, types FROM region, (VALUES
        (1,'INTERIOR_FLOOR_SLAB','IfcSlab'), (2,'ROOF_SLAB','IfcSlab,IfcRoof'), (3,'BALCONY','IfcSlab'),
        (4,'GENERAL_ROOM','IfcSpace,IfcOpeningElement,IfcBuildingElementProxy'), (5,'CORRIDOR','IfcSpace'),
        (6,'ATRIUM','IfcSpace,IfcOpeningElement,IfcBuildingElementProxy'), (7,'ELEVATOR_SHAFT','IfcSpace,IfcOpeningElement,IfcBuildingElementProxy'),
        (8,'STAIRWELL','IfcSpace,IfcOpeningElement,IfcBuildingElementProxy'), (9,'FUNCTIONAL_SHAFT','IfcSpace,IfcOpeningElement,IfcBuildingElementProxy')) c(cat_ord, name, types)
        UNION ALL SELECT region, 9 + row_number() OVER (PARTITION BY region ORDER BY o, name), name, 'IfcSpace,IfcBuildingElementProxy,IfcSlab'
        FROM (SELECT region, name, min(rule_ord) AS o FROM (SELECT region, rule_ord, {_DYN_CASE} AS name FROM rules WHERE category = 'special_use') WHERE name IS NOT NULL GROUP BY 1, 2)"""),
    "modes": (["elements", "span"], """SELECT e.*, floor_span, CASE WHEN ifc_type IN ('IfcOpeningElement','IfcBuildingElementProxy') THEN 'VERTICAL'
        WHEN ifc_type = 'IfcSpace' AND (floor_span >= 1.5 OR regexp_matches(lower(name), 'shaft|atrium|void|riser|lift')) THEN 'VERTICAL' ELSE 'GENERAL' END AS mode
        FROM elements e JOIN span USING (model_id, express_id)"""),
    "cand": (["modes", "models", "cats"], f"""SELECT e.model_id, e.guid, e.express_id, coalesce(string_agg(c.name, ',' ORDER BY cat_ord), 'GENERIC_ELEMENT') AS candidates
        FROM (SELECT modes.*, region FROM modes JOIN models USING (model_id)) e
        LEFT JOIN cats c ON c.region = e.region AND list_contains(string_split(types, ','), e.ifc_type) AND (mode = 'GENERAL' OR {_CAND_VERT.replace('name', 'c.name')})
        GROUP BY 1, 2, 3"""),
    "parsed": (["replies"], """SELECT model_id, guid, express_id, bad AS failed, CASE WHEN bad THEN 'ERROR' ELSE category END AS category,
        CASE WHEN bad THEN 0.0 ELSE coalesce(raw_conf, 0.5) END::DOUBLE AS raw_confidence, CASE WHEN bad THEN 'reply is not valid JSON' ELSE reasoning END AS reasoning FROM replies"""),
    "ft": (["modes", "dims", "ext", "flags", "bm", "parsed"], """SELECT m.*, d.area, is_external,
        m.ifc_type = 'IfcSpace' AND coalesce(contains_stair, false) AS stair, m.ifc_type = 'IfcSpace' AND coalesce(contains_transport, false) AS transport,
        m.ifc_type = 'IfcSpace' AND coalesce(contains_mep, false) AS mep,
        CASE WHEN m.ifc_type = 'IfcSpace' THEN coalesce(boundary_material, 'UNKNOWN') ELSE 'UNKNOWN' END AS material, failed, category, raw_confidence, reasoning
        FROM modes m JOIN dims d USING (model_id, express_id) JOIN ext USING (model_id, express_id)
        LEFT JOIN flags f ON f.model_id = m.model_id AND f.space_id = m.express_id LEFT JOIN bm b ON b.model_id = m.model_id AND b.space_id = m.express_id
        JOIN parsed p ON p.model_id = m.model_id AND p.guid = m.guid WHERE m.ifc_type IN ('IfcSpace','IfcSlab')"""),
    "gen": (["ft"], f"""SELECT *, {rnd('greatest(0.1::DOUBLE, least(s7 - CASE WHEN length(name) < 3 THEN 0.05::DOUBLE ELSE 0 END, 0.99::DOUBLE))', 2)} AS confidence FROM (
        SELECT *, s6 - CASE WHEN CASE WHEN ifc_type = 'IfcSpace' THEN area ELSE 0 END = 0 THEN 0.3::DOUBLE ELSE 0 END AS s7 FROM (
        SELECT *, CASE WHEN category = 'GENERIC_ELEMENT' THEN least(s5 - 0.15::DOUBLE, 0.75::DOUBLE) ELSE s5 END AS s6 FROM (
        SELECT *, 0.5::DOUBLE + (raw_confidence - 0.5::DOUBLE)*0.5::DOUBLE
          + CASE WHEN predefined_type IN ('ROOF','BEAM','COLUMN','FLOOR','BASESLAB','STAIR','RAMP') THEN 0.2::DOUBLE
                 WHEN coalesce(predefined_type, '') NOT IN ('', 'NOTDEFINED','USERDEFINED','None') THEN 0.1::DOUBLE ELSE 0 END
          + CASE WHEN is_external <> 'UNKNOWN' THEN 0.08::DOUBLE ELSE 0 END
          + CASE WHEN contains(replace(upper(name), ' ', ''), replace(replace(category, '_', ''), ' ', '')) OR contains(category, upper(name)) THEN 0.12::DOUBLE ELSE 0 END
          + CASE WHEN ifc_type = 'IfcSpace' AND area > 0.1 THEN 0.05::DOUBLE ELSE 0 END AS s5 FROM ft WHERE mode = 'GENERAL' AND NOT failed)))"""),
    "ver": (["ft"], f"""SELECT *, {rnd('greatest(0.2::DOUBLE, least(v6, 0.99::DOUBLE))', 2)} AS confidence FROM (
        SELECT *, v5 + CASE WHEN category = 'STAIRWELL' AND stair THEN 0.25::DOUBLE WHEN category = 'ATRIUM' AND material = 'RAILING' THEN 0.2::DOUBLE ELSE 0 END AS v6 FROM (
        SELECT *, v4 + CASE WHEN contains(upper(replace(name, '-', '')), replace(category, '_', '')) THEN 0.15::DOUBLE ELSE 0 END AS v5 FROM (
        SELECT *, CASE WHEN contains(category, 'SHAFT') AND NOT (stair OR transport OR material = 'WALL' OR contains(lower(name), 'shaft')) THEN least(v3 - 0.25::DOUBLE, 0.65::DOUBLE) ELSE v3 END AS v4 FROM (
        SELECT *, v2 - CASE WHEN category = 'ATRIUM' AND area < 15 THEN 0.5::DOUBLE ELSE 0 END AS v3 FROM (
        SELECT *, CASE WHEN fb AND NOT regexp_matches(lower(name), 'room|office') THEN least(v1, 0.7::DOUBLE) ELSE v1 END AS v2 FROM (
        SELECT *, raw_confidence - CASE WHEN fb AND regexp_matches(lower(name), 'opening|void|hole') THEN 0.45::DOUBLE WHEN fb AND area < 2.5 THEN 0.3::DOUBLE ELSE 0 END AS v1
        FROM (SELECT *, category IN ('GENERAL_ROOM','GENERIC_ELEMENT','UNKNOWN') AS fb FROM ft WHERE mode = 'VERTICAL' AND NOT failed)))))))"""),
})

_TRI = ", ".join(f"CASE WHEN v{i} IN (1,2,5,6) THEN x1 ELSE x0 END AS x{i}_, CASE WHEN v{i} IN (2,3,6,7) THEN y1 ELSE y0 END AS y{i}_, CASE WHEN v{i} >= 4 THEN z1 ELSE z0 END AS z{i}_" for i in (1, 2, 3))
_NAME_KIND = """CASE WHEN express_id % 97 = 0 THEN 'IFCPROJECT' WHEN express_id % 97 = 1 THEN 'IFCSITE' WHEN express_id % 97 = 2 THEN 'IFCBUILDING' WHEN express_id % 53 = 0 THEN NULL ELSE upper(ifc_type) END"""
_AREA_FACTOR = "coalesce(manual_factor, CASE WHEN semantic_category = 'BALCONY' THEN 0.5 ELSE 1.0 END)"

ORACLES = {
    "scan_entities": with_ctes("""SELECT model_id, express_id AS entity_id, upper(ifc_type) AS entity_type, 5 AS n_args, '''' || name || '; it''''s (a)''' AS arg_name FROM elements""", "elements"),
    "scan_by_type": with_ctes("SELECT model_id, express_id, ifc_type, name FROM elements WHERE ifc_type IN ('IfcSpace','IfcSlab')", "elements"),
    "mesh_explode": with_ctes(f"""SELECT model_id, express_id, face, x1_ AS x1, y1_ AS y1, z1_ AS z1, x2_ AS x2, y2_ AS y2, z2_ AS z2, x3_ AS x3, y3_ AS y3, z3_ AS z3 FROM (
        SELECT model_id, express_id, face, {_TRI} FROM mesh, (VALUES (0,0,2,1),(1,0,3,2),(2,4,5,6),(3,4,6,7),(4,0,1,5),(5,0,5,4),(6,1,2,6),(7,1,6,5),(8,2,3,7),(9,2,7,6),(10,3,0,4),(11,3,4,7)) t(face, v1, v2, v3))""", "mesh"),
    "doc_text_concat": """SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, (text || chr(10) || '3.0.' || (doc_id % 30)
        || ' Storey height below 2.' || (doc_id % 5) || ' m counts 1/2 area' || chr(10)) AS t FROM documents)""",
    "pset_flatten": with_ctes("SELECT model_id, express_id, pset, prop, coalesce(value, '-') AS value FROM psets", "psets"),
    "containment_edges": with_ctes("""SELECT model_id, parent_id, child_id FROM contained_in UNION ALL SELECT model_id, parent_id, -child_id FROM contained_in WHERE child_id % 2 = 1""", "contained_in"),
    "bbox_dims": with_ctes("SELECT model_id, express_id, bbox_dx, bbox_dy, bbox_dz FROM dims", "dims"),
    "aspect_ratio": with_ctes("SELECT model_id, express_id, width, depth, aspect_ratio FROM dims", "dims"),
    "typed_measures": with_ctes("SELECT model_id, express_id, ifc_type, area, thickness, volume FROM dims", "dims"),
    "missing_geometry": with_ctes("""SELECT b.model_id, b.express_id, coalesce(bbox_dz, 0) AS height, coalesce(area, 0) AS area, coalesce(aspect_ratio, 1.0) AS aspect_ratio,
        CASE WHEN d.express_id IS NULL THEN 'No Geometry' END AS note FROM base b LEFT JOIN (SELECT * FROM dims WHERE express_id % 10 <> 3) d ON b.express_id = d.express_id""", "base", "dims"),
    "is_external": with_ctes("SELECT model_id, express_id, is_external FROM ext", "ext"),
    "floor_span": with_ctes("SELECT model_id, express_id, floor_span FROM span", "span"),
    "space_flags": with_ctes("SELECT * FROM flags", "flags"),
    "boundary_material": with_ctes("SELECT * FROM bm", "bm"),
    "node_name": with_ctes(f"""SELECT model_id, express_id, CASE WHEN (nm IS NULL OR nm IN ('Default','Untitled')) AND kind IN ('IFCPROJECT','IFCSITE','IFCBUILDING')
        THEN CASE kind WHEN 'IFCPROJECT' THEN 'Project Model' WHEN 'IFCSITE' THEN 'Site' ELSE 'Building' END
        ELSE coalesce(nm, coalesce(kind, 'Element') || ' (' || express_id || ')') END AS node_name FROM (
        SELECT model_id, express_id, {_NAME_KIND} AS kind, coalesce(nullif(CASE express_id % 4 WHEN 0 THEN 'Default' WHEN 1 THEN NULL ELSE name END, ''),
        CASE WHEN express_id % 3 = 0 THEN 'Long ' || express_id END) AS nm FROM elements)""", "elements"),
    "entity_id": with_ctes("SELECT model_id, express_id, CASE WHEN express_id % 10 = 0 THEN NULL ELSE express_id END AS entity_id FROM base", "base"),
    "rule_context": with_ctes("""SELECT region, 'Regulation Context: ' || region || chr(10) || string_agg(chr(10) || '[' || title || ']' || chr(10) || body, '' ORDER BY k) AS rule_context FROM (
        SELECT region, CASE category WHEN 'height' THEN 1 WHEN 'enclosure' THEN 2 ELSE 3 END AS k,
        CASE category WHEN 'height' THEN 'Height Requirements' WHEN 'enclosure' THEN 'Enclosure Requirements' ELSE 'Special Space Requirements' END AS title,
        string_agg('- ' || description || ' (Logic: ' || condition_logic || ')' || chr(10), '' ORDER BY rule_ord) AS body FROM rules GROUP BY 1, 2, 3) GROUP BY region""", "rules"),
    "ring_wkt": with_ctes("""SELECT model_id, poly_id, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS wkt FROM (
        SELECT model_id, poly_id, replace((gx/2.0::DOUBLE)::VARCHAR, '.0', '') AS x0, replace((gy/2.0::DOUBLE)::VARCHAR, '.0', '') AS y0,
        replace(((gx+gw)/2.0::DOUBLE)::VARCHAR, '.0', '') AS x1, replace(((gy+gd)/2.0::DOUBLE)::VARCHAR, '.0', '') AS y1 FROM fp)""", "fp"),
    "dynamic_categories": with_ctes("SELECT region, cat_ord, name, types AS valid_types FROM cats", "cats"),
    "class_mode": with_ctes("SELECT model_id, guid, mode FROM modes", "modes"),
    "candidates": with_ctes("SELECT model_id, guid, candidates FROM cand", "cand"),
    "reply_parse": with_ctes("SELECT model_id, guid, failed, category, raw_confidence, reasoning FROM parsed", "parsed"),
    "review_status": with_ctes("SELECT model_id, guid, status FROM alignment", "alignment"),
    "calibrate_general": with_ctes("SELECT model_id, guid, category, raw_confidence, confidence FROM gen", "gen"),
    "calibrate_vertical": with_ctes("SELECT model_id, guid, category, raw_confidence, confidence FROM ver", "ver"),
    "baseline_classify": with_ctes("""SELECT model_id, guid, CASE WHEN hit THEN guess ELSE cl[1] END AS category, CASE WHEN hit THEN 0.8 ELSE 0.5 END AS raw_confidence FROM (
        SELECT *, coalesce(list_contains(cl, guess), false) AS hit FROM (
        SELECT f.model_id, f.guid, string_split(candidates, ',') AS cl, CASE WHEN mode = 'VERTICAL' THEN
          CASE WHEN floor_span < 1.5 THEN CASE WHEN contains(lower(name), 'corridor') THEN 'CORRIDOR' ELSE 'GENERAL_ROOM' END WHEN stair THEN 'STAIRWELL' WHEN transport THEN 'ELEVATOR_SHAFT'
          WHEN mep THEN 'MEP_SHAFT' WHEN material = 'RAILING' THEN 'ATRIUM' WHEN material = 'WALL' THEN 'FUNCTIONAL_SHAFT' END
        ELSE (list_filter(string_split(candidates, ','), lambda c: contains(replace(replace(upper(f.name), ' ', ''), '-', ''), replace(c, '_', ''))))[1] END AS guess
        FROM ft f JOIN cand USING (model_id, guid)))""", "ft", "cand"),
    "align": with_ctes("""SELECT x.model_id, x.guid, name, x.ifc_type, category AS semantic_category, confidence, CASE WHEN confidence >= 0.65 THEN 'AUTO_MAPPED' ELSE 'NEEDS_REVIEW' END AS status, reasoning, gw*gd/4.0::DOUBLE AS area FROM (
        SELECT model_id, guid, name, ifc_type, category, confidence, reasoning FROM gen UNION ALL SELECT model_id, guid, name, ifc_type, category, confidence, reasoning FROM ver
        UNION ALL SELECT model_id, guid, name, ifc_type, category, 0.0, reasoning FROM ft WHERE failed) x JOIN base b ON b.model_id = x.model_id AND b.guid = x.guid""", "gen", "ver", "ft", "base"),
    "latest_alignment": with_ctes("""SELECT model_id, guid, CASE WHEN express_id % 9 = 0 THEN 'CORRIDOR' ELSE semantic_category END AS semantic_category,
        CASE WHEN express_id % 9 = 0 THEN confidence/2 ELSE confidence END AS confidence, CASE WHEN express_id % 9 = 0 THEN 2 ELSE 1 END AS ord FROM alignment""", "alignment"),
    "alignment_meta": with_ctes(f"""SELECT model_id, count(*) AS total, count(*) FILTER (status = 'NEEDS_REVIEW' AND express_id % 43 <> 0) AS needs_review,
        {rnd("count(*) FILTER (status = 'AUTO_MAPPED' AND express_id % 43 <> 0)/count(*)", 4)} AS auto_share FROM alignment GROUP BY 1""", "alignment"),
    "confidence_hist": with_ctes(f"""SELECT CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n,
        {rnd('count(*)*100.0::DOUBLE/(SELECT count(*) FROM alignment)', 1)} AS percent FROM alignment GROUP BY 1""", "alignment"),
    "treatment_counts": with_ctes(f"""SELECT CASE {_AREA_FACTOR} WHEN 1.0 THEN 'full' WHEN 0.5 THEN 'half' WHEN 0.0 THEN 'excluded' ELSE 'other' END AS treatment, count(*) AS n FROM alignment GROUP BY 1""", "alignment"),
    "review_impact": with_ctes(f"""SELECT model_id, n_pending, CASE WHEN total > 0 THEN {rnd('at_stake*100.0::DOUBLE/total', 2)} END AS impact_percent FROM (
        SELECT model_id, count(*) FILTER (status = 'NEEDS_REVIEW') AS n_pending, {esum('area*f')} AS total,
        {esum("CASE WHEN status = 'NEEDS_REVIEW' THEN area*greatest(f, abs(1-f)) ELSE 0 END")} AS at_stake FROM (SELECT *, ({_AREA_FACTOR})::DOUBLE AS f FROM alignment) GROUP BY 1)""", "alignment"),
}
