"""Independent SQL for clearance, review and the spatial tree."""

from areaflow.oracle.base import CTES, rnd, with_ctes
from areaflow.oracle.features import ORACLES as _FEATURES
from areaflow.oracle.geometry import _half

_TOUCH = "a.gx <= o.gx+o.gw AND o.gx <= a.gx+a.gw AND a.gy <= o.gy+o.gd AND o.gy <= a.gy+a.gd"
_COVER = "o.ifc_type IN ('IfcRoof','IfcCovering')"
_EFF = "CASE WHEN o.z0 > a.z1 THEN o.z0 ELSE o.z1 END"

CTES.update({
    "box": (["base"], "SELECT *, z_cm/100.0::DOUBLE AS z0, (z_cm+h_cm)/100.0::DOUBLE AS z1 FROM base"),
    "sab": (["box"], f"""SELECT a.model_id, a.express_id, arg_min(o.express_id, (o.z0, o.express_id)) AS above_id, min(o.z0) AS above_z
        FROM box a JOIN box o ON a.model_id = o.model_id AND o.ifc_type = 'IfcSlab' AND o.z0 > a.z1 AND {_TOUCH} WHERE a.ifc_type = 'IfcSlab' GROUP BY 1, 2"""),
    "cnd": (["box", "sab"], f"""SELECT a.model_id, a.express_id, a.z1 AS top, a.gx, a.gy, a.gw, a.gd, o.express_id AS other, o.z0, o.z1, {_EFF} AS eff
        FROM box a JOIN box o ON a.model_id = o.model_id AND {_COVER} AND o.z1 > a.z1 AND {_TOUCH}
        WHERE a.ifc_type = 'IfcSlab' AND NOT EXISTS (SELECT 1 FROM sab s WHERE s.express_id = a.express_id)"""),
    "home": (["box", "st_m"], """SELECT model_id, express_id, storey_id, next_e FROM (
        SELECT b.model_id, b.express_id, s.storey_id, s.next_e, row_number() OVER (PARTITION BY b.express_id ORDER BY s.elevation DESC, s.storey_id DESC) AS k
        FROM box b JOIN (SELECT *, nullif(lead(elevation) OVER (PARTITION BY model_id ORDER BY elevation, storey_id), 0) AS next_e FROM st_m) s ON s.model_id = b.model_id
          AND CASE WHEN is_contained THEN s.storey_id = home_storey ELSE s.elevation <= (z0+z1)/2.0 END WHERE ifc_type = 'IfcSlab') WHERE k = 1"""),
    "clr": (["box", "sab", "cnd", "home"], """SELECT a.model_id, a.express_id, h.storey_id, coalesce(above_z - a.z1, e - a.z1, next_e - a.z1, 3.0) AS c
        FROM box a JOIN home h ON h.express_id = a.express_id LEFT JOIN sab s ON s.express_id = a.express_id
        LEFT JOIN (SELECT express_id, min(eff) AS e FROM cnd GROUP BY 1) m ON m.express_id = a.express_id WHERE a.ifc_type = 'IfcSlab'"""),
    "crs": (["cnd"], "SELECT * FROM cnd WHERE z0 <= top + 2.2::DOUBLE AND top + 2.2::DOUBLE <= z1"),
    "cell": (["crs", "cnd_all"], """SELECT model_id, express_id, i, j, gw*gd/4.0::DOUBLE AS slab_area, min(eff) - top AS c, min(eff) - top >= 2.2::DOUBLE AS hi FROM (
          SELECT p.*, i, j, c.eff FROM (SELECT DISTINCT model_id, express_id, top, gx, gy, gw, gd FROM crs) p, unnest(generate_series(1, 18)) t(i), unnest(generate_series(1, 18)) u(j), cnd_all c
          WHERE c.s_id = p.express_id AND p.gx + i*p.gw/19.0 BETWEEN c.ox AND c.ox+c.ow AND p.gy + j*p.gd/19.0 BETWEEN c.oy AND c.oy+c.od) GROUP BY model_id, express_id, i, j, gw, gd, top"""),
    "smp": (["cell"], "SELECT express_id, count(*) AS n, count(*) FILTER (hi) AS hi FROM cell GROUP BY 1"),
    "stretch": (["cell"], """SELECT *, row_number() OVER (ORDER BY express_id, j, i0) AS r FROM (SELECT model_id, express_id, any_value(slab_area) AS slab_area, j, hi, min(i) AS i0, max(i) AS i1,
        count(*) AS n, min(c) AS c0, max(c) AS c1 FROM (SELECT *, i - row_number() OVER (PARTITION BY express_id, j, hi ORDER BY i) AS g FROM cell) GROUP BY model_id, express_id, j, hi, g)"""),
    "joins": (["stretch"], """SELECT a.r AS a, b.r AS b FROM stretch a JOIN stretch b ON a.express_id = b.express_id AND a.hi = b.hi AND b.j IN (a.j - 1, a.j + 1) AND a.i0 <= b.i1 AND b.i0 <= a.i1"""),
    "reach": (["joins"], "SELECT r AS r0, r FROM stretch UNION SELECT r0, b FROM reach JOIN joins ON a = reach.r"),
    "cnd_all": (["cnd", "box"], "SELECT c.express_id AS s_id, c.eff, o.gx AS ox, o.gy AS oy, o.gw AS ow, o.gd AS od FROM cnd c JOIN box o ON o.express_id = c.other"),
    "fold": (["alignment", "review_actions"], """SELECT a.model_id, a.guid, count(*) AS n, count(*) FILTER (op = 'update') AS u, arg_max(new_type, seq) FILTER (op = 'update') AS t,
        coalesce(string_agg(' [Manual Edit: ' || reason || ']', '' ORDER BY seq) FILTER (op = 'update' AND reason <> ''), '') AS notes
        FROM review_actions r JOIN alignment a ON a.model_id = r.model_id AND a.guid = r.guid GROUP BY 1, 2"""),
    "nodes": (["base", "storeys_raw", "models"], """SELECT model_id, 1000000000000000 + model_id*10 AS id, 'IFCPROJECT' AS t, NULL::BIGINT AS p FROM models
        UNION ALL SELECT model_id, 1000000000000001 + model_id*10, 'IFCSITE', 1000000000000000 + model_id*10 FROM models
        UNION ALL SELECT model_id, 1000000000000002 + model_id*10, 'IFCBUILDING', 1000000000000001 + model_id*10 FROM models WHERE model_id % 7 <> 0
        UNION ALL SELECT model_id, 2000000000000000 + storey_id, 'IFCBUILDINGSTOREY', 1000000000000000 + model_id*10 + CASE WHEN model_id % 7 = 0 THEN 1 ELSE 2 END FROM storeys_raw
        UNION ALL SELECT model_id, 3000000000000000 + express_id, upper(ifc_type), 2000000000000000 + home_storey FROM base WHERE is_contained"""),
    "tree": (["nodes"], """SELECT model_id, id, t, 0 AS depth, lpad(id::VARCHAR, 19, '0') AS path FROM nodes WHERE t = CASE WHEN model_id % 7 = 0 THEN 'IFCSITE' ELSE 'IFCBUILDING' END
        UNION ALL SELECT n.model_id, n.id, n.t, depth + 1, path || '/' || lpad(n.id::VARCHAR, 19, '0') FROM tree r JOIN nodes n ON n.model_id = r.model_id AND n.p = r.id"""),
})

_MF = "CASE WHEN contains(upper({t}), 'BALCONY') THEN 0.5 WHEN contains(upper({t}), 'EXTERIOR') AND contains(upper({t}), 'SLAB') THEN 0.0 END"
_FOLD = with_ctes(f"""SELECT a.model_id, a.guid, CASE WHEN u > 0 THEN t ELSE semantic_category END AS semantic_category, CASE WHEN n > 0 THEN 'VERIFIED' ELSE status END AS status,
    CASE WHEN u > 0 THEN {_MF.format(t='t')} ELSE manual_factor END AS manual_factor, reasoning || coalesce(notes, '') AS reasoning
    FROM alignment a LEFT JOIN fold f ON f.model_id = a.model_id AND f.guid = a.guid""", "alignment", "fold")
_FACTOR = "coalesce(manual_factor, CASE WHEN semantic_category = 'BALCONY' THEN 0.5 ELSE 1.0 END)"

ORACLES = {
    "mesh_footprint": with_ctes("SELECT model_id, express_id, gw*gd/4.0::DOUBLE AS area, 4 AS n_edges FROM base WHERE ifc_type = 'IfcSlab'", "base"),
    "footprint_ring": with_ctes(f"""SELECT model_id, express_id, 'POLYGON ((' || {_half('gx')} || ' ' || {_half('gy')} || ', ' || {_half('gx+gw')} || ' ' || {_half('gy')} || ', '
        || {_half('gx+gw')} || ' ' || {_half('gy+gd')} || ', ' || {_half('gx')} || ' ' || {_half('gy+gd')} || ', ' || {_half('gx')} || ' ' || {_half('gy')} || '))' AS footprint
        FROM base WHERE ifc_type = 'IfcSlab'""", "base"),
    "section_lines": with_ctes("SELECT model_id, express_id, 8 AS n_segments, (gw + gd)::DOUBLE AS total_length FROM base WHERE h_cm >= 100", "base"),
    "slab_above": with_ctes("SELECT * FROM sab", "sab"),
    "nearest_above": with_ctes(f"""SELECT a.model_id, a.express_id, arg_min(o.express_id, (o.z0, o.express_id)) AS above_id, min(o.z0) AS above_z
        FROM box a JOIN box o ON a.model_id = o.model_id AND {_COVER} AND o.z0 > a.z1 AND {_TOUCH} WHERE a.ifc_type = 'IfcSlab' GROUP BY 1, 2""", "box"),
    "ray_height": with_ctes(f"""SELECT a.model_id, a.express_id, min({_EFF}) AS z FROM box a JOIN box o ON a.model_id = o.model_id AND {_COVER} AND o.z1 > a.z1
        AND 2*a.gx + a.gw BETWEEN 2*o.gx AND 2*(o.gx+o.gw) AND 2*a.gy + a.gd BETWEEN 2*o.gy AND 2*(o.gy+o.gd) WHERE a.ifc_type = 'IfcSlab' GROUP BY 1, 2""", "box"),
    "clearance": with_ctes(f"SELECT model_id, express_id, storey_id, {rnd('c', 4)} AS min_clearance FROM clr", "clr"),
    "section_crossing": with_ctes(f"SELECT model_id, express_id, other, {rnd('z0', 4)} AS min_z, {rnd('z1', 4)} AS max_z FROM crs", "crs"),
    "clearance_class": with_ctes(f"""SELECT model_id, c.express_id, storey_id, CASE WHEN hi > 0 AND hi < n THEN 'variable' WHEN c >= 2.2::DOUBLE THEN 'high' ELSE 'low' END AS height_class,
        {rnd('hi/n', 4)} AS high_share FROM clr c LEFT JOIN smp s ON s.express_id = c.express_id""", "clr", "smp"),
    "height_regions": with_ctes(f"""SELECT model_id, express_id, min(i0*20 + j) AS region, CASE WHEN hi THEN 'high' ELSE 'low' END AS height_class, sum(n)::BIGINT AS n_cells,
        {rnd('any_value(slab_area)/324*sum(n)', 4)} AS area, {rnd('min(c0)', 4)} AS lowest, {rnd('max(c1)', 4)} AS highest
        FROM stretch JOIN (SELECT r, min(r0) AS g FROM reach GROUP BY 1) USING (r) GROUP BY model_id, express_id, hi, g""", "stretch", "reach"),
    "element_factor": with_ctes(f"SELECT model_id, guid, {_FACTOR} AS calc_factor, status = 'NEEDS_REVIEW' AS is_dirty FROM alignment", "alignment"),
    "manual_factor": with_ctes(f"SELECT seq, new_type, {_MF.format(t='new_type')} AS manual_factor FROM review_actions WHERE op = 'update'", "review_actions"),
    "element_view": with_ctes(f"""SELECT b.model_id, b.guid, b.express_id, a.ifc_type AS type, CASE WHEN a.guid IS NULL THEN 0.0 ELSE {_FACTOR} END AS calc_factor,
        CASE WHEN a.guid IS NULL THEN 'Analysis not run yet. Please click ''Run Analysis'' first.' ELSE 'Agent 2 Identified as ' || coalesce(semantic_category, 'None') || ' (' || confidence || ').' || chr(10) || 'Reasoning: ' || reasoning END AS reason,
        a.status = 'NEEDS_REVIEW' AS is_dirty FROM base b LEFT JOIN alignment a ON a.express_id = b.express_id""", "base", "alignment"),
    "review_fold": _FOLD,
    "review_stream": _FOLD,
    "align_stream": _FEATURES["align"],
    "rejected_actions": with_ctes("SELECT model_id, guid, seq, op FROM review_actions r WHERE NOT EXISTS (SELECT 1 FROM alignment a WHERE a.model_id = r.model_id AND a.guid = r.guid)", "review_actions", "alignment"),
    "queue_after_review": with_ctes("""SELECT model_id, guid, express_id, ifc_type AS type, reasoning AS reason FROM alignment a WHERE status = 'NEEDS_REVIEW' AND guid NOT IN (SELECT guid FROM review_actions)""", "alignment", "review_actions"),
    "review_counts": with_ctes("""SELECT a.model_id, greatest(0, count(*) FILTER (status = 'NEEDS_REVIEW') - count(f.guid)) AS needs_review FROM alignment a LEFT JOIN fold f USING (model_id, guid) GROUP BY 1""", "alignment", "fold"),
    "spatial_tree": with_ctes("SELECT model_id, id AS node_id, t AS node_type, depth, path FROM tree", "tree"),
}
