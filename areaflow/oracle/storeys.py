"""Independent SQL for storeys and storey assignment."""

from areaflow.oracle.base import CTES, esum, rnd, with_ctes

CTES.update({
    "st_m": (["storeys_raw", "models"], """SELECT s.*, coalesce(raw_elevation*unit_scale, 0.0) AS elevation
        FROM storeys_raw s JOIN models USING (model_id)"""),
    "ranked": (["st_m"], "SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY elevation, storey_id) AS rn FROM st_m"),
    "greedy": (["ranked"], """SELECT model_id, rn, elevation AS last_e, true AS keep FROM ranked WHERE rn = 1
        UNION ALL SELECT r.model_id, r.rn, CASE WHEN r.elevation - g.last_e > 0.2::DOUBLE THEN r.elevation ELSE g.last_e END,
        r.elevation - g.last_e > 0.2::DOUBLE FROM greedy g JOIN ranked r ON r.model_id = g.model_id AND r.rn = g.rn + 1"""),
    "storeys": (["ranked", "greedy"], """SELECT r.model_id, storey_id, name, elevation, raw_elevation, placement_id,
        row_number() OVER w AS ord, lead(elevation) OVER w AS next_e,
        coalesce(lead(elevation) OVER w - elevation, 3.0::DOUBLE) AS height
        FROM ranked r JOIN greedy g ON g.model_id = r.model_id AND g.rn = r.rn WHERE keep
        WINDOW w AS (PARTITION BY r.model_id ORDER BY elevation, storey_id)"""),
    "tol": (["storeys"], """SELECT model_id, min(next_e - elevation) AS min_gap,
        CASE WHEN min(next_e - elevation) IS NULL THEN 2.0::DOUBLE ELSE greatest(1.5::DOUBLE, min(next_e - elevation)/2.0) END AS tolerance
        FROM storeys GROUP BY 1"""),
    "env": (["element_z"], """SELECT * FROM element_z WHERE ifc_type IN ('IfcWall','IfcWallStandardCase','IfcCurtainWall','IfcPlate',
        'IfcCovering','IfcMember','IfcColumn','IfcBuildingElementProxy','IfcWindow','IfcDoor')"""),
    "near": (["env", "storeys"], """SELECT model_id, express_id, storey_id, elevation AS storey_elevation, dist FROM (
        SELECT e.model_id, e.express_id, s.storey_id, s.elevation, abs(z_m - s.elevation) AS dist,
        row_number() OVER (PARTITION BY e.model_id, e.express_id ORDER BY abs(z_m - s.elevation), s.ord) AS k
        FROM env e JOIN storeys s ON e.model_id = s.model_id) WHERE k = 1"""),
    "slab_st": (["element_z", "storeys", "contained_in"], """SELECT model_id, express_id, storey_id FROM (
        SELECT z.model_id, z.express_id, coalesce(c.storey_id, s.storey_id) AS storey_id,
        row_number() OVER (PARTITION BY z.model_id, z.express_id ORDER BY s.ord) AS k
        FROM element_z z
        LEFT JOIN (SELECT ci.model_id, child_id, parent_id AS storey_id FROM contained_in ci JOIN storeys k ON k.model_id = ci.model_id AND k.storey_id = ci.parent_id) c
          ON c.model_id = z.model_id AND c.child_id = z.express_id
        LEFT JOIN storeys s ON s.model_id = z.model_id AND z_m >= s.elevation - 0.5::DOUBLE AND (s.next_e IS NULL OR z_m < s.next_e)
        WHERE z.ifc_type = 'IfcSlab') WHERE k = 1 AND storey_id IS NOT NULL"""),
    "sem_st": (["alignment", "storeys"], """SELECT * FROM (SELECT a.*, s.storey_id, row_number() OVER (PARTITION BY a.model_id, a.guid ORDER BY s.ord) AS k
        FROM alignment a JOIN storeys s ON s.model_id = a.model_id AND z_m >= s.elevation - 0.1::DOUBLE AND (s.next_e IS NULL OR z_m < s.next_e)) WHERE k = 1"""),
    "anchors": (["storeys"], """SELECT model_id, storey_id AS outline_ord, elevation + (storey_id % 5 - 2)*0.06::DOUBLE AS outline_elev, 50.0::DOUBLE + storey_id % 40 AS outline_area
        FROM storeys WHERE storey_id % 6 <> 0"""),
})

ORACLES = {
    "unit_scale": with_ctes("SELECT model_id, storey_id, " + rnd("elevation", 4) + " AS elevation FROM st_m", "st_m"),
    "greedy_gap": with_ctes("SELECT model_id, storey_id, " + rnd("elevation", 4) + " AS elevation FROM storeys", "storeys"),
    "storey_height": with_ctes("SELECT model_id, storey_id, " + rnd("elevation", 4) + " AS elevation, " + rnd("height", 4)
                               + " AS height FROM storeys", "storeys"),
    "min_gap": with_ctes(f"SELECT model_id, {rnd('min_gap', 4)} AS min_gap, {rnd('tolerance', 4)} AS tolerance FROM tol", "tol"),
    "roof_filter": with_ctes("""SELECT model_id, storey_id, name FROM storeys_raw
        WHERE name IS NULL OR NOT regexp_matches(upper(name), '屋顶|屋面|ROOF|RF|RL')""", "storeys_raw"),
    "storey_name": with_ctes("""SELECT model_id, storey_id, replace(coalesce(nullif(name, ''),
        'Level ' || row_number() OVER (PARTITION BY model_id ORDER BY storey_id)), '标高', 'Level') AS display_name FROM storeys_raw""", "storeys_raw"),
    "slab_storey": with_ctes("SELECT model_id, express_id, storey_id FROM slab_st", "slab_st"),
    "semantic_storey": with_ctes("SELECT model_id, guid, storey_id FROM sem_st", "sem_st"),
    "slab_storey_asof": with_ctes("""SELECT model_id, express_id, storey_id FROM (
        SELECT b.model_id, b.express_id, CASE WHEN is_contained THEN home_storey ELSE s.storey_id END AS storey_id,
        row_number() OVER (PARTITION BY b.express_id ORDER BY s.elevation DESC, s.storey_id DESC) AS k
        FROM base b LEFT JOIN st_m s ON s.model_id = b.model_id AND s.elevation <= (z_cm/100.0::DOUBLE + (z_cm + h_cm)/100.0::DOUBLE)/2.0
        WHERE ifc_type = 'IfcSlab') WHERE k = 1""", "base", "st_m"),
    "nearest_storey": with_ctes("""SELECT near.model_id, express_id, storey_id, """ + rnd("storey_elevation", 4) + """ AS storey_elevation
        FROM near JOIN tol USING (model_id) WHERE dist < tolerance""", "near", "tol"),
    "outline_lookup": with_ctes("""SELECT model_id, storey_id, outline_ord, coalesce(outline_area, 0.0) AS outline_area FROM (
        SELECT s.model_id, s.storey_id, outline_ord, outline_area, row_number() OVER (PARTITION BY s.model_id, s.storey_id ORDER BY outline_ord) AS k
        FROM storeys s LEFT JOIN anchors o ON o.model_id = s.model_id AND abs(outline_elev - s.elevation) < 0.1::DOUBLE) WHERE k = 1""", "storeys", "anchors"),
    "wall_grouping": with_ctes(f"""SELECT w.model_id, express_id, grouping, {rnd("CASE grouping WHEN 'target' THEN target_key WHEN 'local' THEN local_key ELSE global_key END", 4)} AS group_key
        FROM wk w JOIN (SELECT model_id, CASE WHEN count(target_key) > 0 THEN 'target' WHEN count(DISTINCT local_key) > 1 THEN 'local' ELSE 'global' END AS grouping FROM wk GROUP BY 1) g USING (model_id)
        WHERE grouping <> 'target' OR target_key IS NOT NULL""", "wk", extra={
        "wk": (["env", "near", "placements", "models"], """SELECT e.model_id, e.express_id, CASE WHEN n.dist < 0.01::DOUBLE THEN n.storey_elevation END AS target_key,
            round(p.dz/1000.0)*1000.0 AS local_key, round(e.z_m/unit_scale/1000.0)*1000.0 AS global_key
            FROM env e JOIN near n USING (model_id, express_id) JOIN models m ON m.model_id = e.model_id
            JOIN placements p ON p.model_id = e.model_id AND p.placement_id = e.express_id*4+2""")}),
    "walls_per_storey": with_ctes("""SELECT s.model_id, s.storey_id, count(n.express_id) AS n_walls FROM storeys s
        LEFT JOIN near n ON n.model_id = s.model_id AND n.storey_id = s.storey_id AND n.dist < 1.0 GROUP BY 1, 2""", "storeys", "near"),
    "envelope_union": with_ctes("SELECT model_id, express_id, ifc_type FROM env", "env"),
    "first_n": with_ctes("""SELECT model_id, express_id, rn FROM (SELECT model_id, express_id, row_number() OVER (PARTITION BY model_id ORDER BY express_id) AS rn
        FROM base WHERE ifc_type = 'IfcWall') WHERE rn <= 5""", "base"),
    "global_z": with_ctes("""SELECT model_id, placement_id, root_id, depth, """ + rnd("z", 4) + """ AS z FROM (
        SELECT *, row_number() OVER (PARTITION BY model_id, placement_id ORDER BY depth DESC) AS k FROM walk) WHERE k = 1""", "walk", extra={
        "walk": (["placements"], """SELECT model_id, placement_id, placement_id AS root_id, parent_id, CAST(dz AS DECIMAL(18,6)) AS z, 0 AS depth FROM placements
            UNION ALL SELECT w.model_id, w.placement_id, p.placement_id, p.parent_id, CAST(w.z + CAST(p.dz AS DECIMAL(18,6)) AS DECIMAL(18,6)), depth + 1
            FROM walk w JOIN placements p ON p.model_id = w.model_id AND p.placement_id = w.parent_id""")}),
}
