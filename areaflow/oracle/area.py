"""Independent SQL for rules, area arms and report tables."""

from areaflow.oracle import storeys as _storeys  # noqa: F401  (adds the storey tables)
from areaflow.oracle.geometry import outline_ctes
from areaflow.oracle.base import CTES, esum, rnd, with_ctes

_ROOF = "(name IS NULL OR NOT regexp_matches(upper(name), '屋顶|屋面|ROOF|RF|RL'))"


def area_ctes(prefix: str, inputs: str, deps: list[str]) -> dict[str, tuple[list[str], str]]:
    """The area calculation over `inputs`(model_id, storey_id, name, elevation, height, region, base_area, outside_area)."""
    p = prefix
    k_full, k_half, k_ex = ("k = 1.0", "k = 0.5", "k = 0.0")
    moves = []
    for name, lvl, cond in (("f", 1.0, k_full), ("h", 0.5, k_half), ("e", 0.0, k_ex)):
        leave = f"{cond} AND arm IN ('manual','balcony')" if name == "e" else cond
        moves.append(f"CASE WHEN c = {lvl} THEN a ELSE 0 END - CASE WHEN {leave} THEN a ELSE 0 END AS m{name}")
    return {
        f"{p}k": ([*deps, "rules"], f"""SELECT s.*, coalesce((SELECT arg_max(coefficient, rule_ord) FROM rules r WHERE r.region = s.region AND r.category = 'height'
            AND CASE r.condition_logic WHEN 'h < 2.2' THEN s.height < 2.2::DOUBLE WHEN 'h < 1.2' THEN s.height < 1.2::DOUBLE WHEN 'h >= 2.2' THEN s.height >= 2.2::DOUBLE ELSE false END), 1.0) AS k,
            (SELECT coefficient FROM rules r WHERE r.region = s.region AND r.category = 'enclosure' AND contains(upper(description), 'BALCONY') ORDER BY rule_ord LIMIT 1) AS bk
            FROM ({inputs}) s WHERE {_ROOF}"""),
        f"{p}sp": (["rules", "alignment"], """SELECT region, cat, min(rule_ord) AS o FROM (SELECT DISTINCT upper(semantic_category) AS cat FROM alignment) JOIN rules
            ON category = 'special_use' AND (contains(cat, upper(description)) OR contains(upper(description), cat)) GROUP BY 1, 2"""),
        f"{p}it": ([f"{p}k", f"{p}sp", "sem_st", "rules"], f"""SELECT model_id, storey_id, express_id + 2 AS ord, arm, cat, a, c, k, desc_ FROM (
            SELECT *, CASE arm WHEN 'manual' THEN manual_factor WHEN 'balcony' THEN bk WHEN 'void' THEN 0.0 ELSE sc END AS c FROM (
            SELECT x.model_id, x.storey_id, i.express_id, upper(i.semantic_category) AS cat, i.area AS a, i.manual_factor, x.k, x.bk, r.coefficient AS sc, r.description AS desc_,
            CASE WHEN semantic_category IS NULL THEN 'none' WHEN manual_factor IS NOT NULL THEN 'manual' WHEN contains(upper(semantic_category), 'BALCONY') THEN 'balcony'
              WHEN upper(semantic_category) IN ('SHAFT','VOID','ATRIUM') THEN 'void' WHEN upper(semantic_category) IN ('STAIRWELL','ELEVATOR_SHAFT') THEN 'none'
              WHEN r.coefficient IS NOT NULL THEN 'special' ELSE 'none' END AS arm
            FROM sem_st i JOIN {p}k x ON x.model_id = i.model_id AND x.storey_id = i.storey_id
            LEFT JOIN {p}sp m ON m.region = x.region AND m.cat = upper(i.semantic_category)
            LEFT JOIN rules r ON r.region = m.region AND r.rule_ord = m.o AND r.category = 'special_use')) WHERE arm <> 'none'"""),
        f"{p}parts": ([f"{p}it", f"{p}k"], f"""SELECT model_id, storey_id, ord, arm, cat AS category, a AS raw_area, c AS coefficient, a*c AS effective_area,
            CASE arm WHEN 'manual' THEN 'Manual Factor Override' WHEN 'balcony' THEN 'Semantic Balcony Adjustment' WHEN 'void' THEN 'Excluded/Void' ELSE 'Special Rule: ' || desc_ END AS note,
            CASE arm WHEN 'void' THEN -a WHEN 'special' THEN a*(c - 1.0::DOUBLE) ELSE a*(c - k) END AS adj, a AS consumed, {', '.join(moves)},
            CASE arm WHEN 'manual' THEN 'Manual Adjustment ' || cat || ' (' || a || 'm2 * ' || c || ')' WHEN 'balcony' THEN 'Adjusted ' || cat || ' (' || a || 'm2 * ' || c || ' [Base ' || k || '])'
              WHEN 'void' THEN 'Subtracted ' || cat || ' (' || a || 'm2)' ELSE 'Adjusted ' || cat || ' (' || a || 'm2 * ' || c || ')' END AS detail FROM {p}it
            UNION ALL SELECT model_id, storey_id, 1, 'outside', 'Geometric Balcony/Outside', outside_area, 0.5::DOUBLE, outside_area*0.5::DOUBLE,
            'Derived from geometry difference (Slab - Wall Outline)', outside_area*0.5::DOUBLE, 0.0::DOUBLE, 0, outside_area, 0,
            'Geometric Balcony/Outside (' || {rnd('outside_area', 2)} || 'm2 * 0.5)' FROM {p}k WHERE outside_area > 0.01"""),
        f"{p}sums": ([f"{p}parts", f"{p}k"], f"""SELECT x.*, coalesce(adj, 0) AS adj, coalesce(consumed, 0) AS consumed, coalesce(mf, 0) AS mf, coalesce(mh, 0) AS mh, coalesce(me, 0) AS me, coalesce(np, 0) AS np
            FROM {p}k x LEFT JOIN (SELECT model_id, storey_id, {esum('adj')} AS adj, {esum('consumed')} AS consumed, {esum('mf')} AS mf, {esum('mh')} AS mh, {esum('me')} AS me, count(*) AS np
            FROM {p}parts GROUP BY 1, 2) USING (model_id, storey_id)"""),
        f"{p}comp": ([f"{p}sums", f"{p}parts"], f"""SELECT model_id, storey_id, ord, arm, category, raw_area, coefficient, effective_area, note, detail FROM {p}parts
            UNION ALL SELECT model_id, storey_id, 0, 'residual', 'General Floor Area (Enclosed)', greatest(0, base_area - consumed), k, greatest(0, base_area - consumed)*k,
            'Remaining area after specific element adjustments', NULL FROM {p}sums"""),
        f"{p}rep": ([f"{p}sums"], f"""SELECT model_id, region, storey_id, name AS story_name, {rnd('elevation', 4)} AS elevation, {rnd('height', 4)} AS height, {rnd('base_area', 2)} AS base_area,
            k AS height_coefficient, {rnd('adj', 2)} AS adjustments_area, {rnd('greatest(0, base_area*k + adj)', 2)} AS calculated_area,
            {rnd('greatest(0, CASE WHEN k = 1 THEN base_area ELSE 0 END + mf)', 2)} AS area_full, {rnd('greatest(0, CASE WHEN k = 0.5 THEN base_area ELSE 0 END + mh)', 2)} AS area_half,
            {rnd('greatest(0, CASE WHEN k = 0 THEN base_area ELSE 0 END + me)', 2)} AS area_excluded, np AS n_parts, greatest(0, base_area*k + adj) AS exact_area FROM {p}sums"""),
        f"{p}tot": ([f"{p}rep"], f"""SELECT *, 'Total Calculated Area: ' || total_area || ' sq.m across ' || story_count || ' stories.' AS summary_text FROM (
            SELECT model_id, min(region) AS regulation_applied, {rnd(esum('exact_area'), 2)} AS total_area, count(*) AS story_count FROM {p}rep GROUP BY 1)"""),
    }


CTES.update(area_ctes("p_", """SELECT s.*, m.region, i.base_area, i.outside_area FROM storeys s JOIN area_inputs i USING (model_id, storey_id) JOIN models m ON m.model_id = s.model_id""",
                      ["storeys", "area_inputs", "models"]))

CTES.update({"qw": (["near", "tol", "base"], """SELECT n.model_id, n.storey_id, n.express_id AS poly_id, gx, gy, gw, gd FROM near n JOIN tol USING (model_id)
        JOIN base b ON b.express_id = n.express_id WHERE dist < tolerance"""),
    "qslab": (["slab_st", "base"], """SELECT DISTINCT s.model_id, s.storey_id, cx, cy FROM slab_st s JOIN base b USING (express_id), unnest(generate_series(gx, gx+gw-1)) t(cx), unnest(generate_series(gy, gy+gd-1)) u(cy)""")})
CTES.update(outline_ctes("q_", "qw"))
CTES.update(area_ctes("f_", """SELECT s.*, m.region, coalesce(o.a, 0) AS base_area, CASE WHEN o.a IS NULL THEN 0 ELSE coalesce(d.a, 0) END AS outside_area
    FROM storeys s JOIN models m USING (model_id)
    LEFT JOIN (SELECT storey_id, count(*)/4.0::DOUBLE AS a FROM q_fill GROUP BY 1) o ON o.storey_id = s.storey_id
    LEFT JOIN (SELECT storey_id, count(*)/4.0::DOUBLE AS a FROM qslab q WHERE NOT EXISTS (SELECT 1 FROM q_fill f WHERE f.storey_id = q.storey_id AND f.cx = q.cx AND f.cy = q.cy) GROUP BY 1) d ON d.storey_id = s.storey_id""",
    ["storeys", "models", "q_fill", "qslab"]))

_D = "(doc_id % 5)"
CTES.update({
    "cl": ([], f"""SELECT doc_id, '3.0.' || (doc_id % 30) AS citation, 1 AS c, 'Storey height below 2.' || {_D} || ' m counts 1/2 area; height of 2.' || {_D} || ' m and above counts full area.' AS body FROM documents
        UNION ALL SELECT doc_id, '3.1.' || (doc_id % 9), 2, (['阳台应计算1/2面积；封闭阳台应计算全面积。', '结构层高在2.20m及以上的，应计算全面积；结构层高在2.20m以下的，应计算1/2面积。',
        'Parking and basement areas are excluded.', '建筑物内的变形缝，应合并计算。', 'Storey height not less than 2.2 m counts full area.',
        '层高不低于2.20m的，应计算全面积；结构层高在1.20m及以上至2.10m以下的，应计算1/2面积。', '层高大于4.50米的部分不应计算面积。',
        'Basement parts of more than 3.5 metres or not more than 1.2 meters are excluded.'])[doc_id % 8 + 1] FROM documents"""),
    "rl": (["cl"], """SELECT doc_id, citation, c, sub_ord, hit, category, condition_logic, coefficient::DOUBLE AS coefficient FROM cl JOIN (VALUES
        (0, 0, 0, 'enclosure', '', 0.5), (0, 1, 0, 'enclosure', '', 1.0), (1, 0, 0, 'height', 'h >= 2.20', 1.0), (1, 1, 0, 'height', 'h < 2.20', 0.5),
        (2, 0, 0, 'special_use', '', 0.0), (3, 0, 0, 'special_use', '', 1.0), (4, 0, 0, 'height', 'h >= 2.2', 1.0), (5, 0, 0, 'height', 'h >= 2.20', 1.0),
        (5, 1, 0, 'height', 'h >= 1.20 and h < 2.10', 0.5), (6, 0, 0, 'height', 'h > 4.50', 0.0), (7, 0, 0, 'special_use', 'h > 3.5', 0.0),
        (7, 0, 1, 'special_use', 'h <= 1.2', 0.0)) v(variant, sub_ord, hit, category, condition_logic, coefficient) ON v.variant = doc_id % 8 WHERE c = 2
        UNION ALL SELECT doc_id, citation, c, 0, 0, 'height', 'h < 2.' || (doc_id % 5), 0.5 FROM cl WHERE c = 1
        UNION ALL SELECT doc_id, citation, c, 1, 0, 'height', 'h >= 2.' || (doc_id % 5), 1.0 FROM cl WHERE c = 1"""),
    "sub": (["cl"], r"""SELECT doc_id, citation, c, unnest(p) AS sub, generate_subscripts(p, 1) - 1 AS sub_ord FROM (
        SELECT *, list_filter(list_transform(regexp_split_to_array(rtrim(body, '.'), '[;；。]'), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM cl)"""),
})

ORACLES = {
    "report_json": with_ctes("""SELECT r.model_id, r.storey_id, to_json({'total_area': total_area, 'regulation_applied': regulation_applied, 'summary_text': summary_text,
            'story': {'story_name': story_name, 'elevation': elevation, 'height': height, 'base_area': base_area, 'height_coefficient': height_coefficient,
            'adjustments_area': adjustments_area, 'adjustment_details': coalesce(notes, []), 'calculated_area': calculated_area, 'area_full': area_full,
            'area_half': area_half, 'area_excluded': area_excluded, 'outline_polygon': NULL, 'components': items}})::VARCHAR AS json
        FROM p_rep r JOIN p_tot t ON t.model_id = r.model_id JOIN (SELECT model_id, storey_id, list({'category': category, 'raw_area': raw_area::DOUBLE, 'coefficient': coefficient::DOUBLE,
            'effective_area': effective_area::DOUBLE, 'note': note} ORDER BY ord) AS items FROM p_comp GROUP BY 1, 2) c ON c.model_id = r.model_id AND c.storey_id = r.storey_id
        LEFT JOIN (SELECT model_id, storey_id, list(detail ORDER BY ord) FILTER (detail IS NOT NULL) AS notes FROM p_parts GROUP BY 1, 2) d
            ON d.model_id = r.model_id AND d.storey_id = r.storey_id""", "p_rep", "p_tot", "p_comp", "p_parts"),
    "floor_area": with_ctes("SELECT f_rep.* EXCLUDE (exact_area), outline_polygon FROM f_rep LEFT JOIN q_text USING (model_id, storey_id)", "f_rep", "q_text"),
    "height_coef": with_ctes(f"SELECT model_id, storey_id, {rnd('height', 4)} AS height, k AS height_coef FROM allk", "allk", extra={
        "allk": (["storeys", "models", "rules"], """SELECT s.model_id, storey_id, height, CASE WHEN height >= 2.2::DOUBLE THEN 1.0 WHEN height < 1.2::DOUBLE THEN 0.0 ELSE 0.5 END AS k FROM storeys s""")}),
    "balcony_coef": with_ctes("""SELECT model_id, region, CASE WHEN r_regionkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS balcony_coef FROM models JOIN region ON r_name = region""", "models"),
    "special_rule": with_ctes("""SELECT a.model_id, a.guid, r.coefficient AS special_coef, r.description AS special_description FROM alignment a JOIN models m USING (model_id)
        LEFT JOIN p_sp p ON p.region = m.region AND p.cat = upper(semantic_category)
        LEFT JOIN rules r ON r.region = p.region AND r.rule_ord = p.o AND r.category = 'special_use'""", "alignment", "models", "p_sp", "rules"),
    "story_components": with_ctes(f"SELECT model_id, storey_id, ord, arm, category, {rnd('raw_area', 4)} AS raw_area, coefficient, {rnd('effective_area', 4)} AS effective_area, note FROM p_comp", "p_comp"),
    "story_adjustments": with_ctes(f"SELECT model_id, storey_id, ord, {rnd('adj', 4)} AS adjustment, detail FROM p_parts", "p_parts"),
    "area_buckets": with_ctes("SELECT model_id, storey_id, area_full, area_half, area_excluded FROM p_rep", "p_rep"),
    "residual_component": with_ctes(f"SELECT model_id, storey_id, category, {rnd('raw_area', 4)} AS raw_area, coefficient FROM p_comp WHERE ord = 0", "p_comp"),
    "model_total": with_ctes("SELECT * FROM p_tot", "p_tot"),
    "area_rollup": with_ctes(f"""SELECT model_id, storey_id, category, {rnd(esum('raw_area'), 2)} AS raw_area, {rnd(esum('effective_area'), 2)} AS effective_area FROM p_comp GROUP BY 1, 2, 3
        UNION ALL SELECT model_id, storey_id, NULL, {rnd(esum('raw_area'), 2)}, {rnd(esum('effective_area'), 2)} FROM p_comp GROUP BY 1, 2
        UNION ALL SELECT model_id, NULL, NULL, {rnd(esum('raw_area'), 2)}, {rnd(esum('effective_area'), 2)} FROM p_comp GROUP BY 1""", "p_comp"),
    "report_summary": with_ctes(f"""SELECT model_id, item, value FROM (
        SELECT t.model_id, unnest(['Region','Total Calculated Area (sq.m)','Total Full Area (100%)','Total Half Area (50%)','Total Excluded Area','Story Count','Note']) AS item,
        unnest([regulation_applied, total_area::VARCHAR, f::VARCHAR, h::VARCHAR, e::VARCHAR, story_count::VARCHAR, 'See ''Detailed Components'' sheet for full breakdown']) AS value
        FROM p_tot t JOIN (SELECT model_id, {rnd(esum('area_full'), 2)} AS f, {rnd(esum('area_half'), 2)} AS h, {rnd(esum('area_excluded'), 2)} AS e FROM p_rep GROUP BY 1) USING (model_id))""", "p_tot", "p_rep"),
    "report_stories": with_ctes("""SELECT r.model_id, r.storey_id, story_name, elevation, height, base_area, height_coefficient, adjustments_area, coalesce(d, '') AS adjustment_details,
        area_full, area_half, area_excluded, calculated_area FROM p_rep r LEFT JOIN (SELECT model_id, storey_id, string_agg(detail, '; ' ORDER BY ord) AS d FROM p_parts GROUP BY 1, 2) USING (model_id, storey_id)""", "p_rep", "p_parts"),
    "report_details": with_ctes("SELECT model_id, storey_id, ord, detail FROM p_parts WHERE detail IS NOT NULL", "p_parts"),
    "report_components": with_ctes(f"""SELECT c.model_id, c.storey_id, name AS story_name, c.ord, category, {rnd('raw_area', 2)} AS raw_area, coefficient, {rnd('effective_area', 2)} AS effective_area, note
        FROM p_comp c JOIN p_k USING (model_id, storey_id)""", "p_comp", "p_k"),
    "clause_split": with_ctes("SELECT doc_id, citation, body FROM cl", "cl"),
    "clause_category": with_ctes("""SELECT doc_id, citation, CASE WHEN c = 1 THEN 'height' ELSE (['enclosure','height','special_use','special_use','height','height','height','special_use'])[doc_id % 8 + 1] END AS category FROM cl""", "cl"),
    # The wording of the first clause is one sentence with two lengths; those of the second are listed by hand.
    "threshold_extract": with_ctes(r"""SELECT doc_id, citation, sub_ord, comparator, CAST(num AS DOUBLE) AS metres, 'h ' || comparator || ' ' || num AS condition_logic FROM (
        SELECT doc_id, citation, sub_ord, regexp_extract(sub, '(\d+(\.\d+)?) m', 1) AS num, CASE WHEN contains(sub, 'above') THEN '>=' ELSE '<' END AS comparator FROM sub WHERE c = 1
        UNION ALL SELECT doc_id, citation, s.sub_ord, num, comparator FROM sub s JOIN (VALUES (1, 0, '2.20', '>='), (1, 1, '2.20', '<'), (4, 0, '2.2', '>='), (5, 0, '2.20', '>='),
        (5, 1, '1.20', '>='), (5, 1, '2.10', '<'), (6, 0, '4.50', '>'), (7, 0, '3.5', '>'), (7, 0, '1.2', '<=')) v(variant, sub_ord, num, comparator)
        ON v.variant = doc_id % 8 AND v.sub_ord = s.sub_ord WHERE c = 2)""", "sub"),
    "rule_conditions": with_ctes("SELECT doc_id, citation, category, condition_logic, coefficient FROM rl", "rl"),
    "rule_set": with_ctes("""SELECT doc_id, coalesce(h, '') AS height_requirements, coalesce(e, '') AS enclosure_requirements, coalesce(s, '') AS special_space_requirements,
        nh || ' height, ' || ne || ' enclosure, ' || ns || ' special rules' AS reasoning_trace FROM (SELECT doc_id,
        string_agg(r, '; ' ORDER BY c, sub_ord, hit) FILTER (category = 'height') AS h, count(*) FILTER (category = 'height') AS nh,
        string_agg(r, '; ' ORDER BY c, sub_ord, hit) FILTER (category = 'enclosure') AS e, count(*) FILTER (category = 'enclosure') AS ne,
        string_agg(r, '; ' ORDER BY c, sub_ord, hit) FILTER (category = 'special_use') AS s, count(*) FILTER (category = 'special_use') AS ns
        FROM (SELECT *, citation || '|' || condition_logic || '|' || coefficient::VARCHAR AS r FROM rl) GROUP BY doc_id)""", "rl"),
    "coef_extract": with_ctes("""SELECT doc_id, citation, sub_ord, CASE WHEN contains(sub, 'excluded') OR contains(sub, '不应计算') THEN 0.0 WHEN contains(sub, '1/2') THEN 0.5 WHEN contains(sub, 'full') OR contains(sub, '全面积') OR contains(sub, '合并') THEN 1.0 END AS coefficient FROM sub""", "sub"),
}
