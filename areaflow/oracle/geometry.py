"""Independent SQL for polygons, outlines and curves: counting half-metre cells, no sweep."""

from areaflow.oracle.base import CTES, rnd, with_ctes

CTES.update({
    "cells": (["fp"], """SELECT DISTINCT model_id, storey_id, layer, cx, cy FROM fp, unnest(generate_series(gx, gx+gw-1)) t(cx), unnest(generate_series(gy, gy+gd-1)) u(cy)"""),
    "wr": (["fp"], "SELECT model_id, storey_id, poly_id, gx, gy, gw, gd FROM fp WHERE layer = 'wall'"),
})


def _half(v: str) -> str:
    """A number of half metres as text, without a trailing zero."""
    return f"(({v}) // 2) || CASE WHEN ({v}) % 2 = 1 THEN '.5' ELSE '' END"


def outline_ctes(p: str, rects: str) -> dict[str, tuple[list[str], str]]:
    """Enclosed outline of rectangles on the half-metre grid, by rectangle graphs and flood fill."""
    ox = "least(a.gx+a.gw, b.gx+b.gw) - greatest(a.gx, b.gx)"
    oy = "least(a.gy+a.gd, b.gy+b.gd) - greatest(a.gy, b.gy)"
    pair = "a.model_id = b.model_id AND a.storey_id = b.storey_id"
    edge = lambda c, d: f"SELECT 10*{c}-1 AS v, model_id, storey_id FROM {rects} UNION SELECT 10*({c}+{d})+1, model_id, storey_id FROM {rects}"
    return {
        f"{p}touch": ([rects], f"SELECT a.model_id, a.storey_id, a.poly_id AS u, b.poly_id AS v FROM {rects} a JOIN {rects} b ON {pair} AND {ox} >= 0 AND {oy} >= 0"),
        f"{p}reach": ([f"{p}touch"], f"SELECT model_id, storey_id, u, v FROM {p}touch UNION SELECT r.model_id, r.storey_id, r.u, t.v FROM {p}reach r JOIN {p}touch t ON t.u = r.v"),
        f"{p}grp": ([f"{p}reach"], f"SELECT model_id, storey_id, u AS poly_id, min(v) AS g FROM {p}reach GROUP BY 1, 2, 3"),
        f"{p}xs": ([rects], f"SELECT model_id, storey_id, v AS xa, lead(v) OVER (PARTITION BY model_id, storey_id ORDER BY v) AS xb FROM ({edge('gx', 'gw')})"),
        f"{p}ys": ([rects], f"SELECT model_id, storey_id, v AS ya, lead(v) OVER (PARTITION BY model_id, storey_id ORDER BY v) AS yb FROM ({edge('gy', 'gd')})"),
        f"{p}wide": ([f"{p}xs", f"{p}ys", f"{p}grp", rects], f"""SELECT model_id, storey_id, g, sum((xb-xa)*(yb-ya)) AS wide_area, min(xa*100000+ya) AS corner FROM (
            SELECT DISTINCT r.model_id, r.storey_id, g, xa, xb, ya, yb FROM {rects} r JOIN {p}grp q ON q.poly_id = r.poly_id AND q.storey_id = r.storey_id
            JOIN {p}xs x ON x.model_id = r.model_id AND x.storey_id = r.storey_id AND xa >= 10*gx-1 AND xb <= 10*(gx+gw)+1
            JOIN {p}ys y ON y.model_id = r.model_id AND y.storey_id = r.storey_id AND ya >= 10*gy-1 AND yb <= 10*(gy+gd)+1) GROUP BY 1, 2, 3"""),
        f"{p}main": ([f"{p}wide", f"{p}grp", rects], f"""SELECT r.* FROM {rects} r JOIN {p}grp q ON q.poly_id = r.poly_id AND q.storey_id = r.storey_id JOIN (
            SELECT model_id, storey_id, arg_min(g, (-wide_area, corner)) AS g FROM {p}wide GROUP BY 1, 2) m ON m.model_id = r.model_id AND m.storey_id = r.storey_id AND m.g = q.g"""),
        f"{p}side": ([f"{p}main"], f"SELECT a.model_id, a.storey_id, a.poly_id AS u, b.poly_id AS v FROM {p}main a JOIN {p}main b ON {pair} AND {ox} >= 0 AND {oy} >= 0 AND ({ox} > 0 OR {oy} > 0)"),
        f"{p}sreach": ([f"{p}side"], f"SELECT model_id, storey_id, u, v FROM {p}side UNION SELECT r.model_id, r.storey_id, r.u, t.v FROM {p}sreach r JOIN {p}side t ON t.u = r.v"),
        f"{p}part": ([f"{p}sreach", f"{p}main"], f"""SELECT DISTINCT model_id, storey_id, part, cx, cy FROM (SELECT m.*, part FROM {p}main m JOIN (
            SELECT storey_id, u AS poly_id, min(v) AS part FROM {p}sreach GROUP BY 1, 2) s ON s.poly_id = m.poly_id AND s.storey_id = m.storey_id), unnest(generate_series(gx, gx+gw-1)) t(cx), unnest(generate_series(gy, gy+gd-1)) u(cy)"""),
        f"{p}pa": ([f"{p}part"], f"SELECT model_id, storey_id, part, count(*)/4.0::DOUBLE AS area, min(cx*100000+cy) AS corner, min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM {p}part GROUP BY 1, 2, 3"),
        f"{p}kept": ([f"{p}pa"], f"""SELECT * FROM (SELECT *, max(area) OVER w AS top, row_number() OVER (PARTITION BY model_id, storey_id ORDER BY area DESC, corner) AS k
            FROM {p}pa WINDOW w AS (PARTITION BY model_id, storey_id)) WHERE CASE WHEN top > 2 THEN area > 2 AND area > 0.1*top ELSE k = 1 END"""),
        f"{p}empty": ([f"{p}kept", f"{p}part"], f"""SELECT k.model_id, k.storey_id, k.part, cx, cy FROM {p}kept k, unnest(generate_series(x0-1, x1+1)) t(cx), unnest(generate_series(y0-1, y1+1)) u(cy)
            WHERE NOT EXISTS (SELECT 1 FROM {p}part c WHERE c.storey_id = k.storey_id AND c.part = k.part AND c.cx = t.cx AND c.cy = u.cy)"""),
        f"{p}flood": ([f"{p}empty", f"{p}kept"], f"""SELECT model_id, storey_id, part, x0-1 AS cx, y0-1 AS cy FROM {p}kept
            UNION SELECT e.model_id, e.storey_id, e.part, e.cx, e.cy FROM {p}flood f JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) d(dx, dy) ON true
            JOIN {p}empty e ON e.storey_id = f.storey_id AND e.part = f.part AND e.cx = f.cx + dx AND e.cy = f.cy + dy"""),
        f"{p}fill": ([f"{p}flood", f"{p}empty", f"{p}part", f"{p}kept"], f"""SELECT DISTINCT model_id, storey_id, cx, cy FROM (
            SELECT c.model_id, c.storey_id, cx, cy FROM {p}part c JOIN {p}kept k USING (model_id, storey_id, part)
            UNION ALL SELECT e.model_id, e.storey_id, e.cx, e.cy FROM {p}empty e WHERE NOT EXISTS (SELECT 1 FROM {p}flood f WHERE f.storey_id = e.storey_id AND f.part = e.part AND f.cx = e.cx AND f.cy = e.cy))"""),
        f"{p}rim": ([f"{p}fill"], f"""SELECT c.model_id, c.storey_id, c.cx + CASE WHEN dx = 1 THEN 1 ELSE 0 END AS ax, c.cy + CASE WHEN dy = 1 THEN 1 ELSE 0 END AS ay,
            CASE WHEN dx = 0 THEN 1 ELSE 0 END AS lx, CASE WHEN dy = 0 THEN 1 ELSE 0 END AS ly FROM {p}fill c JOIN (VALUES (1,0),(-1,0),(0,1),(0,-1)) d(dx, dy) ON true
            WHERE NOT EXISTS (SELECT 1 FROM {p}fill n WHERE n.storey_id = c.storey_id AND n.cx = c.cx + dx AND n.cy = c.cy + dy)"""),
        # Unit border edges with the region on their left (d: 0 east, 1 north, 2 west, 3 south), walked from lower-left corners.
        f"{p}dir": ([f"{p}fill"], f"""SELECT c.model_id, c.storey_id, cx + fx AS x, cy + fy AS y, cx + tx AS x2, cy + ty AS y2, d FROM {p}fill c
            JOIN (VALUES (0,0,-1,0,0,1,0),(1,1,0,1,0,1,1),(2,0,1,1,1,0,1),(3,-1,0,0,1,0,0)) v(d, dx, dy, fx, fy, tx, ty) ON true
            WHERE NOT EXISTS (SELECT 1 FROM {p}fill n WHERE n.storey_id = c.storey_id AND n.cx = c.cx + dx AND n.cy = c.cy + dy)"""),
        f"{p}next": ([f"{p}dir"], f"""SELECT a.storey_id, a.x2 AS x, a.y2 AS y, a.d, arg_min(b.d, (a.d - b.d + 5) % 4) AS d2 FROM {p}dir a JOIN {p}dir b ON a.storey_id = b.storey_id AND a.x2 = b.x AND a.y2 = b.y GROUP BY 1, 2, 3, 4"""),
        f"{p}walk": ([f"{p}dir", f"{p}next"], f"""SELECT s.model_id, s.storey_id, s.x AS sx, s.y AS sy, s.x2 AS x, s.y2 AS y, 0 AS d, 1 AS step FROM {p}dir s
                JOIN {p}dir w ON w.storey_id = s.storey_id AND w.d = 3 AND w.x2 = s.x AND w.y2 = s.y WHERE s.d = 0
            UNION ALL SELECT w.model_id, w.storey_id, sx, sy, w.x + (d2 = 0)::INT - (d2 = 2)::INT, w.y + (d2 = 1)::INT - (d2 = 3)::INT, d2, step + 1
            FROM {p}walk w JOIN {p}next n ON n.storey_id = w.storey_id AND n.x = w.x AND n.y = w.y AND n.d = w.d WHERE (w.x, w.y) > (sx, sy)"""),
        f"{p}text": ([f"{p}walk", f"{p}next"], f"""SELECT model_id, storey_id, CASE WHEN count(*) = 1 THEN 'POLYGON ' || min(ring) ELSE 'MULTIPOLYGON (' || string_agg(ring, ', ' ORDER BY sx, sy) || ')' END AS outline_polygon FROM (
            SELECT w.model_id, w.storey_id, sx, sy, '((' || {_half('sx')} || ' ' || {_half('sy')} || ', ' || string_agg({_half('w.x')} || ' ' || {_half('w.y')}, ', ' ORDER BY step)
                FILTER (w.d <> d2 OR (w.x = sx AND w.y = sy)) || '))' AS ring FROM {p}walk w JOIN {p}next n ON n.storey_id = w.storey_id AND n.x = w.x AND n.y = w.y AND n.d = w.d
            GROUP BY 1, 2, 3, 4 HAVING bool_or(w.x = sx AND w.y = sy)) GROUP BY 1, 2"""),
    }


CTES.update(outline_ctes("o_", "wr"))

_K16 = "8*0.0025*sin(2*pi()/16)"
_STRIP = "(SELECT model_id, express_id, gx*0.5::DOUBLE AS sx, gy*0.5::DOUBLE AS sy, (gx+gw)*0.5::DOUBLE AS ex, (gy+gd)*0.5::DOUBLE AS ey, -gd/sqrt(gw*gw+gd*gd) AS nx, gw/sqrt(gw*gw+gd*gd) AS ny FROM base WHERE ifc_type = 'IfcWall')"


def _strip_columns() -> str:
    both = [("sx+nx*0.1", "sy+ny*0.1"), ("sx-nx*0.1", "sy-ny*0.1"), ("ex-nx*0.1", "ey-ny*0.1"), ("ex+nx*0.1", "ey+ny*0.1")]
    out = [("sx", "sy"), ("sx+nx*0.2", "sy+ny*0.2"), ("ex+nx*0.2", "ey+ny*0.2"), ("ex", "ey")]
    return ", ".join(f"{rnd(v, 5)} AS {c}{a}{i}" for c, pts in (("b", both), ("o", out)) for i, p in enumerate(pts) for a, v in zip("xy", p))


def _fold(test: str, source: str = "wall_curves") -> dict[str, tuple[list[str], str]]:
    return {
        "pts": ([source], f"SELECT *, row_number() OVER (PARTITION BY wall_id ORDER BY pt_ord) AS rn, count(*) OVER (PARTITION BY wall_id) AS n FROM {source}"),
        "run": (["pts"], f"""SELECT wall_id, rn, x AS lx, y AS ly, true AS keep FROM pts WHERE rn = 1
            UNION ALL SELECT p.wall_id, p.rn, CASE WHEN {test} THEN p.x ELSE lx END, CASE WHEN {test} THEN p.y ELSE ly END, {test} FROM run r JOIN pts p ON p.wall_id = r.wall_id AND p.rn = r.rn + 1"""),
        "kept": (["pts", "run"], "SELECT p.*, count(*) OVER (PARTITION BY p.wall_id) AS kn FROM pts p JOIN run r ON r.wall_id = p.wall_id AND r.rn = p.rn WHERE keep"),
    }


_DIST = "sqrt((p.x-lx)**2 + (p.y-ly)**2)"
_XY = f"{rnd('x', 5)} AS x, {rnd('y', 5)} AS y"

ORACLES = {
    "convex_hull": with_ctes(f"""SELECT model_id, storey_id, count(*) AS n_points, {rnd('sum(ax*by_ - bx*ay)/8.0::DOUBLE', 4)} AS area FROM (
        SELECT a.model_id, a.storey_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pt a JOIN pt b ON a.storey_id = b.storey_id AND a.model_id = b.model_id AND (a.x, a.y) <> (b.x, b.y)
        WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.storey_id = a.storey_id AND ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) < 0
          OR ((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x) = 0 AND (c.x-a.x)*(c.x-b.x) + (c.y-a.y)*(c.y-b.y) > 0)))) GROUP BY 1, 2""", "pt", extra={
        "pt": (["wr"], "SELECT DISTINCT model_id, storey_id, gx + dx*gw AS x, gy + dy*gd AS y FROM wr, (VALUES (0,0),(1,0),(0,1),(1,1)) d(dx, dy)")}),
    "ring_measures": with_ctes("SELECT model_id, poly_id, gw*gd/4.0::DOUBLE AS area, gw + gd::DOUBLE AS length FROM fp", "fp"),
    "point_in_polygon": with_ctes("""SELECT b.model_id, b.home_storey AS storey_id, b.express_id, f.poly_id FROM base b JOIN fp f ON f.layer = 'slab' AND f.storey_id = b.home_storey
        AND (4*b.gx+2*b.gw+1)/4.0 > f.gx AND (4*b.gx+2*b.gw+1)/4.0 < f.gx+f.gw AND (4*b.gy+2*b.gd+1)/4.0 > f.gy AND (4*b.gy+2*b.gd+1)/4.0 < f.gy+f.gd""", "base", "fp"),
    "sample_grid": with_ctes("""SELECT model_id, poly_id, ix/2.0::DOUBLE AS px, iy/2.0::DOUBLE AS py FROM fp, unnest(generate_series(gx+1, gx+gw-1)) t(ix), unnest(generate_series(gy+1, gy+gd-1)) u(iy) WHERE layer = 'slab'""", "fp"),
    "buffer_area": with_ctes(f"SELECT model_id, poly_id, {rnd(f'gw*gd/4.0::DOUBLE + (gw+gd)*0.05::DOUBLE + {_K16}', 5)} AS area FROM wr", "wr"),
    "wall_strip": with_ctes(f"SELECT model_id, express_id, {_strip_columns()} FROM {_STRIP}", "base"),
    "validate_outline": with_ctes(f"""SELECT model_id, poly_id, {rnd('a', 6)} AS area, {rnd('l', 6)} AS length, reason IS NULL AS valid, reason FROM (
        SELECT *, CASE WHEN kind = 1 THEN 'crosses itself' WHEN kind = 2 THEN 'touches itself' WHEN kind = 3 THEN 'spike' WHEN a < 0.1 THEN 'area' WHEN l < 1.0 THEN 'length' END AS reason FROM (
        SELECT model_id, poly_id, kind, w*d * CASE kind WHEN 1 THEN 0.125 WHEN 2 THEN 0.5 ELSE 1.0 END AS a, CASE kind WHEN 1 THEN sqrt(w*w + d*d) + d + sqrt(w*w + 0.5625*d*d) + 0.75*d
            WHEN 2 THEN 2*w + 2*sqrt(w*w + d*d) WHEN 3 THEN 2*w + 2*d + 1 ELSE 2*w + 2*d END AS l
        FROM (SELECT model_id, poly_id, poly_id % 6 AS kind, gw/16.0::DOUBLE AS w, gd/16.0::DOUBLE AS d FROM fp)))""", "fp"),
    "simplified_ring": with_ctes(f"""SELECT model_id, poly_id, 'POLYGON ((' || {_half('gx')} || ' ' || {_half('gy')} || ', ' || {_half('gx+gw')} || ' ' || {_half('gy')} || ', '
        || {_half('gx+gw')} || ' ' || {_half('gy+gd')} || ', ' || {_half('gx')} || ' ' || {_half('gy+gd')} || ', ' || {_half('gx')} || ' ' || {_half('gy')} || '))' AS ring_text
        FROM fp WHERE layer = 'slab'""", "fp"),
    "degenerate_filter": with_ctes("SELECT model_id, poly_id FROM fp WHERE poly_id % 7 <> 0 AND poly_id % 5 <> 0 AND poly_id % 11 <> 0", "fp"),
    "sliver_filter": with_ctes("""SELECT model_id, storey_id, part, area FROM (SELECT model_id, storey_id, poly_id AS part, gw*gd/4.0::DOUBLE AS area, max(gw*gd/4.0::DOUBLE) OVER w AS top,
        row_number() OVER (PARTITION BY model_id, storey_id ORDER BY gw*gd DESC, poly_id DESC) AS k FROM fp WINDOW w AS (PARTITION BY model_id, storey_id))
        WHERE CASE WHEN top > 2 THEN area > 2 AND area > 0.1*top ELSE k = 1 END""", "fp"),
    "largest_part": with_ctes("""SELECT model_id, storey_id, part, area FROM (SELECT model_id, storey_id, poly_id AS part, gw*gd/4.0::DOUBLE AS area,
        row_number() OVER (PARTITION BY model_id, storey_id ORDER BY gw*gd DESC, poly_id DESC) AS k FROM fp) WHERE k = 1""", "fp"),
    "slab_union_area": with_ctes("SELECT model_id, storey_id, count(*)/4.0::DOUBLE AS area FROM cells WHERE layer = 'slab' GROUP BY 1, 2", "cells"),
    "outside_area": with_ctes("""SELECT model_id, storey_id, count(*) FILTER (a)/4.0::DOUBLE AS area_a, count(*) FILTER (b)/4.0::DOUBLE AS area_b, count(*)/4.0::DOUBLE AS area_union,
        count(*) FILTER (a AND b)/4.0::DOUBLE AS area_both, count(*) FILTER (a AND NOT b)/4.0::DOUBLE AS area_a_only FROM (
        SELECT model_id, storey_id, cx, cy, bool_or(layer = 'slab') AS a, bool_or(layer = 'wall') AS b FROM cells GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""", "cells"),
    "enclosed_outline": with_ctes("""SELECT f.model_id, f.storey_id, area, perimeter, outline_polygon FROM (SELECT model_id, storey_id, count(*)/4.0::DOUBLE AS area FROM o_fill GROUP BY 1, 2) f
        JOIN (SELECT model_id, storey_id, count(*)/2.0::DOUBLE AS perimeter FROM o_rim GROUP BY 1, 2) r USING (model_id, storey_id)
        JOIN o_text USING (model_id, storey_id)""", "o_fill", "o_rim", "o_text"),
    "external_walls": with_ctes(f"""SELECT w.model_id, w.storey_id, w.poly_id, {rnd('count(ax)/2.0::DOUBLE/(gw+gd)', 4)} AS ratio, count(ax)/2.0::DOUBLE/(gw+gd) > 0.1 AS is_external
        FROM wr w LEFT JOIN o_rim r ON r.model_id = w.model_id AND r.storey_id = w.storey_id AND ax >= gx AND ax + lx <= gx+gw AND ay >= gy AND ay + ly <= gy+gd GROUP BY w.model_id, w.storey_id, w.poly_id, gw, gd""", "wr", "o_rim"),
    "wall_thickness": with_ctes(f"""SELECT model_id, {rnd("coalesce(list_sort(list(least(x1-x0, y1-y0)) FILTER (m.express_id IS NOT NULL))[count(m.express_id)//2 + 1], 0.2)", 4)} AS thickness
        FROM models LEFT JOIN (SELECT * FROM mesh WHERE ifc_type = 'IfcWall') m USING (model_id) GROUP BY 1""", "models", "mesh"),
    "building_centroid": with_ctes(f"""SELECT model_id, {rnd('coalesce(avg((2*gx+gw)/4.0::DOUBLE), 0.0)', 4)} AS cx, {rnd('coalesce(avg((2*gy+gd)/4.0::DOUBLE), 0.0)', 4)} AS cy
        FROM models LEFT JOIN (SELECT * FROM base WHERE ifc_type = 'IfcWall') b USING (model_id) GROUP BY 1""", "models", "base"),
    "curve_thin": with_ctes(f"SELECT wall_id, pt_ord, {_XY} FROM kept UNION ALL SELECT wall_id, pt_ord, {_XY} FROM pts WHERE rn = n AND n > 1 AND wall_id IN (SELECT wall_id FROM kept WHERE kn = 1)",
                            "kept", extra=_fold(f"{_DIST} > 2.0")),
    "curve_guard": with_ctes(f"SELECT wall_id, pt_ord, {_XY} FROM kept WHERE kn >= 3", "kept", extra=_fold(f"{_DIST} < 1.0")),
    "curve_smooth": with_ctes(f"""SELECT wall_id, pt_ord, CASE WHEN n <= 3 OR px IS NULL OR nx IS NULL THEN {rnd('x', 5)} ELSE {rnd('(px+x+nx)/3.0', 5)} END AS x,
        CASE WHEN n <= 3 OR px IS NULL OR nx IS NULL THEN {rnd('y', 5)} ELSE {rnd('(py+y+ny)/3.0', 5)} END AS y FROM (
        SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM (
          SELECT *, lag(x) OVER w AS qx, lag(y) OVER w AS qy, lead(x) OVER w AS mx, lead(y) OVER w AS my FROM (
            SELECT wall_id, pt_ord, x/4 AS x, y, count(*) OVER (PARTITION BY wall_id) AS n FROM wall_curves) WINDOW w AS (PARTITION BY wall_id ORDER BY pt_ord))
        WHERE n <= 3 OR qx IS NULL OR mx IS NULL OR (sqrt((x-qx)**2+(y-qy)**2) < 2.0 AND sqrt((x-mx)**2+(y-my)**2) < 2.0) WINDOW w AS (PARTITION BY wall_id ORDER BY pt_ord))""", "wall_curves"),
    "curve_offset": with_ctes(f"""SELECT wall_id, CASE WHEN s = 1 THEN rn ELSE 2*n + 1 - rn END AS ring_ord, {rnd('x + s*nx*0.1', 5)} AS x, {rnd('y + s*ny*0.1', 5)} AS y FROM (
        SELECT *, CASE WHEN sqrt(hx*hx+hy*hy) > 0 THEN -hy/sqrt(hx*hx+hy*hy) ELSE 0 END AS nx, CASE WHEN sqrt(hx*hx+hy*hy) > 0 THEN hx/sqrt(hx*hx+hy*hy) ELSE 1 END AS ny FROM (
        SELECT *, CASE WHEN rn = 1 THEN bx - x WHEN rn = n THEN x - ax ELSE ((x - ax) + (bx - x))/2.0 END AS hx, CASE WHEN rn = 1 THEN by_ - y WHEN rn = n THEN y - ay ELSE ((y - ay) + (by_ - y))/2.0 END AS hy FROM (
        SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_, row_number() OVER w AS rn, count(*) OVER (PARTITION BY wall_id) AS n
        FROM wall_curves WINDOW w AS (PARTITION BY wall_id ORDER BY pt_ord)) WHERE n >= 2)), (VALUES (1), (-1)) v(s)""", "wall_curves"),
}
