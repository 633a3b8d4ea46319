"""Queries over edges, costs, routes and speed training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.functions import speed as V
from fellwalk.operators import density as D
from fellwalk.operators import routing as O
from fellwalk.operators.spatial import elevation_lookup
from fellwalk.plans import sqltext as Q
from fellwalk.plans.density import DENS, cells, index_sql
from fellwalk.plans.geo import HOME, WAY_POINTS_SQL, dem_pixels, supplier_points, SUPPLIER_POINTS
from fellwalk.plans.registry import query
from fellwalk.plans.trails import TRAILS_SQL, trails

EDGES_SQL = f"""(SELECT src, dst, way_id, min(len) AS length_m FROM (
  SELECT CASE WHEN r = 0 THEN prev ELSE node_id END AS src, CASE WHEN r = 0 THEN node_id ELSE prev END AS dst, way_id, {Q.hav('px', 'py', 'lng', 'lat')} AS len
  FROM (SELECT *, lag(node_id) OVER w AS prev, lag(lng) OVER w AS px, lag(lat) OVER w AS py FROM {WAY_POINTS_SQL} WINDOW w AS (PARTITION BY way_id ORDER BY seq)), (VALUES (0), (1)) AS d(r)
  WHERE prev IS NOT NULL AND prev <> node_id) GROUP BY 1, 2, 3)"""
# edges with trail attributes and slope s
TABLE_SQL = f"""(SELECT e.*, t.* EXCLUDE (way_id), a.ele AS ele_a, b.ele AS ele_b, greatest(-1e0, least(1e0, (b.ele - a.ele) / length_m)) AS s
  FROM {EDGES_SQL} e JOIN {TRAILS_SQL} t ON t.way_id = e.way_id JOIN v_nodes a ON a.node_id = src JOIN v_nodes b ON b.node_id = dst)"""
# the same with no slope on edges between nodes at one position, as in V.slope
LEVEL_TABLE_SQL = f"(SELECT * REPLACE (CASE WHEN length_m > 0 THEN s ELSE 0e0 END AS s) FROM {TABLE_SQL})"
_TOB = "(6 * exp(-3.5 * abs(s + 5e-2)) / 3.6)"
FOOT_SQL = f"""({_TOB} * CASE WHEN kind = 'hidden' THEN 8.5e-1 WHEN kind = 'path' THEN 9.5e-1 ELSE 1e0 END * CASE WHEN difficulty >= 4 THEN 6e-1 WHEN difficulty >= 3 THEN 8e-1 ELSE 1e0 END
  * CASE WHEN surface_class = 'rock' THEN 8.5e-1 ELSE 1e0 END)"""
_BB = """(CASE surface_class WHEN 'paved' THEN 2.2e1 WHEN 'gravel' THEN 1.6e1 WHEN 'dirt' THEN 1.3e1 WHEN 'grass' THEN 9e0 WHEN 'rock' THEN 6e0 ELSE CASE kind WHEN 'road' THEN 1.8e1 WHEN 'track' THEN 1.3e1 ELSE 9e0 END END
  * CASE mtb_scale WHEN 0 THEN 1e0 WHEN 1 THEN 8.5e-1 WHEN 2 THEN 6.5e-1 WHEN 3 THEN 4.5e-1 WHEN 4 THEN 2.5e-1 WHEN 5 THEN 1.5e-1 WHEN 6 THEN 1e-1 ELSE 1e0 END)"""
BIKE_SQL = f"""(CASE WHEN difficulty >= 4 THEN 2 / 3.6e0 ELSE greatest(CASE WHEN s > 0 THEN {_BB} / (1 + 14 * s) WHEN s > -1.2e-1 THEN {_BB} * (1 - 3 * s) ELSE {_BB} * 7e-1 END / 3.6, {_TOB} * 7.5e-1) END)"""
MOTO_SQL = """(CASE WHEN abs(s) > 4.5e-1 THEN 0e0 ELSE CASE track_grade WHEN 1 THEN 35 WHEN 2 THEN 28 WHEN 3 THEN 20 WHEN 4 THEN 13 WHEN 5 THEN 8 ELSE
  CASE surface_class WHEN 'paved' THEN 50 WHEN 'gravel' THEN 35 WHEN 'dirt' THEN 25 WHEN 'grass' THEN 15 WHEN 'rock' THEN 10 ELSE CASE kind WHEN 'road' THEN 40 WHEN 'track' THEN 20 ELSE 0 END END END / (1 + 3 * abs(s)) / 3.6e0 END)"""


def table(d):
    return O.edge_table(O.build_edges(d.way_points), trails(d), d.nodes)


@query("build_edges", f"SELECT src, dst, way_id, round(length_m, 3) AS length_m FROM {EDGES_SQL}")
def _(d):
    return O.build_edges(d.way_points).select("src", "dst", "way_id", F.round("length_m", 3).alias("length_m"))


@query("edge_slope", f"SELECT src, dst, way_id, round(s, 6) AS slope FROM {LEVEL_TABLE_SQL}")
def _(d):
    return table(d).select("src", "dst", "way_id", F.round("slope", 6).alias("slope"))


@query("expert_speed", f"SELECT src, dst, way_id, round({FOOT_SQL}, 6) AS foot, round({BIKE_SQL}, 6) AS bike, round({MOTO_SQL}, 6) AS moto FROM {LEVEL_TABLE_SQL}")
def _(d):
    s = F.col("slope")
    return table(d).select("src", "dst", "way_id", *[F.round(V.expert_speed(F.lit(m), s), 6).alias(m) for m in ("foot", "bike", "moto")])


_CLS = {"path": "highway IN ('path', 'footway', 'bridleway')", "track": "highway = 'track'", "road": "highway NOT IN ('path', 'footway', 'bridleway', 'track', 'cycleway', 'steps')",
        "cycleway": "highway = 'cycleway'", "steps": "highway = 'steps'"}
_L = "greatest(-5e-1, least(5e-1, s))"
FEATURES_SQL = ([f"CASE WHEN {c} THEN 1e0 ELSE 0e0 END" for c in _CLS.values()] + [f"CASE WHEN surface_class = '{c}' THEN 1e0 ELSE 0e0 END" for c in ("paved", "gravel", "dirt", "grass", "rock", "unknown")]
                + ["track_grade / 5e0", "CASE WHEN track_grade > 0 THEN 1e0 ELSE 0e0 END", "difficulty / 6e0", "CASE WHEN mtb_scale >= 0 THEN (mtb_scale + 1) / 7e0 ELSE 0e0 END",
                   "CASE WHEN mtb_scale >= 0 THEN 1e0 ELSE 0e0 END", "CASE WHEN kind = 'marked' THEN 1e0 ELSE 0e0 END", f"{_L} * 4", f"{_L} * {_L} * 16", f"greatest(0e0, {_L}) * 4", f"greatest(0e0, -{_L}) * 4"])
NAMES = [f"x{i:02d}" for i in range(21)]


@query("route_features", f"SELECT src, dst, way_id, {', '.join(f'round({e}, 6) AS {n}' for e, n in zip(FEATURES_SQL, NAMES))} FROM {LEVEL_TABLE_SQL}")
def _(d):
    x = V.route_features(F.col("slope"))
    return table(d).withColumn("x", x).select("src", "dst", "way_id", *[F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(NAMES)])


# generated weights of the 21-12-1 correction (any weights table works)
W1 = [[((h * 7 + i * 3) % 11 - 5) / 20 for i in range(21)] for h in range(12)]
B1, W2, B2 = [(h % 5 - 2) / 10 for h in range(12)], [((h * 5) % 7 - 3) / 10 for h in range(12)], 0.05
_MLP = f"({B2:e} + " + " + ".join(f"({W2[h]:e}) * tanh({B1[h]:e} + " + " + ".join(f"({W1[h][i]:e}) * {NAMES[i]}" for i in range(21)) + ")" for h in range(12)) + ")"


def weights():
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return F.struct(F.array(*[arr(r) for r in W1]).alias("w1"), arr(B1).alias("b1"), arr(W2).alias("w2"), F.lit(B2).alias("b2"))


@query("learned_speed", f"""SELECT src, dst, way_id, round(v * exp(greatest(-1.2e0, least(7e-1, {_MLP}))), 6) AS speed
FROM (SELECT src, dst, way_id, {FOOT_SQL} AS v, {', '.join(f'{e} AS {n}' for e, n in zip(FEATURES_SQL, NAMES))} FROM {LEVEL_TABLE_SQL})""")
def _(d):
    s = F.col("slope")
    return table(d).select("src", "dst", "way_id", F.round(V.learned_speed(V.expert_speed(F.lit("foot"), s), V.route_features(s), weights()), 6).alias("speed"))


@query("edge_time", f"SELECT src, dst, way_id, round(length_m / v, 3) AS time_s FROM (SELECT *, {MOTO_SQL} AS v FROM {LEVEL_TABLE_SQL}) WHERE v > 0 AND access_moto <> 'no'")
def _(d):
    out = O.edge_costs(table(d), V.prefs(mode="moto"))
    return out.select("src", "dst", "way_id", F.round("time_s", 3).alias("time_s"))


@query("allowed", f"""SELECT way_id, access_foot = 'yes' AND difficulty <= 2 AS foot, access_bike <> 'no' AND mtb_scale <= 3 AS bike, access_moto = 'yes' AS moto FROM {TRAILS_SQL}""")
def _(d):
    p = {"foot": V.prefs(strict_access=True, max_difficulty=2), "bike": V.prefs(mode="bike"), "moto": V.prefs(mode="moto", strict_access=True)}
    return trails(d).select("way_id", *[V.allowed(v).alias(k) for k, v in p.items()])


PENALTY_SQL = f"""(SELECT way_id, greatest(0e0, least(1.2e0, log10(greatest(avg(dens), 3e-3) / 3e-3) / 2)) AS pen FROM (
  SELECT p.way_id, p.k, sum(w * coalesce(c.density, 0e0)) / sum(w) AS dens FROM (
    SELECT way_id, k, cx, cy, exp(-(pow((cx + 5e-1 - fx) * kmx, 2) + pow((cy + 5e-1 - fy) * 2.2264e-1, 2)) / 4.5e-2) AS w FROM (
     SELECT *, unnest(range(CAST(floor(fx - 4.5e-1 / kmx) AS BIGINT), CAST(floor(fx + 4.5e-1 / kmx) AS BIGINT) + 1)) AS cx FROM (
      SELECT *, unnest(range(CAST(floor(fy - 4.5e-1 / 2.2264e-1) AS BIGINT), CAST(floor(fy + 4.5e-1 / 2.2264e-1) AS BIGINT) + 1)) AS cy FROM (
       SELECT v.way_id, k, (lng - 2.499e1) / 2e-3 AS fx, (4.502e1 - lat) / 2e-3 AS fy, 2e-3 * 1.1132e2 * cos(radians(lat)) AS kmx FROM {WAY_POINTS_SQL} v
        JOIN (SELECT way_id, k, CAST(floor(k * n / 4e0) AS INT) AS seq FROM (SELECT way_id, count(*) AS n FROM v_way_vertices GROUP BY way_id), (VALUES (1), (2), (3)) AS q(k)) s ON s.way_id = v.way_id AND s.seq = v.seq)))) p
  LEFT JOIN {DENS} c ON c.cx = p.cx AND c.cy = p.cy GROUP BY p.way_id, p.k) GROUP BY way_id)"""
LOCAL_GRID = D.Grid(24.99, 45.02, 0.002)


@query("wildlife_penalty", f"SELECT way_id, round(pen, 6) AS wildlife_penalty FROM {PENALTY_SQL}")
def _(d):
    out = O.wildlife_penalty(d.way_points, cells(d), LOCAL_GRID)
    return out.select("way_id", F.round("wildlife_penalty", 6).alias("wildlife_penalty"))


_BIKE_COST = f"""CASE WHEN access_bike = 'unknown' AND highway IN ('tertiary', 'unclassified', 'residential') THEN 1.1e0 ELSE 1e0 END * (1 + 5 * car_traffic) * (1 - 4e-1 * 5e-1 * hidden_score)
  * CASE WHEN surface_class = 'paved' THEN 1 + 8e-1 * 7e-1 ELSE 1e0 END"""


@query("preference_cost", f"""SELECT src, dst, t.way_id, round(length_m / v * {_BIKE_COST} * (1 + 5e-1 * coalesce(pen, 0e0)), 3) AS cost
FROM (SELECT *, {BIKE_SQL} AS v FROM {TABLE_SQL}) t LEFT JOIN {PENALTY_SQL} p ON p.way_id = t.way_id WHERE access_bike <> 'no' AND mtb_scale <= 3""")
def _(d):
    t = table(d).join(O.wildlife_penalty(d.way_points, cells(d), LOCAL_GRID), "way_id", "left")
    return O.edge_costs(t, V.prefs(mode="bike", hidden=0.5, offroad=0.7)).select("src", "dst", "way_id", F.round("cost", 3).alias("cost"))


REQ_SQL = """(SELECT s_suppkey AS req, 2.5e1 + (s_suppkey * 7919 % 20000) / 1e6 + 3e-5 AS fx, 4.5e1 + (s_suppkey * 104729 % 15000) / 1e6 + 2e-5 AS fy,
  2.5e1 + (s_suppkey * 5081 % 20000) / 1e6 AS tx, 4.5e1 + (s_suppkey * 3559 % 15000) / 1e6 + CASE WHEN s_suppkey % 10 = 0 THEN 1e-1 ELSE 0e0 END AS ty FROM supplier)"""


def requests(d):
    k = F.col("s_suppkey")
    return d.table("supplier").select(k.alias("req"), (25.0 + (k * 7919 % 20000) / 1e6 + 3e-5).alias("from_lng"), (45.0 + (k * 104729 % 15000) / 1e6 + 2e-5).alias("from_lat"),
                                      (25.0 + (k * 5081 % 20000) / 1e6).alias("to_lng"), (45.0 + (k * 3559 % 15000) / 1e6 + F.when(k % 10 == 0, 0.1).otherwise(0.0)).alias("to_lat"))


def snap_sql(req):
    """Ends of requests(req, fx, fy, tx, ty) at their nearest nodes within 500 m."""
    near = lambda x, y: f"(SELECT req, arg_min(node_id, (dist, node_id)) AS node, min(dist) AS dist FROM (SELECT req, node_id, {Q.hav(x, y, 'lng', 'lat')} AS dist FROM {req}, v_nodes WHERE node_id IN (SELECT src FROM {EDGES_SQL})) WHERE dist < 500 GROUP BY req)"
    return f"(SELECT a.req, a.node AS source, b.node AS target, a.dist AS snap_from, b.dist AS snap_to FROM {near('fx', 'fy')} a JOIN {near('tx', 'ty')} b ON a.req = b.req)"


SNAP_SQL = snap_sql(REQ_SQL)


def used_nodes(d):
    """The nodes that edges use."""
    used = O.build_edges(d.way_points).select(F.col("src").alias("node_id")).distinct()
    return d.nodes.join(used, "node_id", "left_semi")


def snapped(d):
    return O.snap_endpoints(requests(d), used_nodes(d))


@query("snap_endpoints", f"SELECT req, source, target, round(snap_from, 3) AS snap_from, round(snap_to, 3) AS snap_to FROM {SNAP_SQL}")
def _(d):
    return snapped(d).select("req", "source", "target", F.round("snap_from", 3).alias("snap_from"), F.round("snap_to", 3).alias("snap_to"))


def paths_cte(snap):
    """Least costs d from the sources of `snap`(req, source, target) over foot edges t."""
    return f"""WITH RECURSIVE t AS MATERIALIZED (SELECT *, length_m / v AS time_s, length_m / v * CASE WHEN access_foot = 'unknown' THEN 1.1e0 ELSE 1e0 END AS cost FROM (SELECT *, {FOOT_SQL} AS v FROM {TABLE_SQL}) WHERE access_foot <> 'no' AND difficulty <= 4 AND v > 0),
e AS MATERIALIZED (SELECT src, dst, min(cost) AS cost, arg_min(way_id, (cost, way_id)) AS way_id FROM t GROUP BY src, dst), r AS MATERIALIZED (SELECT * FROM {snap}),
d(source, node, dist, prev, way_id) USING KEY (source, node) AS (SELECT DISTINCT source, source, 0e0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM r
 UNION SELECT n.source, n.node, n.c, n.prev, n.way_id FROM (SELECT d.source, e.dst AS node, min(d.dist + e.cost) AS c, arg_min(e.src, (d.dist + e.cost, e.src)) AS prev, arg_min(e.way_id, (d.dist + e.cost, e.src)) AS way_id
  FROM d JOIN e ON e.src = d.node GROUP BY 1, 2) n LEFT JOIN recurring.d o ON o.source = n.source AND o.node = n.node WHERE o.dist IS NULL OR n.c < o.dist)"""


PATHS_CTE = paths_cte(SNAP_SQL)
SUMMARY_SQL = PATHS_CTE + """,
p(req, source, node, back) AS (SELECT req, source, target, 0 FROM r UNION ALL SELECT p.req, p.source, d.prev, back + 1 FROM p JOIN d ON d.source = p.source AND d.node = p.node WHERE d.prev IS NOT NULL),
w AS (SELECT p.req, -p.back AS seq, t.*, coalesce(ele_b - ele_a, 0e0) AS rise, lag(t.way_id) OVER (PARTITION BY p.req ORDER BY p.back DESC) AS before
 FROM p JOIN d ON d.source = p.source AND d.node = p.node JOIN t ON t.src = d.prev AND t.dst = d.node AND t.way_id = d.way_id)
SELECT req, string_agg(CASE WHEN before IS NULL OR before <> way_id THEN CAST(way_id AS STRING) END, ',' ORDER BY seq) AS way_ids, round(sum(length_m), 3) AS distance_m, round(sum(time_s), 3) AS duration_s,
 round(sum(greatest(rise, 0e0)), 3) AS ascent_m, round(sum(greatest(-rise, 0e0)), 3) AS descent_m,
 round(sum(CASE WHEN kind = 'detected' OR hidden_score >= 6e-1 THEN length_m ELSE 0e0 END) / sum(length_m), 3) AS hidden_share, round(sum(CASE WHEN surface_class <> 'paved' THEN length_m ELSE 0e0 END) / sum(length_m), 3) AS offroad_share,
 round(sum(CASE WHEN access_foot = 'unknown' THEN length_m ELSE 0e0 END) / sum(length_m), 3) AS unknown_share FROM w GROUP BY req"""


def _search(d):
    t = O.edge_costs(table(d), V.prefs())
    req = snapped(d)
    costs, tree = O.shortest_paths(req, t.select("src", "dst", "way_id", "cost"))
    return t, req, costs, tree


@query("shortest_paths", PATHS_CTE + " SELECT req, r.source, r.target, round(dist, 3) AS cost FROM r JOIN d ON d.source = r.source AND d.node = r.target")
def _(d):
    _, req, costs, _ = _search(d)
    return req.join(costs, "req").select("req", "source", "target", F.round("cost", 3).alias("cost"))


@query("route_summary", SUMMARY_SQL)
def _(d):
    t, req, _, tree = _search(d)
    rows = O.route_rows(O.backtrack(req, tree), t)
    out = O.route_summary(rows, F.lit("foot"))
    return out.select("req", "way_ids", *[F.round(c, 3).alias(c) for c in ("distance_m", "duration_s", "ascent_m", "descent_m", "hidden_share", "offroad_share", "unknown_share")])


@query("route_exposure", f"""
WITH v AS (SELECT trace_id, seq - 1 AS seq, lng, lat FROM v_trace_points),
p AS (SELECT trace_id, seq, (lng - 2.499e1) / 2e-3 AS fx, (4.502e1 - lat) / 2e-3 AS fy, 2e-3 * 1.1132e2 * cos(radians(lat)) AS kmx FROM v),
y AS (SELECT *, unnest(range(CAST(floor(fy - 9e-1 / 2.2264e-1) AS BIGINT), CAST(floor(fy + 9e-1 / 2.2264e-1) AS BIGINT) + 1)) AS cy FROM p),
x AS (SELECT *, unnest(range(CAST(floor(fx - 9e-1 / kmx) AS BIGINT), CAST(floor(fx + 9e-1 / kmx) AS BIGINT) + 1)) AS cx FROM y),
w AS (SELECT trace_id, seq, cx, cy, exp(-(pow((cx + 5e-1 - fx) * kmx, 2) + pow((cy + 5e-1 - fy) * 2.2264e-1, 2)) / 1.8e-1) AS w FROM x),
m AS (SELECT trace_id, w.seq, sum(w * coalesce(density, 0e0)) / sum(w) AS d FROM w LEFT JOIN {DENS} c ON c.cx = w.cx AND c.cy = w.cy GROUP BY 1, 2)
SELECT trace_id, round(avg(d), 6) AS density, {index_sql('(avg(d) * 1.25)')} AS index FROM m GROUP BY trace_id""")
def _(d):
    v = d.trace_points.withColumn("seq", F.col("seq") - 1)
    return O.route_exposure(v, "trace_id", cells(d), LOCAL_GRID, F.lit(1.25)).select("trace_id", F.round("density", 6).alias("density"), "index")


_TRACE_ELE = "(SELECT trace_id, seq - 1 AS seq, lng, lat, CASE WHEN accuracy % 3 <> 0 THEN 5e2 + accuracy END AS ele FROM v_trace_points)"
_FILLED = f"""(SELECT trace_id, seq, lng, lat, ele, coalesce(last_value(ele IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ele IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS f FROM {_TRACE_ELE})"""


def trace_heights(d):
    return d.trace_points.select("trace_id", (F.col("seq") - 1).alias("seq"), "lng", "lat", F.when(F.col("accuracy") % 3 != 0, 500.0 + F.col("accuracy")).alias("ele"))


@query("route_profile", f"""
WITH s AS (SELECT *, coalesce({Q.hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')}, 0e0) AS st FROM {_FILLED} WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
c AS (SELECT *, sum(st) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum, sum(st) OVER (PARTITION BY trace_id) AS len, count(ele) OVER (PARTITION BY trace_id) AS known, min(f) OVER (PARTITION BY trace_id) AS lo, max(f) OVER (PARTITION BY trace_id) AS hi FROM s)
SELECT trace_id, seq, round(cum, 3) AS cum_m, f AS ele_filled, round(len, 3) AS length_m, lo AS min_ele, hi AS max_ele FROM c
WHERE known >= 2 AND len >= 50""")
def _(d):
    return O.route_profile(trace_heights(d), "trace_id").select("trace_id", "seq", F.round("cum_m", 3).alias("cum_m"), "ele_filled", F.round("length_m", 3).alias("length_m"), "min_ele", "max_ele")


@query("road_route_metrics", f"""
SELECT trace_id, round(sum(greatest(0e0, coalesce(f - p, 0e0))), 3) AS ascent_m, round(sum(greatest(0e0, coalesce(p - f, 0e0))), 3) AS descent_m FROM (SELECT *, lag(f) OVER (PARTITION BY trace_id ORDER BY seq) AS p FROM {_FILLED}) GROUP BY trace_id""")
def _(d):
    out = O.road_route_metrics(trace_heights(d), "trace_id")
    return out.select("trace_id", F.round("ascent_m", 3).alias("ascent_m"), F.round("descent_m", 3).alias("descent_m"))


@query("daylight_margin")
def _(d):
    k = F.col("sid")
    r = supplier_points(d).select(k.alias("req"), "lng", "lat", (1718960400000 + k * 5820000).alias("start_ms"), (3600.0 + k % 10 * 3000).alias("duration_s"))
    return O.daylight_margin(r).select("req", F.round("margin_ms", 0).alias("margin_ms"), "late", "dark")


SEGS_SQL = f"""(SELECT way_id, seq, lng AS ax, lat AS ay, x2, y2 FROM (SELECT way_id, seq, lng, lat, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM {WAY_POINTS_SQL} WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE x2 IS NOT NULL)"""
MATCH_SQL = f"""
WITH sg AS MATERIALIZED (SELECT *, unnest(range(CAST(floor(least(ax, x2) / 5e-4) AS BIGINT), CAST(floor(greatest(ax, x2) / 5e-4) AS BIGINT) + 1)) AS gx FROM {SEGS_SQL}),
m AS MATERIALIZED (SELECT trace_id, seq, (px + lng) / 2 AS mx, (py + lat) / 2 AS my, cos(radians((py + lat) / 2)) * 1.1132e5 AS kx FROM (SELECT *, lag(lng) OVER w AS px, lag(lat) OVER w AS py FROM v_trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) WHERE px IS NOT NULL),
mg AS MATERIALIZED (SELECT *, unnest(range(CAST(floor((mx - 2e-4) / 5e-4) AS BIGINT), CAST(floor((mx + 2e-4) / 5e-4) AS BIGINT) + 1)) AS gx FROM m),
c AS (SELECT m.trace_id, m.seq, s.way_id, s.seq AS sseq, (mx - ax) * kx AS qx, (my - ay) * 1.1054e5 AS qy, (x2 - ax) * kx AS dx, (y2 - ay) * 1.1054e5 AS dy FROM mg m JOIN sg s ON m.gx = s.gx AND my BETWEEN least(ay, y2) - 2e-4 AND greatest(ay, y2) + 2e-4),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0e0, least(1e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) ELSE 0e0 END AS t FROM c),
r AS (SELECT trace_id, seq, arg_min(way_id, (round(sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2)), 6), way_id, sseq)) AS way_id, min(sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2))) AS dist FROM t WHERE sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2)) <= 12 GROUP BY 1, 2)
SELECT m.trace_id, m.seq, coalesce(r.way_id, -1) AS way_id FROM m LEFT JOIN r USING (trace_id, seq)"""


@query("map_match", MATCH_SQL)
def _(d):
    return O.map_match(d.trace_points, d.way_points).select("trace_id", "seq", F.coalesce("way_id", F.lit(-1)).alias("way_id"))


def _chunks(d):
    """Chunks on a stand-in match: one way per 60 trace points, every 17th segment unmatched."""
    m = O.with_neighbour(d.trace_points, ["trace_id"], "seq", {"lng": "px", "lat": "py", "t_s": "pt"}, offset=-1).where("px is not null")
    way = F.when((F.col("trace_id") + F.col("seq")) % 17 != 0, (F.col("trace_id") * 31 + F.floor(F.col("seq") / 60)) % d_orders(d))
    m = m.select("trace_id", "seq", "px", "py", "lng", "lat", (F.col("t_s") - F.col("pt")).alias("dt"), O.haversine_m("px", "py", "lng", "lat").alias("d"), way.alias("way_id"))
    return O.trace_chunks(m)


def d_orders(d):
    return d.table("orders").agg(F.count(F.lit(1))).scalar()


@query("trace_chunks")
def _(d):
    return _chunks(d).select("trace_id", "chunk", "way_id", F.round("d", 3).alias("d"), "t", F.round("a_lng", 6).alias("a_lng"), F.round("b_lng", 6).alias("b_lng"))


@query("trace_mode")
def _(d):
    return O.trace_mode(_chunks(d)).select("trace_id", F.round("v", 6).alias("v"), "mode")


def training_rows(d):
    c = _chunks(d)
    ends = c.select(F.col("a_lng").alias("lng"), F.col("a_lat").alias("lat")).union(c.select("b_lng", "b_lat")).distinct().withColumn("pid", F.struct("lng", "lat"))
    ele = elevation_lookup(ends, "pid", dem_pixels(d), [14, 15], size=8).select("lng", "lat", (F.col("ele") / 200).alias("ele"))
    return O.speed_training_rows(c, O.trace_mode(c), trails(d), ele)


@query("speed_training_rows")
def _(d):
    out = training_rows(d)
    return out.select("trace_id", "chunk", "mode", F.round("y", 6).alias("y"), F.round("w", 3).alias("w"), F.round("v_obs", 6).alias("v_obs"), F.round("v_expert", 6).alias("v_expert"))


@query("home_weights", f"""SELECT id, home, CASE WHEN home THEN imp * 3e0 ELSE imp * 1e0 END AS w FROM (SELECT p.id, p.imp, {Q.hav('s.lng', 's.lat', '2.55887e1', '4.56427e1')} <= 40000 AS home
 FROM v_places p JOIN {SUPPLIER_POINTS} s ON s.sid = p.cat)""")
def _(d):
    rows = d.places.select("id", F.col("cat").cast("long").alias("region"), F.col("imp").cast("double").alias("w"))
    regions = supplier_points(d).withColumnRenamed("sid", "region")
    rows = rows.join(regions.select("region"), "region", "left_semi")
    return O.home_weights(rows, regions, HOME).select("id", "home", "w")


