"""Queries over geographic columns, tiles, polygons, lines and sampled grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.operators import spatial as S
from fellwalk.operators.cells import nearest_points, nearest_segments
from fellwalk.plans import sqltext as Q
from fellwalk.plans.registry import query

HOME = (25.5887, 45.6427)  # fixed value: the home point of the data's main region


def _box(df, half):
    return df.withColumns({"w": F.col("lng") - half, "s": F.col("lat") - half, "e": F.col("lng") + half, "n": F.col("lat") + half})


SUPPLIER_POINTS = """(SELECT s_suppkey AS sid, 2.5e1 + ((s_suppkey * 7919) % 300000) / 1e5 AS lng,
    4.4e1 + ((s_suppkey * 104729) % 300000) / 1e5 AS lat FROM supplier)"""


def supplier_points(d):
    k = F.col("s_suppkey")
    return d.table("supplier").select(k.alias("sid"), (25.0 + (k * 7919) % 300000 / 1e5).alias("lng"),
                                      (44.0 + (k * 104729) % 300000 / 1e5).alias("lat"))


@query("with_distance", f"SELECT id, round({Q.hav('lng', 'lat', '2.55887e1', '4.56427e1')}, 3) AS dist_m FROM v_places")
def _(d):
    out = S.with_distance(d.places.withColumns({"lng2": F.lit(HOME[0]), "lat2": F.lit(HOME[1])}))
    return out.select("id", F.round("dist_m", 3).alias("dist_m"))


@query("with_planar_km", f"SELECT id, round({Q.km('lng', 'lat', '2.55887e1', '4.56427e1')}, 6) AS km FROM v_places")
def _(d):
    out = S.with_planar_km(d.places.withColumns({"lng2": F.lit(HOME[0]), "lat2": F.lit(HOME[1])}))
    return out.select("id", F.round("km", 6).alias("km"))


@query("with_tile", f"""SELECT id, 14 AS z, {Q.tx('lng', '14')} AS x, {Q.ty('lat', '14')} AS y,
    round({Q.txf('lng', '14')}, 6) AS xf, round({Q.tyf('lat', '14')}, 6) AS yf FROM v_places""")
def _(d):
    return S.with_tile(d.places, 14).select("id", "z", "x", "y", F.round("xf", 6).alias("xf"), F.round("yf", 6).alias("yf"))


@query("with_tile_bbox", f"""SELECT id, round({Q.tlng('x', '11')}, 6) AS w, round({Q.tlat('y + 1', '11')}, 6) AS s,
    round({Q.tlng('x + 1', '11')}, 6) AS e, round({Q.tlat('y', '11')}, 6) AS n
  FROM (SELECT id, {Q.tx('lng', '11')} AS x, {Q.ty('lat', '11')} AS y FROM v_places)""")
def _(d):
    out = S.with_tile_bbox(S.with_tile(d.places, 11))
    return out.select("id", *[F.round(c, 6).alias(c) for c in "wsen"])


@query("with_ground_resolution", """SELECT id, round(cos(radians(lat)) * 2 * pi() * 6.378137e6 / (pow(2e0, 14) * 256), 6) AS m_per_px FROM v_places""")
def _(d):
    return S.with_ground_resolution(d.places.withColumn("z", F.lit(14))).select("id", F.round("m_per_px", 6).alias("m_per_px"))


@query("explode_tiles", f"""
WITH b AS (SELECT id, lng - 5e-2 AS w, lat - 5e-2 AS s, lng + 5e-2 AS e, lat + 5e-2 AS n FROM v_places),
t AS (SELECT id, z, {Q.tx('w', 'z')} AS x0, CAST(floor({Q.txf('e', 'z')} - 1e-9) AS INT) AS x1,
             {Q.ty('n', 'z')} AS y0, CAST(floor({Q.tyf('s', 'z')} - 1e-9) AS INT) AS y1
      FROM b, (SELECT unnest(range(9, 13)) AS z)),
u AS (SELECT id, z, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM t),
v AS (SELECT id, z, x, unnest(range(y0, y1 + 1)) AS y FROM u)
SELECT CAST(z AS INT) AS z, CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS boxes FROM v GROUP BY z, x, y""")
def _(d):
    tiles = S.explode_tiles(_box(d.places, 0.05), F.lit(9), F.lit(12))
    return tiles.groupBy("z", "x", "y").agg(F.count(F.lit(1)).alias("boxes"))


@query("bbox_join", f"""
SELECT p.id, s.sid FROM v_places p JOIN {SUPPLIER_POINTS} s
  ON p.lng - 3e-2 < s.lng + 1e-1 AND p.lng + 3e-2 > s.lng - 1e-1 AND p.lat - 3e-2 < s.lat + 1e-1 AND p.lat + 3e-2 > s.lat - 1e-1""")
def _(d):
    a = _box(d.places, 0.03).select("id", "w", "s", "e", "n")
    b = _box(supplier_points(d), 0.1).select("sid", "w", "s", "e", "n")
    return S.bbox_join(a, b, 0.1).select("id", F.col("b_sid").alias("sid"))


@query("with_utm", f"""
SELECT id, epsg, round(easting, 3) AS easting, round(northing, 3) AS northing
FROM {Q.utm_select("(SELECT id, lng, lat, 34 + cat % 2 AS zone, 32634 + cat % 2 AS epsg, false AS south FROM v_places)")}""")
def _(d):
    out = S.with_utm(d.places.withColumn("epsg", 32634 + F.col("cat") % 2))
    return out.select("id", "epsg", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query("with_epsg_from_mgrs", """
SELECT id, grid, CASE WHEN substr(grid, 3, 1) >= 'N' THEN 32600 ELSE 32700 END + CAST(substr(grid, 1, 2) AS INT) AS epsg
FROM (SELECT id, concat(CAST(34 + cat % 2 AS STRING), CASE WHEN cat % 3 = 0 THEN 'H' ELSE 'T' END, 'LM') AS grid FROM v_places)""")
def _(d):
    grid = F.concat((34 + F.col("cat") % 2).cast("string"), F.when(F.col("cat") % 3 == 0, "H").otherwise("T"), F.lit("LM"))
    return S.with_epsg_from_mgrs(d.places.select("id", grid.alias("grid")))


# polygons: a six-cornered area with a square hole around every supplier
RING_SHAPE = [(0, 0, 0.2, 0.0), (0, 1, 0.12, 0.15), (0, 2, -0.1, 0.18), (0, 3, -0.22, 0.02), (0, 4, -0.1, -0.16), (0, 5, 0.1, -0.15),
              (1, 0, 0.05, 0.0), (1, 1, 0.0, 0.06), (1, 2, -0.05, 0.0), (1, 3, 0.0, -0.06)]


def supplier_rings(d):
    shape = F.array(*[F.struct(F.lit(r).alias("ring"), F.lit(q).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy"))
                      for r, q, x, y in RING_SHAPE])
    return supplier_points(d).withColumn("v", F.explode(shape)).select(
        F.col("sid").alias("poly_id"), "v.ring", "v.seq", (F.col("lng") + F.col("v.dx")).alias("lng"),
        (F.col("lat") + F.col("v.dy")).alias("lat"))


_RING_ROWS = ", ".join(f"({r}, {q}, {x:e}, {y:e}, {[t for t in RING_SHAPE if t[0] == r][(q + 1) % len([t for t in RING_SHAPE if t[0] == r])][2]:e}, "
                       f"{[t for t in RING_SHAPE if t[0] == r][(q + 1) % len([t for t in RING_SHAPE if t[0] == r])][3]:e})" for r, q, x, y in RING_SHAPE)
SUPPLIER_EDGES = f"""(SELECT sid, ring, lng + dx AS x1, lat + dy AS y1, lng + ex AS x2, lat + ey AS y2
   FROM {SUPPLIER_POINTS} s, (VALUES {_RING_ROWS}) AS v(ring, seq, dx, dy, ex, ey))"""
POINTS_IN_POLYGONS_SQL = f"""
SELECT id, sid AS poly_id FROM (
  SELECT p.id, e.sid, e.ring, sum(CASE WHEN {Q.crosses('p.lng', 'p.lat', 'e.x1', 'e.y1', 'e.x2', 'e.y2')} THEN 1 ELSE 0 END) % 2 AS odd
  FROM v_places p, {SUPPLIER_EDGES} e GROUP BY p.id, e.sid, e.ring)
GROUP BY id, sid HAVING max(CASE WHEN ring = 0 THEN odd END) = 1 AND max(CASE WHEN ring = 1 THEN odd END) = 0"""


@query("points_in_polygons", POINTS_IN_POLYGONS_SQL)
def _(d):
    return S.points_in_polygons(d.places, "id", supplier_rings(d))


_OUTLINE_EDGES = ", ".join(f"({a[0]:e}, {a[1]:e}, {b[0]:e}, {b[1]:e})" for a, b in zip(S.COUNTRY_OUTLINE, S.COUNTRY_OUTLINE[1:]))


@query("filter_country", f"""
SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM v_places p, (VALUES {_OUTLINE_EDGES}) AS o(x1, y1, x2, y2)
GROUP BY id, lng, lat HAVING sum(CASE WHEN {Q.crosses('lng', 'lat', 'x1', 'y1', 'x2', 'y2')} THEN 1 ELSE 0 END) % 2 = 1""")
def _(d):
    return S.filter_country(d.places).select("id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query("filter_bbox_touches_country", f"""
WITH s AS (SELECT id, lng - 1.2e-1 - 8e-2 + (2.4e-1 + 1.6e-1) * i / 4e0 AS x, lat - 1.2e-1 - 8e-2 + (2.4e-1 + 1.6e-1) * j / 4e0 AS y, i, j
  FROM v_places, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)),
h AS (SELECT id, i, j, sum(CASE WHEN {Q.crosses('x', 'y', 'x1', 'y1', 'x2', 'y2')} THEN 1 ELSE 0 END) % 2 AS odd
  FROM s, (VALUES {_OUTLINE_EDGES}) AS o(x1, y1, x2, y2) GROUP BY id, i, j)
SELECT id FROM h GROUP BY id HAVING max(odd) = 1""")
def _(d):
    return S.filter_bbox_touches_country(_box(d.places, 0.12)).select("id")


# short road pieces around every supplier
ROAD_SHAPE = [(0, -0.06, -0.02), (1, 0.01, 0.015), (2, 0.05, 0.04)]


def supplier_roads(d):
    shape = F.array(*[F.struct(F.lit(q).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for q, x, y in ROAD_SHAPE])
    return supplier_points(d).withColumn("v", F.explode(shape)).select(
        F.col("sid").alias("line_id"), "v.seq", (F.col("lng") + F.col("v.dx")).alias("lng"), (F.col("lat") + F.col("v.dy")).alias("lat"))


@query("nearest_point_on_lines", f"""
WITH sg AS (SELECT sid, k AS seq, lng + vax AS ax, lat + vay AS ay, lng + vbx AS x2, lat + vby AS y2 FROM {SUPPLIER_POINTS} s,
    (VALUES (0, -6e-2, -2e-2, 1e-2, 1.5e-2), (1, 1e-2, 1.5e-2, 5e-2, 4e-2)) AS v(k, vax, vay, vbx, vby)),
p AS (SELECT id, lng, lat, cos(radians(lat)) * 1.1132e5 AS mx FROM v_places),
c AS (SELECT id, sid, seq, lng, lat, mx, ax, ay, x2, y2, (x2 - ax) * mx AS dx, (y2 - ay) * 1.1054e5 AS dy FROM p, sg
      WHERE lng BETWEEN least(ax, x2) - 2e-1 AND greatest(ax, x2) + 2e-1 AND lat BETWEEN least(ay, y2) - 2e-1 AND greatest(ay, y2) + 2e-1),
t AS (SELECT *, greatest(0e0, least(1e0, ((lng - ax) * mx * dx + (lat - ay) * 1.1054e5 * dy) / (dx * dx + dy * dy))) AS t FROM c),
r AS (SELECT *, sqrt(pow((lng - ax) * mx - t * dx, 2) + pow((lat - ay) * 1.1054e5 - t * dy, 2)) AS dist FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, sid, seq) AS rn FROM r WHERE dist <= 3e3)
SELECT id, sid AS line_id, seq, round(t, 6) AS t, round(dist, 3) AS dist_m, round(ax + t * (x2 - ax), 6) AS snap_lng,
       round(ay + t * (y2 - ay), 6) AS snap_lat FROM w WHERE rn = 1""")
def _(d):
    seg = S.line_segments(supplier_roads(d), "line_id")
    out = nearest_segments(d.places, "id", seg, ["line_id", "seq"], 3000.0)
    return out.select("id", "line_id", "seq", F.round("t", 6).alias("t"), F.round("dist_m", 3).alias("dist_m"),
                      F.round("snap_lng", 6).alias("snap_lng"), F.round("snap_lat", 6).alias("snap_lat"))


@query("nearest_nodes", f"""
WITH p AS (SELECT trace_id, seq, lng, lat FROM v_trace_points),
c AS (SELECT trace_id, seq, node_id, {Q.hav('p.lng', 'p.lat', 'n.lng', 'n.lat')} AS dist FROM p JOIN v_nodes n
      ON n.lng BETWEEN p.lng - 2e-3 AND p.lng + 2e-3 AND n.lat BETWEEN p.lat - 2e-3 AND p.lat + 2e-3),
w AS (SELECT *, row_number() OVER (PARTITION BY trace_id, seq ORDER BY dist, node_id) AS rn FROM c WHERE dist < 1e2)
SELECT trace_id, seq, node_id, round(dist, 3) AS dist_m FROM w WHERE rn = 1""")
def _(d):
    pts = d.trace_points.withColumn("pid", F.struct("trace_id", "seq"))
    out = nearest_points(pts, "pid", d.nodes, "node_id", 100.0)
    return out.select("pid.trace_id", "pid.seq", "node_id", F.round("dist_m", 3).alias("dist_m"))


GRID_POINTS = """(SELECT event_id, ((event_id * 7919) % 5400) / 1e2 - 2 AS fx, ((event_id * 104729) % 4400) / 1e2 - 2 AS fy FROM events)"""


def grid_points(d):
    e = F.col("event_id")
    return d.table("events").select(e, ((e * 7919) % 5400 / 1e2 - 2).alias("fx"), ((e * 104729) % 4400 / 1e2 - 2).alias("fy"))


def _density_pixels(d):
    return d.density_cells.select(F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("q").cast("double").alias("v"))


@query("sample_grid_bilinear", f"""
WITH p AS (SELECT event_id, CAST(floor(fx) AS INT) AS ix, CAST(floor(fy) AS INT) AS iy, fx - floor(fx) AS ax, fy - floor(fy) AS ay FROM {GRID_POINTS} g)
SELECT event_id, round(CASE WHEN a.q IS NULL OR b.q IS NULL OR c.q IS NULL OR e.q IS NULL THEN 0e0 ELSE
   (a.q * (1 - ax) + b.q * ax) * (1 - ay) + (c.q * (1 - ax) + e.q * ax) * ay END, 6) AS value
FROM p LEFT JOIN v_density_cells a ON a.cx = ix AND a.cy = iy LEFT JOIN v_density_cells b ON b.cx = ix + 1 AND b.cy = iy
       LEFT JOIN v_density_cells c ON c.cx = ix AND c.cy = iy + 1 LEFT JOIN v_density_cells e ON e.cx = ix + 1 AND e.cy = iy + 1""")
def _(d):
    out = S.sample_grid_bilinear(grid_points(d), "event_id", _density_pixels(d), "v")
    return out.select("event_id", F.round("value", 6).alias("value"))


@query("sample_grid_nearest", f"""
SELECT event_id, coalesce(CAST(q AS DOUBLE), 0e0) AS value FROM {GRID_POINTS} g
LEFT JOIN v_density_cells ON cx = CAST(floor(fx) AS INT) AND cy = CAST(floor(fy) AS INT)""")
def _(d):
    return S.sample_grid_nearest(grid_points(d), _density_pixels(d), "v").select("event_id", "value")


# DEM pixels from parts: 8x8 pixel tiles, alternating zoom 15 and 14, around the walked area
DEM_SQL = """(SELECT 14 + k % 2 AS z, CASE WHEN k % 2 = 1 THEN 18659 ELSE 9329 END + CAST(floor(k / 2e0) AS INT) % 4 AS tx,
   CASE WHEN k % 2 = 1 THEN 11785 ELSE 5892 END + CAST(floor(k / 8e0) AS INT) % 8 AS ty, i % 8 AS ix, CAST(floor(i / 8e0) AS INT) AS iy, ele
 FROM (SELECT CAST(floor(p_partkey / 6.4e1) AS INT) % 64 AS k, CAST(p_partkey % 64 AS INT) AS i, avg(CAST(600 + (p_partkey * 37) % 1500 AS DOUBLE)) AS ele
       FROM part GROUP BY 1, 2))"""


def dem_pixels(d):
    p = F.col("p_partkey")
    src = (d.table("part").select((F.floor(p / 64) % 64).cast("int").alias("k"), (p % 64).cast("int").alias("i"),
                                  (600 + (p * 37) % 1500).cast("double").alias("ele"))
           .groupBy("k", "i").agg(F.avg("ele").alias("ele")))
    odd = F.col("k") % 2 == 1
    return src.select((14 + F.col("k") % 2).alias("z"),
                      (F.when(odd, 18659).otherwise(9329) + F.floor(F.col("k") / 2) % 4).cast("int").alias("tx"),
                      (F.when(odd, 11785).otherwise(5892) + F.floor(F.col("k") / 8) % 8).cast("int").alias("ty"),
                      (F.col("i") % 8).alias("ix"), F.floor(F.col("i") / 8).cast("int").alias("iy"), "ele")


def elevation_sql(src):
    """Elevation of relation `src` (rid, lng, lat) on the DEM pixels."""
    return f"""(SELECT rid, arg_max(ele, z) AS ele FROM (
  SELECT rid, p.z, sum(m.ele * (CASE WHEN dx = 1 THEN ax ELSE 1 - ax END) * (CASE WHEN dy = 1 THEN ay ELSE 1 - ay END)) AS ele, count(*) AS n
  FROM (SELECT rid, z, tx, ty, floor(px) AS ix, floor(py) AS iy, px - floor(px) AS ax, py - floor(py) AS ay FROM (
    SELECT rid, z, tx, ty, {Q.clamp('(xf - tx) * 8 - 5e-1', '0e0', '6.999e0')} AS px, {Q.clamp('(yf - ty) * 8 - 5e-1', '0e0', '6.999e0')} AS py FROM (
      SELECT rid, z, xf, yf, floor(xf) AS tx, floor(yf) AS ty FROM (
        SELECT rid, z, {Q.txf('lng', 'z')} AS xf, {Q.tyf('lat', 'z')} AS yf FROM {src}, (VALUES (14), (15)) AS zz(z))))) p,
    (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(dx, dy), {DEM_SQL} m
  WHERE m.z = p.z AND m.tx = p.tx AND m.ty = p.ty AND m.ix = p.ix + dx AND m.iy = p.iy + dy GROUP BY rid, p.z) WHERE n = 4 GROUP BY rid)"""


@query("elevation_lookup", f"""
SELECT n.node_id, round(coalesce(e.ele, -1e0), 3) AS ele FROM v_nodes n
LEFT JOIN {elevation_sql('(SELECT node_id AS rid, lng, lat FROM v_nodes)')} e ON e.rid = n.node_id""")
def _(d):
    out = S.elevation_lookup(d.nodes.drop("ele"), "node_id", dem_pixels(d), [14, 15], size=8)
    return out.select("node_id", F.round(F.coalesce("ele", F.lit(-1.0)), 3).alias("ele"))


@query("dem_zoom", f"""
WITH b AS (SELECT id, lng - imp / 1e2 AS w, lat - imp / 1e2 AS s, lng + imp / 1e2 AS e, lat + imp / 1e2 AS n FROM v_places),
t AS (SELECT id, z, (floor({Q.txf('e', 'z')} - 1e-9) - floor({Q.txf('w', 'z')}) + 1) * (floor({Q.tyf('s', 'z')} - 1e-9) - floor({Q.tyf('n', 'z')}) + 1) AS tiles
      FROM b, (SELECT unnest(range(9, 13)) AS z))
SELECT id, CAST(coalesce(max(CASE WHEN tiles <= 64 THEN z END), 8) AS INT) AS dem_zoom FROM t GROUP BY id""")
def _(d):
    imp = F.col("imp") / 100
    b = d.places.withColumns({"w": F.col("lng") - imp, "s": F.col("lat") - imp, "e": F.col("lng") + imp, "n": F.col("lat") + imp})
    return S.dem_zoom(b, 12, 64).select("id", "dem_zoom")


WAY_POINTS_SQL = "(SELECT v.way_id, v.seq, v.node_id, n.lng, n.lat, n.ele FROM v_way_vertices v JOIN v_nodes n USING (node_id))"


@query("line_measures", f"""
WITH v AS (SELECT way_id, seq, lng, lat, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2, count(*) OVER (PARTITION BY way_id) AS n
           FROM {WAY_POINTS_SQL} WINDOW w AS (PARTITION BY way_id ORDER BY seq))
SELECT way_id, round(coalesce(sum({Q.hav('lng', 'lat', 'x2', 'y2')}), 0e0), 3) AS length_m, round(min(lng), 6) AS w, round(min(lat), 6) AS s,
  round(max(lng), 6) AS e, round(max(lat), 6) AS n, round(max(CASE WHEN seq = floor(n / 2e0) THEN lng END), 6) AS mid_lng,
  round(max(CASE WHEN seq = floor(n / 2e0) THEN lat END), 6) AS mid_lat FROM v GROUP BY way_id""")
def _(d):
    v = d.way_points
    out = (S.line_bbox(v, "way_id").join(S.line_length(v, "way_id"), "way_id", "left").join(S.line_midpoint(v, "way_id"), "way_id"))
    return out.select("way_id", F.round(F.coalesce("length_m", F.lit(0.0)), 3).alias("length_m"),
                      *[F.round(c, 6).alias(c) for c in ("w", "s", "e", "n", "mid_lng", "mid_lat")])


@query("simplify_lines")
def _(d):
    out = S.simplify_lines(d.trace_points.select("trace_id", "seq", "lng", "lat"), "trace_id", 2e-4)
    return out.select("trace_id", "seq", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query("simplify_lines_segment")
def _(d):
    out = S.simplify_lines(d.trace_points.select("trace_id", "seq", "lng", "lat"), "trace_id", 1e-4, metric="segment")
    return out.groupBy("trace_id").agg(F.count(F.lit(1)).alias("kept"))


@query("densify_lines", f"""
WITH v AS (SELECT trace_id, seq, lng, lat, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM v_trace_points
           WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
n AS (SELECT *, greatest(1, CAST(ceil({Q.hav('lng', 'lat', 'x2', 'y2')} / 1e1) AS INT)) AS n FROM v WHERE x2 IS NOT NULL),
p AS (SELECT trace_id, seq, n, lng, lat, x2, y2, unnest(range(0, n)) AS part FROM n)
SELECT trace_id, seq, CAST(part AS INT) AS part, round(lng + (x2 - lng) * part / n, 6) AS lng, round(lat + (y2 - lat) * part / n, 6) AS lat FROM p
UNION ALL SELECT trace_id, seq, 0, round(lng, 6), round(lat, 6) FROM v WHERE x2 IS NULL""")
def _(d):
    out = S.densify_lines(d.trace_points.select("trace_id", "seq", "lng", "lat"), "trace_id", 10.0)
    return out.select("trace_id", "seq", "part", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


@query("snap_scan_boxes", """
WITH b AS (SELECT lng AS cx, lat AS cy, least(8e-2, imp / 2e2) / 2 AS half FROM v_places)
SELECT DISTINCT floor((cx - half) * 200 + 5e-1) / 200 AS w, floor((cy - half) * 200 + 5e-1) / 200 AS s,
  floor((cx + half) * 200 + 5e-1) / 200 AS e, floor((cy + half) * 200 + 5e-1) / 200 AS n
FROM (SELECT (w + e) / 2 AS cx, (s + n) / 2 AS cy, least(8e-2, greatest(e - w, n - s)) / 2 AS half
      FROM (SELECT lng - imp / 4e2 AS w, lat - imp / 4e2 AS s, lng + imp / 4e2 AS e, lat + imp / 4e2 AS n FROM v_places))""")
def _(d):
    h = F.col("imp") / 400
    v = d.places.select((F.col("lng") - h).alias("w"), (F.col("lat") - h).alias("s"), (F.col("lng") + h).alias("e"), (F.col("lat") + h).alias("n"))
    return S.snap_scan_boxes(v)


@query("fill_elevation_gaps", """
WITH v AS (SELECT trace_id, seq, CASE WHEN accuracy % 3 <> 0 THEN 5e2 + accuracy END AS ele FROM v_trace_points)
SELECT trace_id, seq, coalesce(last_value(ele IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(ele IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ele_filled FROM v""")
def _(d):
    path = d.trace_points.select("trace_id", "seq", F.when(F.col("accuracy") % 3 != 0, 500.0 + F.col("accuracy")).alias("ele"))
    return S.fill_elevation_gaps(path, ["trace_id"]).select("trace_id", "seq", "ele_filled")


