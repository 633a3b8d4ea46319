"""Queries over density grids, neighbourhood readings and risk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fellwalk.functions import risk as R
from fellwalk.operators import density as D
from fellwalk.plans import sqltext as Q
from fellwalk.plans.geo import SUPPLIER_POINTS, supplier_points, supplier_rings, SUPPLIER_EDGES
from fellwalk.plans.registry import query

GRID = D.Grid(25.0, 47.0, 0.06)
DEC = "CASE WHEN q = 0 THEN 0e0 ELSE pow(1e1, -4 + (q - 1) / 2.54e2 * 5) END"
DENS = f"(SELECT cx, cy, q, {DEC} AS density FROM v_density_cells)"


def cells(d):
    return d.density_cells.withColumn("density", R.decode_density("q"))


@query("decode_density", f"SELECT cx, cy, round({DEC}, 9) AS density FROM v_density_cells")
def _(d):
    return cells(d).select("cx", "cy", F.round("density", 9).alias("density"))


@query("encode_density", "SELECT cx, cy, CASE WHEN q < 2 THEN 0 ELSE q END AS q FROM v_density_cells")
def _(d):
    return cells(d).select("cx", "cy", R.encode_density("density").alias("q"))


@query("density_at", f"""SELECT id, round(coalesce(density, 0e0), 9) AS density FROM v_places
LEFT JOIN {DENS} c ON cx = CAST(floor((lng - 25) / 6e-2) AS INT) AND cy = CAST(floor((47 - lat) / 6e-2) AS INT)""")
def _(d):
    return D.density_at(d.places, cells(d), GRID).select("id", F.round("density", 9).alias("density"))


# fine cells: 50 x 50 per degree tile, derived from events
FINE = """(SELECT CAST(25 + tn % 2 AS INT) AS tile_lon, CAST(45 + floor(tn / 2e0) % 2 AS INT) AS tile_lat, CAST(event_id % 50 AS INT) AS ix, CAST(floor(event_id / 5e1) AS INT) % 50 AS iy,
   pow(1e1, -4 + (max(event_id * 7 % 256)) / 2.54e2 * 5) AS density FROM (SELECT event_id, CAST(floor(event_id / 2.5e3) AS BIGINT) % 4 AS tn FROM events) GROUP BY 1, 2, 3, 4)"""
LISTED = "(SELECT * FROM (VALUES (25, 45), (26, 45), (25, 46), (26, 46), (27, 45)) AS l(tile_lon, tile_lat))"


def fine(d):
    e = F.col("event_id")
    tn = F.floor(e / 2500) % 4
    return (d.table("events").select((25 + tn % 2).cast("int").alias("tile_lon"), (45 + F.floor(tn / 2) % 2).cast("int").alias("tile_lat"),
                                     (e % 50).cast("int").alias("ix"), (F.floor(e / 50) % 50).cast("int").alias("iy"), (e * 7 % 256).alias("v"))
            .groupBy("tile_lon", "tile_lat", "ix", "iy").agg(F.pow(F.lit(10.0), -4 + F.max("v") / 254.0 * 5).alias("density")))


def listed(d):
    tiles = F.array(*[F.struct(F.lit(a).alias("tile_lon"), F.lit(b).alias("tile_lat")) for a, b in ((25, 45), (26, 45), (25, 46), (26, 46), (27, 45))])
    return d.spark.range(1).select(F.inline(tiles))


def _fine_at_sql(src, key):
    return f"""(SELECT p.*, CASE WHEN ld.tile_lon IS NOT NULL THEN coalesce(f.density, 0e0) WHEN li.tile_lon IS NULL THEN 0e0 END AS fine_density
 FROM (SELECT *, CAST(floor(lng) AS INT) AS tlo, CAST(floor(lat) AS INT) AS tla, CAST(least(49, floor((lng - floor(lng)) / 2e-2)) AS INT) AS fix, CAST(least(49, floor((floor(lat) + 1 - lat) / 2e-2)) AS INT) AS fiy FROM {src}) p
 LEFT JOIN (SELECT DISTINCT tile_lon, tile_lat FROM {FINE}) ld ON ld.tile_lon = tlo AND ld.tile_lat = tla LEFT JOIN {LISTED} li ON li.tile_lon = tlo AND li.tile_lat = tla
 LEFT JOIN {FINE} f ON f.tile_lon = tlo AND f.tile_lat = tla AND f.ix = fix AND f.iy = fiy)"""


@query("fine_density_at", f"SELECT id, round(coalesce(fine_density, -1e0), 9) AS density FROM {_fine_at_sql('v_places', 'id')}")
def _(d):
    out = D.fine_density_at(d.places, fine(d), listed(d), 0.02, 50)
    return out.select("id", F.round(F.coalesce("fine_density", F.lit(-1.0)), 9).alias("density"))


def _around_sql(rx, ry, cols="id, lng, lat"):
    """Places with the grid cells in reach and centre offsets in km."""
    return f"""(SELECT *, (cx + 5e-1 - fx) * kmx AS dx, (cy + 5e-1 - fy) * 6e-2 * 1.1132e2 AS dy FROM (
  SELECT *, unnest(range(CAST(floor(fx - ({rx})) AS BIGINT), CAST(floor(fx + ({rx})) AS BIGINT) + 1)) AS cx FROM (
   SELECT *, unnest(range(CAST(floor(fy - ({ry})) AS BIGINT), CAST(floor(fy + ({ry})) AS BIGINT) + 1)) AS cy FROM (
    SELECT {cols}, (lng - 25) / 6e-2 AS fx, (47 - lat) / 6e-2 AS fy, 6e-2 * 1.1132e2 * cos(radians(lat)) AS kmx FROM v_places))))"""


def local_coarse_sql(sigma):
    rx, ry = f"{3 * sigma:e} / kmx", f"{3 * sigma:e} / (6e-2 * 1.1132e2)"
    return f"""(SELECT id, sum(w * coalesce(density, 0e0)) / sum(w) AS density FROM (SELECT id, cx, cy, exp(-(dx * dx + dy * dy) / {2 * sigma * sigma:e}) AS w FROM {_around_sql(rx, ry)}) a
  LEFT JOIN {DENS} c ON c.cx = a.cx AND c.cy = a.cy GROUP BY id)"""


def area_sql(r):
    rx, ry = f"ceil({r:e} / kmx) + 1", f"ceil({r:e} / (6e-2 * 1.1132e2)) + 1"
    return f"""(SELECT id, avg(coalesce(density, 0e0)) AS density, max(coalesce(density, 0e0)) AS peak, avg(coalesce(density, 0e0)) * pi() * {r * r:e} AS animals FROM
  (SELECT id, cx, cy FROM {_around_sql(rx, ry)} WHERE (cx = floor(fx) AND cy = floor(fy)) OR dx * dx + dy * dy <= {r * r:e}) a LEFT JOIN {DENS} c ON c.cx = a.cx AND c.cy = a.cy GROUP BY id)"""


def local_sql(sigma):
    r = 3 * sigma
    lattice = f"""(SELECT id, exp(-(dx * dx + dy * dy) / {2 * sigma * sigma:e}) AS w, lng0 + dx / (1.1132e2 * cos(radians(lat0))) AS lng, lat0 + dy / 1.1132e2 AS lat FROM (
   SELECT id, lng0, lat0, {-r:e} + i * kmx AS dx, {-r:e} + j * (2e-2 * 1.1132e2) AS dy FROM (
    SELECT id, lng0, lat0, kmx, j, unnest(range(0, CAST(floor({2 * r:e} / kmx) AS BIGINT) + 1)) AS i FROM (
     SELECT id, lng AS lng0, lat AS lat0, 2e-2 * 1.1132e2 * cos(radians(lat)) AS kmx, unnest(range(0, CAST(floor({2 * r:e} / (2e-2 * 1.1132e2)) AS BIGINT) + 1)) AS j FROM v_places)))
   WHERE exp(-(dx * dx + dy * dy) / {2 * sigma * sigma:e}) >= 1e-2)"""
    return f"""(SELECT p.id, l.tile_lon IS NOT NULL AS has_fine, CASE WHEN l.tile_lon IS NOT NULL AND NOT coalesce(f.missing, false) THEN coalesce(f.density, 0e0) ELSE c.density END AS density
 FROM v_places p LEFT JOIN (SELECT DISTINCT tile_lon, tile_lat FROM {FINE}) l ON l.tile_lon = CAST(floor(lng) AS INT) AND l.tile_lat = CAST(floor(lat) AS INT)
 LEFT JOIN (SELECT id, sum(w * fine_density) / sum(w) AS density, bool_or(fine_density IS NULL) AS missing FROM {_fine_at_sql(lattice, 'id')} GROUP BY id) f ON f.id = p.id
 JOIN {local_coarse_sql(sigma)} c ON c.id = p.id)"""


@query("local_density_coarse", f"SELECT id, round(density, 8) AS density FROM {local_coarse_sql(3.0)}")
def _(d):
    return D.local_density_coarse(d.places, "id", cells(d), GRID, 3.0).select("id", F.round("density", 8).alias("density"))


@query("local_density", f"SELECT id, has_fine, round(density, 8) AS density FROM {local_sql(2.0)}")
def _(d):
    out = D.local_density(d.places, "id", cells(d), GRID, fine(d), listed(d), 0.02, 50, 2.0)
    return out.select("id", "has_fine", F.round("density", 8).alias("density"))


@query("area_stats", f"SELECT id, round(density, 8) AS density, round(peak, 8) AS peak, round(animals, 6) AS animals FROM {area_sql(10.0)}")
def _(d):
    return D.area_stats(d.places, "id", cells(d), GRID, 10.0).select("id", F.round("density", 8).alias("density"), F.round("peak", 8).alias("peak"), F.round("animals", 6).alias("animals"))


REQ_SQL = """(SELECT id, lng, lat, CASE cat % 5 WHEN 0 THEN 'foot' WHEN 1 THEN 'bike' WHEN 2 THEN 'moto' WHEN 3 THEN 'car' ELSE 'sled' END AS mode,
   1704067200000 + CAST(substr(id, 2) AS BIGINT) * 5820000 AS ms FROM v_places)"""


def requests(d):
    c = F.col("cat") % 5
    mode = F.when(c == 0, "foot").when(c == 1, "bike").when(c == 2, "moto").when(c == 3, "car").otherwise("sled")
    ms = 1704067200000 + F.substring("id", 2, 20).cast("long") * 5820000
    return d.places.select("id", "lng", "lat", mode.alias("mode"), F.timestamp_millis(ms).alias("ts"))


def sun_sql(src, ms="ms"):
    """Relation `src` (lng, lat, ms) with the sun's elevation el."""
    return f"""(SELECT * EXCLUDE (n_, l_, g_, lam_, eps_), degrees(asin(sin(radians(lat)) * sin(asin(sin(eps_) * sin(lam_))) + cos(radians(lat)) * cos(asin(sin(eps_) * sin(lam_)))
   * cos(radians(((1.8697374558e1 + 2.406570982441908e1 * n_) % 2.4e1) * 15 + lng) - atan2(cos(eps_) * sin(lam_), cos(lam_))))) AS el
  FROM (SELECT *, radians(l_ + 1.915 * sin(g_) + 2e-2 * sin(2 * g_)) AS lam_, radians(2.3439e1 - 4e-7 * n_) AS eps_
   FROM (SELECT *, (2.8046e2 + 9.856474e-1 * n_) % 3.6e2 AS l_, radians((3.57528e2 + 9.856003e-1 * n_) % 3.6e2) AS g_ FROM (SELECT *, {ms} / 8.64e7 + 2.4405875e6 - 2.451545e6 AS n_ FROM {src}))))"""


SEASON_SQL = "list_extract([0.25::DOUBLE, 0.3, 0.6, 0.9, 1.0, 1.0, 1.0, 1.1, 1.25, 1.25, 0.8, 0.35], CAST(month(make_timestamp(ms * 1000)) AS INT))"
LIGHT_SQL = "CASE WHEN el > 6 THEN 'day' WHEN el > -6 THEN 'twilight' ELSE 'night' END"
MODE_SQL = "CASE mode WHEN 'foot' THEN 1e0 WHEN 'bike' THEN 1.3e0 WHEN 'moto' THEN 7e-1 WHEN 'car' THEN 3e-1 ELSE 1e0 END"


@query("season_light_mode", f"SELECT id, {SEASON_SQL} AS season, {LIGHT_SQL} AS light, {MODE_SQL} AS mode_factor FROM {sun_sql(REQ_SQL)}")
def _(d):
    return D.season_light_mode(requests(d)).select("id", "season", "light", "mode_factor")


@query("with_sun_elevation", f"SELECT id, round(el, 5) AS sun_elevation FROM {sun_sql(REQ_SQL)}")
def _(d):
    return D.with_sun_elevation(requests(d)).select("id", F.round("sun_elevation", 5).alias("sun_elevation"))


def _sunset_sql():
    steps = f"(SELECT id, lng, lat, ms AS ms0, i, ms + i * 6e5 AS ms FROM {REQ_SQL}, (SELECT unnest(range(0, 145)) AS i))"
    first = f"(SELECT id, any_value(lng) AS lng, any_value(lat) AS lat, any_value(ms0) AS ms0, bool_or(i = 0 AND el >= -8.33e-1) AS up, min(CASE WHEN el >= -8.33e-1 AND nxt < -8.33e-1 THEN ms END) AS a FROM (SELECT *, lead(el) OVER (PARTITION BY id ORDER BY i) AS nxt FROM {sun_sql(steps)}) GROUP BY id)"
    ctes = [f"s0 AS MATERIALIZED (SELECT id, lng, lat, ms0, up, a, a + 6e5 AS b FROM {first})"]
    for k in range(12):
        mid = sun_sql(f"(SELECT *, (a + b) / 2 AS ms FROM s{k})")
        ctes.append(f"s{k + 1} AS MATERIALIZED (SELECT id, lng, lat, ms0, up, CASE WHEN el >= -8.33e-1 THEN ms ELSE a END AS a, CASE WHEN el >= -8.33e-1 THEN b ELSE ms END AS b FROM {mid})")
    return "WITH " + ",\n".join(ctes) + " SELECT id, up, round((a + b) / 2 - ms0, 1) AS until_ms, round(CASE WHEN up THEN (a + b) / 2 - ms0 ELSE 0e0 END, 1) AS left_ms FROM s12"


@query("daylight", _sunset_sql())
def _(d):
    out = D.daylight(requests(d))
    return out.select("id", "up", F.round(F.col("sunset_ms") - R.epoch_ms("ts"), 1).alias("until_ms"), F.round("left_ms", 1).alias("left_ms"))


SIGHT_SQL = """(SELECT c_custkey AS sid, 2.5e1 + ((c_custkey * 7919) % 300000) / 1e5 AS lng, 4.4e1 + ((c_custkey * 104729) % 300000) / 1e5 AS lat, c_custkey % 3 = 0 AS obscured,
   CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 7) * 4e2 END AS accuracy_m, c_custkey % 45 / 1e0 AS age_days FROM customer)"""


def sightings(d):
    k = F.col("c_custkey")
    return d.table("customer").select(k.alias("sid"), (25.0 + (k * 7919) % 300000 / 1e5).alias("lng"), (44.0 + (k * 104729) % 300000 / 1e5).alias("lat"),
                                      (k % 3 == 0).alias("obscured"), F.when(k % 4 != 0, (k % 7) * 400.0).alias("accuracy_m"), (k % 45).cast("double").alias("age_days"))


def weights_sql(r):
    return f"""(SELECT id, sid, age_days, CASE WHEN NOT obscured THEN greatest(0e0, least(1e0, ({r:e} + acc - sqrt(pow((sx - lng) * kx, 2) + pow((sy - lat) * 1.1132e2, 2))) / (2 * acc)))
   ELSE greatest((SELECT count(*) FROM (SELECT unnest(range(0, 576)) AS k) WHERE sqrt(pow((x0 + (floor(k / 2.4e1) + 5e-1) / 24 * 2e-1 - lng) * kx, 2) + pow((y0 + (k % 24 + 5e-1) / 24 * 2e-1 - lat) * 1.1132e2, 2)) <= {r:e}) / 5.76e2,
     CASE WHEN lng >= x0 AND lng < x0 + 2e-1 AND lat >= y0 AND lat < y0 + 2e-1 THEN least(1e0, pi() * {r * r:e} / (2e-1 * kx * 2e-1 * 1.1132e2)) ELSE 0e0 END) END AS weight
 FROM (SELECT p.id, p.lng, p.lat, cos(radians(p.lat)) * 1.1132e2 AS kx, s.sid, s.lng AS sx, s.lat AS sy, obscured, age_days, greatest(5e-2, coalesce(accuracy_m, 1e2) / 1000) AS acc,
   floor(s.lng / 2e-1) * 2e-1 AS x0, floor(s.lat / 2e-1) * 2e-1 AS y0 FROM v_places p JOIN {SIGHT_SQL} s ON abs(p.lng - s.lng) < {(r + 26) / 70:e} AND abs(p.lat - s.lat) < {(r + 26) / 111:e}))"""


@query("sighting_weights", f"SELECT id, sid, round(weight, 6) AS weight FROM {weights_sql(10.0)} WHERE weight > 0")
def _(d):
    w = D.sighting_weights(d.places, "id", sightings(d), "sid", 10.0)
    return w.select("id", "sid", F.round("weight", 6).alias("weight"))


def recent_sql(r):
    return f"(SELECT id, sum(weight * exp(-age_days / 14)) AS recent FROM {weights_sql(r)} WHERE age_days <= 30 AND weight > 0 GROUP BY id)"


@query("recent_sightings", f"SELECT id, round(recent, 6) AS recent FROM {recent_sql(10.0)}")
def _(d):
    return D.recent_sightings(d.places, "id", sightings(d), "sid", 10.0).select("id", F.round("recent", 6).alias("recent"))


def index_sql(x):
    lo, hi = math.log10(0.002), math.log10(3)
    return f"CAST(CASE WHEN {x} > 0 THEN greatest(1, least(100, floor(1 + 99 * (log10({x}) - ({lo!r}::DOUBLE)) / ({hi - lo!r}::DOUBLE) + 5e-1))) ELSE 1 END AS INT)"


def level_sql(i):
    return f"CASE WHEN {i} >= 70 THEN 'very-high' WHEN {i} >= 45 THEN 'high' WHEN {i} >= 20 THEN 'moderate' ELSE 'low' END"


@query("risk_index", f"SELECT cx, cy, idx AS index, {level_sql('idx')} AS level FROM (SELECT cx, cy, {index_sql('density')} AS idx FROM {DENS})")
def _(d):
    return cells(d).select("cx", "cy", R.risk_index("density").alias("index")).withColumn("level", R.risk_level("index"))


@query("assess_risk", f"""
WITH b AS (SELECT id, {SEASON_SQL} AS season, {LIGHT_SQL} AS light, {MODE_SQL} AS mf FROM {sun_sql(REQ_SQL)}),
r AS (SELECT b.id, l.density AS d1, w.density AS d10, coalesce(r1.recent, 0e0) AS rec1, coalesce(r10.recent, 0e0) AS rec10, a10.animals, season * mf * CASE light WHEN 'day' THEN 8e-1 WHEN 'twilight' THEN 1.5e0 ELSE 1.3e0 END AS s1, season * mf AS s10
  FROM b JOIN {local_sql(0.3)} l ON l.id = b.id JOIN {local_coarse_sql(3.0)} w ON w.id = b.id JOIN {area_sql(10.0)} a10 ON a10.id = b.id
  LEFT JOIN {recent_sql(1.0)} r1 ON r1.id = b.id LEFT JOIN {recent_sql(10.0)} r10 ON r10.id = b.id),
i AS (SELECT *, {index_sql('(d1 * s1 * least(3e0, 1 + 6e-1 * rec1))')} AS index1, {index_sql('(d10 * s10 * least(3e0, 1 + 6e-1 * rec10))')} AS index10 FROM r)
SELECT id, index1, {level_sql('index1')} AS level1, index10, {level_sql('index10')} AS level10, round(animals, 6) AS animals10, round(rec10, 6) AS recent10 FROM i""")
def _(d):
    out = D.assess_risk(requests(d), "id", cells(d), GRID, fine(d), listed(d), 0.02, 50, sightings(d), "sid")
    return out.select("id", "index1", "level1", "index10", "level10", F.round("animals10", 6).alias("animals10"), F.round("recent10", 6).alias("recent10"))


_HLAT = [(i, j) for j in range(-15, 16) for i in range(-15, 16) if math.hypot(i / 10, j / 10) <= 1.5 + 1e-12]
_HB = [sum(1 for i, j in _HLAT if math.hypot(i / 10, j / 10) <= r) for r in (0.5, 0.3)]


@query("habitat_factor", f"""
WITH l AS (SELECT id, i, j, sqrt(i * i + j * j) / 1e1 AS r, lng + i / 1e1 / (1.1132e2 * cos(radians(lat))) AS x, lat + j / 1e1 / 1.1132e2 AS y
  FROM (SELECT s_suppkey AS id, 2.5e1 + ((s_suppkey * 7919) % 300000) / 1e5 + 4e-2 AS lng, 4.4e1 + ((s_suppkey * 104729) % 300000) / 1e5 + 6e-2 AS lat FROM supplier),
  (VALUES {", ".join(f"({i}, {j})" for i, j in _HLAT)}) AS o(i, j)),
e AS (SELECT * FROM {SUPPLIER_EDGES}), bb AS (SELECT sid, min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM e WHERE ring = 0 GROUP BY sid),
c AS (SELECT id, i, j, r, x, y, bb.sid FROM l JOIN bb ON x BETWEEN bb.w AND bb.e AND y BETWEEN bb.s AND bb.n),
p AS (SELECT id, i, j, r, c.sid, ring, sum(CASE WHEN {Q.crosses('x', 'y', 'e.x1', 'e.y1', 'e.x2', 'e.y2')} THEN 1 ELSE 0 END) % 2 AS odd FROM c JOIN e ON e.sid = c.sid GROUP BY 1, 2, 3, 4, 5, 6),
h AS (SELECT id, i, j, r, sid FROM p GROUP BY 1, 2, 3, 4, 5 HAVING max(CASE WHEN ring = 0 THEN odd END) = 1 AND max(CASE WHEN ring = 1 THEN odd END) = 0),
u AS (SELECT id, i, j, r, bool_or(sid % 2 = 0) AS f, bool_or(sid % 2 = 1) AS b FROM h GROUP BY 1, 2, 3, 4),
g AS (SELECT s_suppkey AS id, coalesce(sum(CASE WHEN f AND r <= 5e-1 + 1e-12 THEN 1 ELSE 0 END), 0) / {_HB[0]}e0 AS fn, coalesce(sum(CASE WHEN f THEN 1 ELSE 0 END), 0) / {len(_HLAT)}e0 AS fw,
   coalesce(sum(CASE WHEN b AND r <= 3e-1 + 1e-12 THEN 1 ELSE 0 END), 0) / {_HB[1]}e0 AS bn FROM supplier LEFT JOIN u ON u.id = s_suppkey GROUP BY s_suppkey)
SELECT id, round(fn, 6) AS forest_near, round(fw, 6) AS forest_wide, round(bn, 6) AS built_near,
  round(greatest(1.5e-1, greatest(3e-1, least(2.2e0, (fn + 1.5e-1) / (fw + 1.5e-1))) * (1 - 7.5e-1 * greatest(0e0, least(1e0, (bn - 3e-1) / 6e-1)))), 6) AS factor FROM g""")
def _(d):
    rings = supplier_rings(d)
    pts = supplier_points(d).select(F.col("sid").alias("id"), (F.col("lng") + 0.04).alias("lng"), (F.col("lat") + 0.06).alias("lat"))
    out = D.habitat_factor(pts, "id", rings.where("poly_id % 2 = 0"), rings.where("poly_id % 2 = 1"))
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("forest_near", "forest_wide", "built_near", "factor")])


@query("density_zones", f"""
WITH i AS (SELECT cx, cy, CASE WHEN q > 0 THEN {index_sql('(density * 1.25)')} ELSE 0 END AS idx FROM {DENS}),
a AS (SELECT *, CASE WHEN idx <= 18 THEN 0e0 WHEN idx <= 30 THEN (idx - 18) / 1.2e1 * 1.4e-1 WHEN idx <= 50 THEN 1.4e-1 + (idx - 30) / 2e1 * (2.4e-1 - 1.4e-1) WHEN idx <= 70 THEN 2.4e-1 + (idx - 50) / 2e1 * (3.2e-1 - 2.4e-1)
   ELSE 3.2e-1 + (idx - 70) / 3e1 * (4.2e-1 - 3.2e-1) END AS alpha FROM i)
SELECT cx, cy, idx AS index, CAST(floor(alpha * 255 + 5e-1) AS INT) AS a FROM a WHERE floor(alpha * 255 + 5e-1) > 0""")
def _(d):
    return D.density_zones(d.density_cells, 1.25).select("cx", "cy", "index", "a")


# land cover pixels and modelling cells, both from the 50-column grid of parts
LAND_SQL = """(SELECT cx, cy, (cx + cy) % 5 <> 0 AS inside, (q * 3 % 101) / 1e2 AS tree, (q * 7 % 23) / 1e2 AS shrub, (q * 11 % 19) / 1e2 AS grass, (q * 13 % 31) / 1e2 AS crop, (q * 17 % 61) / 1e2 AS built,
   (q * 5 % 9) / 1e2 AS water, q * 1.0e1 AS elev, CASE WHEN (cx + cy) % 5 <> 0 THEN CAST(floor(cx / 1e1) AS INT) END AS region FROM v_density_cells)"""


def land(d):
    q, k = F.col("q"), F.col("cx") + F.col("cy")
    return d.density_cells.select("cx", "cy", (k % 5 != 0).alias("inside"), *[(q * m % n / 100.0).alias(c) for c, m, n in (
        ("tree", 3, 101), ("shrub", 7, 23), ("grass", 11, 19), ("crop", 13, 31), ("built", 17, 61), ("water", 5, 9))],
        (q * 10.0).alias("elev"), F.when(k % 5 != 0, F.floor(F.col("cx") / 10).cast("int")).alias("region"))


def shape(d):
    """Rows and columns of the dense part of the grid: one small aggregate."""
    n = d.table("part").agg(F.count(F.lit(1))).first()[0]
    return (n // 50, 50)


KX, KY = 0.77, 1.1132


@query("landcover_fractions", """
SELECT CAST(floor(cx / 5e0) AS INT) AS cx, CAST(floor(cy / 5e0) AS INT) AS cy, round(avg(CASE WHEN q % 6 = 1 THEN 1e0 ELSE 0e0 END), 6) AS tree, round(avg(CASE WHEN q % 6 IN (2, 4) THEN 1e0 ELSE 0e0 END), 6) AS open FROM v_density_cells GROUP BY 1, 2""")
def _(d):
    px = d.density_cells.select(F.col("cx").alias("ix"), F.col("cy").alias("iy"), (F.col("q") % 6).alias("cls"))
    return D.landcover_fractions(px, 5, {"tree": [1], "open": [2, 4]}).select("cx", "cy", F.round("tree", 6).alias("tree"), F.round("open", 6).alias("open"))


def _focal_sql(value, size, name, src=LAND_SQL):
    """Uniform mean by explicit offsets with reflected indices."""
    rb, ra, cb, ca = size[0] // 2, size[0] - size[0] // 2 - 1, size[1] // 2, size[1] - size[1] // 2 - 1
    return f"""(SELECT cx, cy, sum(v) / {size[0] * size[1]}e0 AS {name} FROM (SELECT c.cx, c.cy, s.{value} AS v FROM (SELECT cx, cy, n,
     CASE WHEN y < 0 THEN -1 - y WHEN y >= n THEN 2 * n - 1 - y ELSE y END AS sy, CASE WHEN x < 0 THEN -1 - x WHEN x >= 50 THEN 99 - x ELSE x END AS sx FROM (
       SELECT cx, cy, cy + oy AS y, cx + ox AS x, n FROM {src} c0, (SELECT CAST(count(*) / 50 AS INT) AS n FROM part), (SELECT unnest(range({-rb}, {ra + 1})) AS oy), (SELECT unnest(range({-cb}, {ca + 1})) AS ox))) c JOIN {src} s ON s.cx = c.sx AND s.cy = c.sy) GROUP BY cx, cy)"""


@query("focal_mean", f"SELECT cx, cy, round(m, 6) AS tree_mean FROM {_focal_sql('tree', (5, 4), 'm')}")
def _(d):
    return D.focal_mean(land(d), "tree", (5, 4), shape(d)).select("cx", "cy", F.round("tree_mean", 6).alias("tree_mean"))


def _gauss_sql(value, sigma, src=LAND_SQL):
    out = f"(SELECT cx, cy, CAST({value} AS DOUBLE) AS v FROM {src})"
    for axis, other, s in (("cy", "cx", sigma[0]), ("cx", "cy", sigma[1])):
        r = int(4 * s + 0.5)
        k = [math.exp(-0.5 * (i / s) ** 2) for i in range(-r, r + 1)]
        rows = ", ".join(f"({i}, {w / sum(k):.17e})" for i, w in zip(range(-r, r + 1), k))
        n = "50" if axis == "cx" else "n"
        out = f"""(SELECT c.{axis}, c.{other}, sum(c.w * s.v) AS v FROM (SELECT {axis}, {other}, w, CASE WHEN t < 0 THEN -1 - t WHEN t >= {n} THEN 2 * {n} - 1 - t ELSE t END AS t FROM (
          SELECT {axis}, {other}, {axis} + o AS t, w, n FROM v_density_cells, (SELECT CAST(count(*) / 50 AS INT) AS n FROM part), (VALUES {rows}) AS k(o, w))) c JOIN {out} s ON s.{axis} = c.t AND s.{other} = c.{other} GROUP BY c.{axis}, c.{other})"""
    return out


@query("focal_gauss", f"SELECT cx, cy, round(v, 6) AS tree_gauss FROM {_gauss_sql('tree', (1.5, 2.0))}")
def _(d):
    return D.focal_gauss(land(d), "tree", (1.5, 2.0), shape(d)).select("cx", "cy", F.round("tree_gauss", 6).alias("tree_gauss"))


@query("distance_to_mask", f"""SELECT c.cx, c.cy, round(min(sqrt(pow((c.cx - s.cx) * 7.7e-1, 2) + pow((c.cy - s.cy) * 1.1132, 2))), 6) AS dist_km
FROM {LAND_SQL} c, {LAND_SQL} s WHERE s.tree > 9.5e-1 GROUP BY c.cx, c.cy""")
def _(d):
    out = D.distance_to_mask(land(d), F.col("tree") > 0.95, KX, KY)
    return out.select("cx", "cy", F.round("dist_km", 6).alias("dist_km"))


@query("ruggedness", f"""SELECT a.cx, a.cy, round(sqrt(greatest(0e0, b.m2 - a.m * a.m)), 4) AS rugged FROM {_focal_sql('elev', (3, 3), 'm')} a
JOIN {_focal_sql('e2', (3, 3), 'm2', f'(SELECT cx, cy, elev * elev AS e2 FROM {LAND_SQL})')} b ON a.cx = b.cx AND a.cy = b.cy""")
def _(d):
    return D.ruggedness(land(d), "elev", shape(d)).select("cx", "cy", F.round("rugged", 4).alias("rugged"))


@query("habitat_features")
def _(d):
    out = D.habitat_features(land(d), shape(d), KX, KY)
    return out.select("cx", "cy", "inside", *[F.round(f, 6).alias(f) for f in D.HABITAT_FEATURES])


@query("assign_region", f"""
SELECT c.cx, c.cy, max(p.sid) AS region FROM v_density_cells c LEFT JOIN (SELECT cx, cy, sid FROM (
  SELECT cx, cy, sid, ring, sum(CASE WHEN {Q.crosses('2.5e1 + (cx + 5e-1) * 6e-2', '4.7e1 - (cy + 5e-1) * 6e-2', 'x1', 'y1', 'x2', 'y2')} THEN 1 ELSE 0 END) % 2 AS odd FROM v_density_cells, {SUPPLIER_EDGES} GROUP BY 1, 2, 3, 4)
  GROUP BY 1, 2, 3 HAVING max(CASE WHEN ring = 0 THEN odd END) = 1 AND max(CASE WHEN ring = 1 THEN odd END) = 0) p ON p.cx = c.cx AND p.cy = c.cy GROUP BY c.cx, c.cy HAVING max(p.sid) IS NOT NULL""")
def _(d):
    from fellwalk.operators.spatial import points_in_polygons
    pts = d.density_cells.select(F.struct("cx", "cy").alias("pid"), (25.0 + (F.col("cx") + 0.5) * 0.06).alias("lng"), (47.0 - (F.col("cy") + 0.5) * 0.06).alias("lat"))
    hit = points_in_polygons(pts, "pid", supplier_rings(d))
    return hit.groupBy("pid").agg(F.max("poly_id").alias("region")).select("pid.cx", "pid.cy", "region")


@query("suitability", f"""SELECT cx, cy, round(CASE WHEN inside THEN greatest(elev / 2.55e3, 1.5e-1 * tree * (SELECT max(elev / 2.55e3) FROM {LAND_SQL} WHERE inside)) * (1 - water) * (1 - 9.5e-1 * greatest(0e0, least(1e0, (built - 3e-1) / 4e-1))) ELSE 0e0 END, 6) AS suit FROM {LAND_SQL}""")
def _(d):
    return D.suitability(land(d).withColumn("score", F.col("elev") / 2550.0)).select("cx", "cy", F.round("suit", 6).alias("suit"))


def census(d):
    """Counts for regions 0..3; regions 1 and 2 share one count, region 4 is unlisted."""
    r = d.table("region")
    return r.where("r_regionkey < 4").select(F.when(F.col("r_regionkey") == 2, 1).otherwise(F.col("r_regionkey")).alias("group"), F.col("r_regionkey").alias("region"),
                                             F.when(F.col("r_regionkey").isin(1, 2), 50.0).otherwise(10.0 * (F.col("r_regionkey") + 1)).alias("animals"))


@query("spread_census", f"""
WITH l AS (SELECT *, elev / 2.55e3 AS suit FROM {LAND_SQL}), a AS (SELECT 7.7e-1 * 1.1132 AS area),
cen AS (SELECT CASE r_regionkey WHEN 2 THEN 1 ELSE r_regionkey END AS g, r_regionkey AS region, CASE WHEN r_regionkey IN (1, 2) THEN 5e1 ELSE 1e1 * (r_regionkey + 1) END AS animals FROM region WHERE r_regionkey < 4),
s AS (SELECT region, sum(suit * area) AS s, sum(tree * area) AS t FROM l, a WHERE region IS NOT NULL GROUP BY region),
gs AS (SELECT g, max(animals) / sum(s) AS scale FROM s JOIN cen USING (region) GROUP BY g),
sc AS (SELECT s.region, coalesce(gs.scale, 2e-3 * t / s) AS scale, gs.g IS NOT NULL AS listed FROM s LEFT JOIN cen USING (region) LEFT JOIN gs ON gs.g = cen.g),
c AS (SELECT l.cx, l.cy, l.region, l.suit, coalesce(scale, 0e0) AS sc, CASE WHEN l.region IS NULL THEN 0e0 ELSE 1e0 END AS inn, coalesce(listed, false) AS listed FROM l LEFT JOIN sc ON sc.region = l.region),
w AS (SELECT cx, cy, v FROM {_gauss_sql('inn', (3 / 1.1132, 3 / 0.77), 'c')}), x AS (SELECT cx, cy, v FROM {_gauss_sql('sc', (3 / 1.1132, 3 / 0.77), 'c')}),
d AS (SELECT c.cx, c.cy, c.region, listed, CASE WHEN c.region IS NULL THEN 0e0 ELSE x.v / greatest(w.v, 1e-6) * suit END AS raw FROM c JOIN w ON w.cx = c.cx AND w.cy = c.cy JOIN x ON x.cx = c.cx AND x.cy = c.cy)
SELECT cx, cy, round(raw * (SELECT sum(m) FROM (SELECT max(animals) AS m FROM cen GROUP BY g)) / (SELECT sum(raw * area) FROM d, a WHERE listed), 6) AS density FROM d""")
def _(d):
    c = land(d).withColumn("suit", F.col("elev") / 2550.0)
    return D.spread_census(c, census(d), shape(d), KX, KY, 3.0).select("cx", "cy", F.round("density", 6).alias("density"))


@query("fine_habitat")
def _(d):
    return D.fine_habitat(land(d), shape(d), 0.01).select("cx", "cy", F.round("h", 6).alias("h"))


@query("redistribute_fine", f"""
WITH f AS (SELECT cx, cy, CAST(floor(cx / 5e0) AS INT) AS px, CAST(floor(cy / 5e0) AS INT) AS py, tree + 1e-2 AS h FROM {LAND_SQL}),
m AS (SELECT px, py, sum(h) / 25 AS hc FROM f GROUP BY 1, 2)
SELECT f.cx, f.cy, round(h * coalesce(c.density, 0e0) / hc, 6) AS density FROM f JOIN m USING (px, py) LEFT JOIN {DENS} c ON c.cx = px AND c.cy = py""")
def _(d):
    h = land(d).select("cx", "cy", (F.col("tree") + 0.01).alias("h"))
    return D.redistribute_fine(h, cells(d).select("cx", "cy", "density")).select("cx", "cy", F.round("density", 6).alias("density"))


@query("validate_density", f"""
WITH b AS (SELECT floor(cx / 5e0) AS bx, floor(cy / 5e0) AS byy, avg(density) AS d, avg(CASE WHEN (cx + cy) % 5 <> 0 THEN 1e0 ELSE 0e0 END) AS share FROM {DENS} GROUP BY 1, 2),
h AS (SELECT DISTINCT floor(floor((lng - 25) / 6e-2) / 5e0) AS bx, floor(floor((47 - lat) / 6e-2) / 5e0) AS byy FROM {SUPPLIER_POINTS}),
r AS (SELECT round(d, 12) AS d, h.bx IS NOT NULL AS hit FROM b LEFT JOIN h USING (bx, byy) WHERE share > 5e-1)
SELECT round(sum(CASE WHEN p.d > n.d THEN 1e0 WHEN p.d = n.d THEN 5e-1 ELSE 0e0 END) / count(*), 6) AS auc, count(DISTINCT (p.k)) AS positives, count(DISTINCT (n.k)) AS negatives
FROM (SELECT d, row_number() OVER () AS k FROM r WHERE hit) p, (SELECT d, row_number() OVER () AS k FROM r WHERE NOT hit) n""")
def _(d):
    c = cells(d).withColumn("inside", (F.col("cx") + F.col("cy")) % 5 != 0)
    out = D.validate_density(c, supplier_points(d), GRID, 5)
    return out.select(F.round("auc", 6).alias("auc"), "positives", "negatives")


@query("spot_checks", f"""SELECT sid, round(avg(c.density), 8) AS density FROM (SELECT sid, CAST(floor((lng - 25) / 6e-2) AS INT) AS x, CAST(floor((47 - lat) / 6e-2) AS INT) AS y FROM {SUPPLIER_POINTS}) s
JOIN {DENS} c ON c.cx BETWEEN x - 1 AND x + 1 AND c.cy BETWEEN y - 1 AND y + 1 GROUP BY sid""")
def _(d):
    return D.spot_checks(cells(d), supplier_points(d), "sid", GRID).select("sid", F.round("density", 8).alias("density"))
