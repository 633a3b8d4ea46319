"""Queries over trace heat, cell morphology, skeletons, alignment and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.operators import detect as X
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.spatial import line_segments
from fellwalk.plans import sqltext as Q
from fellwalk.plans.geo import SUPPLIER_POINTS, WAY_POINTS_SQL
from fellwalk.plans.registry import query

BOXES = [(1, 25.0, 45.0, 25.005, 45.005), (2, 25.005, 45.0, 25.01, 45.005)]  # scan boxes of the runs


def scans(d):
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(b, ("scan_id", "w", "s", "e", "n"))]) for b in BOXES])
    return d.spark.range(1).select(F.inline(rows))


def _my(lat):
    return f"6.378137e6 * ln(tan(pi() / 4 + radians({lat}) / 2))"


def grids_sql(cell):
    rows = ", ".join(f"({b[0]}, {b[1]:e}, {b[2]:e}, {b[3]:e}, {b[4]:e})" for b in BOXES)
    return f"""(SELECT *, CAST(ceil((6.378137e6 * radians(e) - x0) / step) AS INT) AS width, CAST(ceil((y1 - {_my('s')}) / step) AS INT) AS height FROM (
  SELECT *, 6.378137e6 * radians(w) AS x0, {_my('n')} AS y1, {cell:e} / cos(radians((s + n) / 2)) AS step FROM (VALUES {rows}) AS b(scan_id, w, s, e, n)))"""


TSEG_SQL = f"""(SELECT trace_id, seq, ax, ay, lng AS bx, lat AS by_, d, d / dt AS v FROM (SELECT *, {Q.hav('ax', 'ay', 'lng', 'lat')} AS d, t_s - pt AS dt FROM (
   SELECT *, lag(lng) OVER w AS ax, lag(lat) OVER w AS ay, lag(t_s) OVER w AS pt FROM v_trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) WHERE ax IS NOT NULL) WHERE d >= 5e-1 AND d <= 60 AND d / dt <= 40)"""
# mapped trails of the scans: one short line per supplier
WSEG_SQL = """(SELECT s_suppkey AS way_id, 2.5e1 + (s_suppkey * 7919 % 20000) / 1e6 AS ax, 4.5e1 + (s_suppkey * 104729 % 15000) / 1e6 AS ay, 2.5e1 + (s_suppkey * 7919 % 20000) / 1e6 + 6e-4 AS bx, 4.5e1 + (s_suppkey * 104729 % 15000) / 1e6 + 4e-4 AS by_ FROM supplier)"""


def way_lines(d):
    k = F.col("s_suppkey")
    x, y = 25.0 + (k * 7919 % 20000) / 1e6, 45.0 + (k * 104729 % 15000) / 1e6
    v = F.array(F.struct(F.lit(0).alias("seq"), x.alias("lng"), y.alias("lat")), F.struct(F.lit(1).alias("seq"), (x + 6e-4).alias("lng"), (y + 4e-4).alias("lat")))
    return d.table("supplier").select(k.alias("way_id"), F.explode(v).alias("v")).select("way_id", "v.*").withColumn("node_id", F.col("way_id") * 10 + F.col("seq"))


def way_segments(d):
    return line_segments(way_lines(d), "way_id").drop("seq")


def visits_sql(seg, cell, keep=""):
    """Cells visited in half-cell steps per scan."""
    fx, fy = "(6.378137e6 * radians({0}) - x0) / step", f"(y1 - {_my('{0}')}) / step"
    return f"""(SELECT scan_id{keep}, CAST(floor(fax + (fbx - fax) * i / n) AS INT) AS cx, CAST(floor(fay + (fby - fay) * i / n) AS INT) AS cy, width, height FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (
   SELECT *, greatest(1, CAST(ceil(sqrt(pow(fbx - fax, 2) + pow(fby - fay, 2)) * 2) AS INT)) AS n FROM (SELECT s.*, g.scan_id, width, height, {fx.format('ax')} AS fax, {fy.format('ay')} AS fay, {fx.format('bx')} AS fbx, {fy.format('by_')} AS fby
   FROM {seg} s JOIN {grids_sql(cell)} g ON least(ax, bx) <= e + 2e-3 AND greatest(ax, bx) >= w - 2e-3 AND least(ay, by_) <= n + 2e-3 AND greatest(ay, by_) >= s.ay * 0 + g.s - 2e-3))))"""


def _disc(r):
    return "(VALUES " + ", ".join(f"({x}, {y})" for x, y in X.disc(r)) + ") AS o(ox, oy)"


def raster_sql(seg, cell, radius):
    return f"""(SELECT DISTINCT scan_id, cx + ox AS cx, cy + oy AS cy FROM (SELECT DISTINCT * FROM {visits_sql(seg, cell)}), {_disc(radius / cell)} WHERE cx + ox >= 0 AND cy + oy >= 0 AND cx + ox < width AND cy + oy < height)"""


HEAT_SQL = f"""(SELECT scan_id, cx + ox AS cx, cy + oy AS cy, count(DISTINCT trace_id) AS heat, sum(v) AS speed_sum, count(v) AS speed_n FROM {visits_sql(TSEG_SQL, 4.0, ', trace_id, v')}, {_disc(2.0)}
   WHERE cx + ox >= 0 AND cy + oy >= 0 AND cx + ox < width AND cy + oy < height GROUP BY 1, 2, 3)"""


def heat(d):
    g = X.make_grids(scans(d), 4.0)
    return g, X.trace_heat(X.to_scans(X.trace_segments(d.trace_points), scans(d)), g, 4.0)


@query("trace_segments", f"SELECT trace_id, seq, round(d, 3) AS d, round(v, 6) AS v FROM {TSEG_SQL}")
def _(d):
    return X.trace_segments(d.trace_points).select("trace_id", "seq", F.round("d", 3).alias("d"), F.round("v", 6).alias("v"))


@query("rasterize_lines", f"SELECT * FROM {raster_sql(TSEG_SQL, 4.0, 8.0)}")
def _(d):
    return X.rasterize_lines(X.to_scans(X.trace_segments(d.trace_points), scans(d)), X.make_grids(scans(d), 4.0), 8.0, 4.0)


@query("trace_heat", f"SELECT scan_id, cx, cy, heat, round(speed_sum, 4) AS speed_sum, speed_n FROM {HEAT_SQL}")
def _(d):
    return heat(d)[1].select("scan_id", "cx", "cy", "heat", F.round("speed_sum", 4).alias("speed_sum"), "speed_n")


@query("known_mask", f"SELECT 20 AS radius_m, * FROM {raster_sql(WSEG_SQL, 4.0, 20.0)} UNION ALL SELECT 40, * FROM {raster_sql(WSEG_SQL, 4.0, 40.0)}")
def _(d):
    g, s = X.make_grids(scans(d), 4.0), X.to_scans(way_segments(d), scans(d))
    a, b = (X.rasterize_lines(s, g, r, 4.0).select(F.lit(int(r)).alias("radius_m"), *X.KEY) for r in (20.0, 40.0))
    return a.unionByName(b)


@query("candidate_cells", f"SELECT scan_id, cx, cy FROM {HEAT_SQL} h WHERE heat >= 2 AND NOT EXISTS (SELECT 1 FROM {raster_sql(WSEG_SQL, 4.0, 20.0)} k WHERE k.scan_id = h.scan_id AND k.cx = h.cx AND k.cy = h.cy)")
def _(d):
    g, h = heat(d)
    return X.candidate_cells(h, X.rasterize_lines(X.to_scans(way_segments(d), scans(d)), g, 20.0, 4.0), 2)


# score cells: 100 columns wide
MASK = "(SELECT cx, cy, score FROM v_score_cells WHERE (cx * 7 + cy * 13 + CAST(floor(score * 5e2) AS INT)) % 10 < 4)"


def mask(d):
    on = (F.col("cx") * 7 + F.col("cy") * 13 + F.floor(F.col("score") * 500).cast("int")) % 10 < 4
    return d.score_cells.where(on).select(F.lit(1).alias("scan_id"), "cx", "cy", "score")


def mask_grid(d):
    n = d.table("events").agg(F.ceil(F.count(F.lit(1)) / 100).cast("int")).scalar()
    return d.spark.range(1).select(F.lit(1).alias("scan_id"), F.lit(100).alias("width"), n.alias("height"))


_H = "(SELECT CAST(ceil(count(*) / 1e2) AS INT) AS h FROM events)"
_DIL = f"(SELECT DISTINCT cx + ox AS cx, cy + oy AS cy FROM {MASK}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(ox, oy), {_H} WHERE cx + ox BETWEEN 0 AND 99 AND cy + oy >= 0 AND cy + oy < h)"


@query("dilate", f"SELECT cx, cy FROM {_DIL}")
def _(d):
    return X.dilate(mask(d), mask_grid(d)).select("cx", "cy")


def _erode_sql(src):
    return f"(SELECT x AS cx, y AS cy FROM (SELECT cx + ox AS x, cy + oy AS y FROM {src}, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS o(ox, oy)), {_H} WHERE x > 0 AND x < 99 AND y > 0 AND y < h - 1 GROUP BY x, y HAVING count(*) = 5)"


@query("erode", f"SELECT * FROM {_erode_sql(MASK)}")
def _(d):
    return X.erode(mask(d).select(*X.KEY), mask_grid(d)).select("cx", "cy")


@query("close_gaps", f"SELECT * FROM {_erode_sql(_DIL)}")
def _(d):
    return X.close(mask(d).select(*X.KEY), mask_grid(d)).select("cx", "cy")


# smallest cell number (cy * 100 + cx) of every component, passed on from neighbour to neighbour
_LABELS = """WITH RECURSIVE m AS (SELECT *, cy * 100 + cx AS v FROM {m}),
e AS (SELECT a.v AS a, b.v AS b FROM m a JOIN m b ON b.cx = a.cx + 1 AND b.cy = a.cy UNION ALL SELECT a.v, b.v FROM m a JOIN m b ON b.cx = a.cx - 1 AND b.cy = a.cy + 1
  UNION ALL SELECT a.v, b.v FROM m a JOIN m b ON b.cx = a.cx AND b.cy = a.cy + 1 UNION ALL SELECT a.v, b.v FROM m a JOIN m b ON b.cx = a.cx + 1 AND b.cy = a.cy + 1),
n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(v, l) USING KEY (v) AS (SELECT v, v FROM m UNION SELECT n.b, min(r.l) FROM r JOIN n ON n.a = r.v JOIN recurring.r AS o ON o.v = n.b WHERE r.l < o.l GROUP BY n.b)"""
_ALLOWED = f"(SELECT * FROM {MASK} WHERE score >= 2e-2 AND (cx + cy) % 6 <> 0)"


@query("components", _LABELS.format(m=MASK) + " SELECT cx, cy, CAST(l AS BIGINT) AS label FROM r JOIN m USING (v)")
def _(d):
    return X.components(mask(d)).select("cx", "cy", (F.col("label.cy") * 100 + F.col("label.cx")).cast("long").alias("label"))


@query("remove_small", _LABELS.format(m=MASK) + " SELECT cx, cy FROM r JOIN m USING (v) QUALIFY count(*) OVER (PARTITION BY l) >= 5")
def _(d):
    return X.remove_small(mask(d), 5).select("cx", "cy")


@query("hysteresis", _LABELS.format(m=_ALLOWED) + " SELECT cx, cy FROM r JOIN m USING (v) QUALIFY max(score) OVER (PARTITION BY l) >= 3e-1")
def _(d):
    return X.hysteresis(mask(d), 0.02, 0.3, mask(d).where("(cx + cy) % 6 = 0").select(*X.KEY)).select("cx", "cy")


def _thick(d):
    return X.dilate(mask(d).select(*X.KEY), mask_grid(d))


@query("skeletonize")
def _(d):
    return X.skeletonize(_thick(d), mask_grid(d)).select("cx", "cy")


@query("trace_skeleton")
def _(d):
    return X.trace_skeleton(X.skeletonize(_thick(d), mask_grid(d))).select("chain", "seq", "cx", "cy")


def _stripes(d):
    """Chains cut from the score rows: one per row and 20 columns."""
    return d.score_cells.select(F.concat_ws(":", F.col("cy").cast("string"), F.floor(F.col("cx") / 20).cast("string")).alias("chain"),
                                (F.col("cx") % 20).alias("seq"), F.lit(1).alias("scan_id"), "cx", "cy", "score")


@query("drop_parallel", f"""SELECT chain, count(*) AS cells FROM (SELECT concat(CAST(s.cy AS STRING), ':', CAST(CAST(floor(s.cx / 2e1) AS INT) AS STRING)) AS chain, m.cx IS NOT NULL AS near FROM v_score_cells s LEFT JOIN {_DIL} m ON m.cx = s.cx AND m.cy = s.cy)
GROUP BY chain HAVING avg(CASE WHEN near THEN 1e0 ELSE 0e0 END) < 6e-1""")
def _(d):
    out = X.drop_parallel(_stripes(d), X.dilate(mask(d), mask_grid(d)))
    return out.groupBy("chain").agg(F.count(F.lit(1)).alias("cells"))


@query("chain_usage", """SELECT chain, coalesce(round(v, 6), -1e0) AS v, coalesce(CASE WHEN v < 8 / 3.6e0 THEN 'foot' WHEN v < 32 / 3.6e0 THEN 'bike' WHEN v IS NOT NULL THEN 'vehicle' END, '') AS usage FROM (
 SELECT concat(CAST(cy AS STRING), ':', CAST(CAST(floor(cx / 2e1) AS INT) AS STRING)) AS chain, sum(CASE WHEN cy % 7 <> 0 THEN score * 30 * (cx % 3) END) / nullif(sum(CASE WHEN cy % 7 <> 0 THEN cx % 3 END), 0) AS v FROM v_score_cells GROUP BY 1)""")
def _(d):
    s = _stripes(d)
    heat_ = s.where("cy % 7 <> 0").select(*X.KEY, (F.col("score") * 30 * (F.col("cx") % 3)).alias("speed_sum"), (F.col("cx") % 3).alias("speed_n"))
    return X.chain_usage(s, heat_).select("chain", F.coalesce(F.round("v", 6), F.lit(-1.0)).alias("v"), F.coalesce("usage", F.lit("")).alias("usage"))


def _gps(d):
    nodes = way_lines(d).select("node_id", "lng", "lat")
    return X.detect_from_traces(d.trace_points, scans(d), way_segments(d), nodes)


@query("detect_from_traces")
def _(d):
    lines, info = _gps(d)
    n = lines.groupBy("chain").agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.when(F.col("node_id") > 0, 1).otherwise(0)).alias("snapped"))
    return info.join(n, "chain").select("chain", F.round("length_m", 2).alias("length_m"), F.round("confidence", 6).alias("confidence"), "usage", "vertices", "snapped")


EPSG, OX, OY, RES, PW, PH = 32635, 342300.0, 4985100.0, 10.0, 200, 120  # raster placed over the scan boxes


def prob_pixels(d):
    """Ridges of high probability with noise from the events table."""
    e = d.table("events").groupBy((F.col("event_id") % (PW * PH)).alias("p")).agg(F.max("value").alias("v"))
    ix, iy = (F.col("p") % PW).cast("int"), F.floor(F.col("p") / PW).cast("int")
    ridge = F.when((iy % 12 == 5) | (ix % 40 == 20), 0.9).otherwise(0.05)
    return e.select(ix.alias("ix"), iy.alias("iy"), F.least(F.lit(1.0), ridge + F.col("v") % 7 / 100).alias("prob"))


_PROB = f"(SELECT CAST(p % {PW} AS INT) AS ix, CAST(floor(p / {PW}e0) AS INT) AS iy, least(1e0, CASE WHEN CAST(floor(p / {PW}e0) AS INT) % 12 = 5 OR p % {PW} % 40 = 20 THEN 9e-1 ELSE 5e-2 END + v % 7 / 1e2) AS prob FROM (SELECT event_id % {PW * PH} AS p, max(value) AS v FROM events GROUP BY 1))"


def _scores(d):
    g = X.make_grids(scans(d), 5.0)
    return g, X.resample_probability(g, prob_pixels(d), EPSG, OX, OY, RES)


_CENTRES = f"""(SELECT scan_id, cx, cy, degrees((x0 + (cx + 5e-1) * step) / 6.378137e6) AS lng, degrees(2 * atan(exp((y1 - (cy + 5e-1) * step) / 6.378137e6)) - pi() / 2) AS lat, 35 AS zone, false AS south
  FROM (SELECT *, unnest(range(0, width)) AS cx FROM (SELECT *, unnest(range(0, height)) AS cy FROM {grids_sql(5.0)})))"""


@query("resample_probability", f"""SELECT scan_id, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, round(prob, 6) AS score FROM (
 SELECT scan_id, cx, cy, CAST(floor((easting - {OX:e}) / {RES:e}) AS INT) AS ix, CAST(floor(({OY:e} - northing) / {RES:e}) AS INT) AS iy FROM {Q.utm_select(_CENTRES)}) JOIN {_PROB} USING (ix, iy)""")
def _(d):
    return _scores(d)[1].select(*X.KEY, F.round("score", 6).alias("score"))


@query("align_ways")
def _(d):
    k = F.col("s_suppkey")
    x, y = 25.001 + (k * 7919 % 8000) / 1e6, 45.0005 + (k * 104729 % 8000) / 1e6
    v = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.alias("seq"), (x + i * 2e-4).alias("lng"), (y + (i % 2) * 1e-5).alias("lat")))
    ways = d.table("supplier").select(k.alias("way_id"), F.explode(v).alias("v")).select("way_id", "v.*").withColumn("node_id", F.col("way_id") * 100 + F.col("seq"))
    out = X.align_ways(ways, prob_pixels(d), EPSG, OX, OY, RES, PW, PH)
    return out.select("way_id", "seq", F.round("lng", 7).alias("lng"), F.round("lat", 7).alias("lat"), F.round("shift_m", 3).alias("shift_m"), F.round("support", 6).alias("support"))


# straight detections beside each other: every supplier has a GPS line, every second an imagery line 10 or 60 m north
def _pair_lines(d, imagery):
    k = F.col("s_suppkey")
    p = d.table("supplier").where("s_suppkey % 2 = 0") if imagery else d.table("supplier")
    x, y = 25.0 + (k * 7919) % 300000 / 1e5, 44.0 + (k * 104729) % 300000 / 1e5
    y = y + (F.when(k % 4 == 0, 9e-5).otherwise(5.4e-4) if imagery else 0.0)
    v = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(i.alias("seq"), (x + i * 4e-4).alias("lng"), y.alias("lat")))
    info = p.select(k.alias("way_id"), ((k % 7) / 10 + (0.2 if imagery else 0.1)).alias("confidence"))
    return info, p.select(k.alias("way_id"), F.explode(v).alias("v")).select("way_id", "v.*")


@query("merge_detections", f"""
WITH g AS (SELECT sid, lng, lat, (sid % 7) / 1e1 + 1e-1 AS conf FROM {SUPPLIER_POINTS}), i AS (SELECT sid, lng, lat + CASE WHEN sid % 4 = 0 THEN 9e-5 ELSE 5.4e-4 END AS lat, (sid % 7) / 1e1 + 2e-1 AS conf FROM {SUPPLIER_POINTS} WHERE sid % 2 = 0),
s AS (SELECT sid, x, lat FROM (SELECT sid, lat, n, lng + j * 4e-4 + 4e-4 * unnest(range(0, n)) / n AS x FROM (SELECT sid, lng, lat, j, greatest(1, CAST(ceil({Q.hav('lng + j * 4e-4', 'lat', 'lng + (j + 1) * 4e-4', 'lat')} / 1e1) AS INT)) AS n FROM i, (VALUES (0), (1), (2)) AS o(j)))
   UNION ALL SELECT sid, lng + 1.2e-3, lat FROM i),
a AS (SELECT s.sid AS im, g.sid AS gid FROM s JOIN g ON abs(s.lat - g.lat) < 1e-3 AND abs(s.x - g.lng) < 5e-3 GROUP BY 1, 2
   HAVING sum(CASE WHEN sqrt(pow((x - least(greatest(x, g.lng), g.lng + 1.2e-3)) * 1.1132e5 * cos(radians(s.lat)), 2) + pow((s.lat - g.lat) * 1.1054e5, 2)) <= 25 THEN 1e0 ELSE 0e0 END) >= 5e-1 * any_value((SELECT count(*) FROM s z WHERE z.sid = s.sid)))
SELECT g.sid AS way_id, round(1 - (1 - g.conf) * coalesce(exp(sum(ln(1 - i.conf))), 1e0), 6) AS confidence, CASE WHEN count(i.sid) > 0 THEN 'gps;imagery' ELSE 'gps' END AS source FROM g LEFT JOIN a ON a.gid = g.sid LEFT JOIN i ON i.sid = a.im GROUP BY g.sid, g.conf
UNION ALL SELECT sid, round(conf, 6), 'imagery' FROM i WHERE sid NOT IN (SELECT im FROM a)""")
def _(d):
    out = X.merge_detections(*_pair_lines(d, False), *_pair_lines(d, True))
    return out.select("way_id", F.round("confidence", 6).alias("confidence"), "source")


@query("discovery_summary", f"""SELECT way_id % 3 AS scan_id, CASE WHEN way_id % 2 = 0 THEN 'gps' ELSE 'imagery' END AS source, count(*) AS trails, round(sum({Q.hav('ax', 'ay', 'bx', 'by_')}), 3) AS length_m FROM {WSEG_SQL} GROUP BY 1, 2""")
def _(d):
    t = d.table("supplier").select(F.col("s_suppkey").alias("way_id"), (F.col("s_suppkey") % 3).alias("scan_id"), F.when(F.col("s_suppkey") % 2 == 0, "gps").otherwise("imagery").alias("source"))
    return X.discovery_summary(t, way_lines(d)).withColumn("length_m", F.round("length_m", 3))


@query("nearby_ways", f"""SELECT DISTINCT b.scan_id, v.way_id FROM {WAY_POINTS_SQL} v, {grids_sql(4.0)} b WHERE lng > w - 2e-3 AND lng < e + 2e-3 AND lat > s - 2e-3 AND lat < n + 2e-3""")
def _(d):
    return X.nearby_ways(d.way_points, scans(d))


_PG = "(SELECT s_suppkey AS raster_id, 40 + s_suppkey % 9 * 37 AS w, 30 + s_suppkey % 7 * 53 AS h FROM supplier)"


def _rasters(d):
    k = F.col("s_suppkey")
    return d.table("supplier").select(k.alias("raster_id"), (40 + k % 9 * 37).cast("int").alias("w"), (30 + k % 7 * 53).cast("int").alias("h"))


@query("patch_grid", f"""
WITH r AS (SELECT *, least(128, CAST(ceil(w / 8e0) AS INT) * 8) AS pw, least(128, CAST(ceil(h / 8e0) AS INT) * 8) AS ph FROM {_PG}),
p AS (SELECT *, unnest(range(0, w, 80)) AS x0 FROM (SELECT *, unnest(range(0, h, 80)) AS y0 FROM r)),
q AS (SELECT *, greatest(0, least(x0 - 24, w - pw)) AS px, greatest(0, least(y0 - 24, h - ph)) AS py FROM p)
SELECT raster_id, CAST(count(*) AS BIGINT) AS patches, CAST(sum((least(x0 + 80, px + pw, w) - greatest(x0, px)) * (least(y0 + 80, py + ph, h) - greatest(y0, py))) AS BIGINT) AS owned, CAST(sum(px * 3 + py) AS BIGINT) AS checksum FROM q GROUP BY raster_id""")
def _(d):
    p = X.patch_grid(_rasters(d), 128, 24)
    owned = (F.col("x1") - F.col("ox")) * (F.col("y1") - F.col("oy"))
    return p.groupBy("raster_id").agg(F.count(F.lit(1)).alias("patches"), F.sum(owned.cast("long")).alias("owned"), F.sum((F.col("px") * 3 + F.col("py")).cast("long")).alias("checksum"))


def mean_scorer(batches):
    """A stand-in scorer: ten times the first band."""
    for b in batches:
        out = b[["raster_id", "x0", "y0", "pos"]].copy()
        out["logits"] = [v * 10.0 for v in b["b0"]]
        yield out


@query("score_patches", """SELECT CAST(event_id % 100 AS INT) AS ix, CAST(floor(event_id / 1e2) AS INT) AS iy, round(1 / (1 + exp(-1e1 * (value / 5e2 - 2e-1))), 6) AS prob FROM events""")
def _(d):
    n = d.table("events").agg(F.ceil(F.count(F.lit(1)) / 100).cast("int")).scalar()
    r = d.spark.range(1).select(F.lit(0).cast("long").alias("raster_id"), F.lit(100).alias("w"), n.alias("h"))
    px = d.score_cells.select(F.lit(0).cast("long").alias("raster_id"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), (F.col("score") - 0.2).alias("b0"))
    out = X.score_patches(cut(X.patch_grid(r, 64, 8)), px, ["b0"], mean_scorer, 64)
    return out.select("ix", "iy", F.round("prob", 6).alias("prob"))


@query("normalize_bands", "SELECT event_id, round(greatest(0e0, least(5e-1, value * 2e1 * 1e-4 - 1e-1)) / 2.5e-1 - 1, 6) AS red FROM events")
def _(d):
    px = d.table("events").select("event_id", (F.col("value") * 20).alias("red"))
    return X.normalize_bands(px, ["red"]).select("event_id", F.round("red", 6).alias("red"))


