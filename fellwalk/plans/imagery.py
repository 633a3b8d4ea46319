"""Queries over scenes, composites, pyramids and training tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.operators import imagery as I
from fellwalk.plans import sqltext as Q
from fellwalk.plans.registry import query

NOW = "1999-01-01"
_SC = f"(SELECT *, cloud + 3e-1 * nodata + 8e-2 * (epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(acquired_at)) / 8.64e7 AS score, CAST(substr(id, 2) AS BIGINT) AS k FROM v_scenes)"
# scene boxes: one degree squares placed by grid
BOXED = f"(SELECT *, 25 + CAST(substr(grid, 2) AS INT) % 10 * 2.7e-1 AS w, 44 + CAST(substr(grid, 2) AS INT) / 10 * 5.3e-1 AS s, 26 + CAST(substr(grid, 2) AS INT) % 10 * 2.7e-1 AS e, 45 + CAST(substr(grid, 2) AS INT) / 10 * 5.3e-1 AS n FROM {_SC})".replace(
    "CAST(substr(grid, 2) AS INT) / 10", "CAST(floor(CAST(substr(grid, 2) AS INT) / 1e1) AS INT)")
RANKED = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grid ORDER BY score, id) AS rank FROM {BOXED}) WHERE rank <= 4)"


def boxed(d):
    g = F.substring("grid", 2, 5).cast("int")
    x, y = 25 + g % 10 * 0.27, 44 + F.floor(g / 10) * 0.53
    s = I.scene_score(d.scenes, F.lit(NOW))
    return s.withColumns({"w": x, "s": y, "e": 26 + g % 10 * 0.27, "n": 45 + F.floor(g / 10) * 0.53})


@query("scene_score", f"SELECT id, round(score, 6) AS score FROM {_SC}")
def _(d):
    return I.scene_score(d.scenes, F.lit(NOW)).select("id", F.round("score", 6).alias("score"))


@query("best_scenes_per_grid", f"SELECT grid, id, CAST(rank AS INT) AS rank FROM {RANKED}")
def _(d):
    return I.best_scenes_per_grid(boxed(d)).select("grid", "id", "rank")


_TB = f"(SELECT DISTINCT x, y, {Q.tlng('x', '9')} AS w, {Q.tlat('y + 1', '9')} AS s, {Q.tlng('x + 1', '9')} AS e, {Q.tlat('y', '9')} AS n FROM (SELECT {Q.tx('lng', '9')} AS x, {Q.ty('lat', '9')} AS y FROM v_places))"
ORDER_SQL = f"(SELECT t.x, t.y, r.id AS scene_id, row_number() OVER (PARTITION BY t.x, t.y ORDER BY rank, score, id) AS paint, acquired_at FROM {_TB} t JOIN {RANKED} r ON t.w < r.e AND t.e > r.w AND t.s < r.n AND t.n > r.s)"


def tiles9(d):
    from fellwalk.operators.spatial import with_tile, with_tile_bbox
    return with_tile_bbox(with_tile(d.places, 9).select("z", "x", "y").distinct()).drop("z")


@query("paint_order", f"SELECT x, y, scene_id, CAST(paint AS INT) AS paint FROM {ORDER_SQL}")
def _(d):
    return I.paint_order(tiles9(d), I.best_scenes_per_grid(boxed(d)))


@query("imagery_dates", f"SELECT x * 1000 + y AS view_id, epoch(max(acquired_at)) AS newest, epoch(min(acquired_at)) AS oldest FROM {ORDER_SQL} GROUP BY x, y")
def _(d):
    v = tiles9(d).withColumn("view_id", F.col("x") * 1000 + F.col("y")).drop("x", "y")
    o = I.imagery_dates(v, I.best_scenes_per_grid(boxed(d)))
    t = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")).cast("double").alias(c)
    return o.select("view_id", t("newest"), t("oldest"))


_BX = "(SELECT id AS box_id, lng - 2e-2 AS w, lat - 2e-2 AS s, lng + 2e-2 AS e, lat + 2e-2 AS n FROM v_places)"
_COV = f"(SELECT b.box_id, r.* EXCLUDE (w, s, e, n) FROM {_BX} b JOIN {BOXED} r ON r.w <= b.w AND r.s <= b.s AND r.e >= b.e AND r.n >= b.n)"


def boxes(d):
    return d.places.select(F.col("id").alias("box_id"), (F.col("lng") - 0.02).alias("w"), (F.col("lat") - 0.02).alias("s"), (F.col("lng") + 0.02).alias("e"), (F.col("lat") + 0.02).alias("n"))


@query("clearest_summer_scene", f"SELECT box_id, arg_min(id, (NOT month(acquired_at) BETWEEN 6 AND 9, cloud, -epoch(acquired_at), id)) AS scene_id FROM {_COV} WHERE nodata < 5 GROUP BY box_id")
def _(d):
    return I.clearest_summer_scene(boxes(d), boxed(d))


@query("seasonal_scenes", f"""SELECT box_id, CAST(month AS INT) AS month, id AS scene_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY -yr, cloud, id) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY box_id, month ORDER BY -yr, cloud, id) AS rn FROM (SELECT box_id, id, cloud, month(acquired_at) AS month, year(acquired_at) AS yr FROM {_COV})) WHERE rn = 1) WHERE rank <= 3""")
def _(d):
    return I.seasonal_scenes(boxes(d), boxed(d), 3)


@query("tile_pixels", f"""SELECT x, y, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(easting, 3) AS easting, round(northing, 3) AS northing FROM {Q.utm_select(f"(SELECT x, y, px, py, 35 AS zone, false AS south, {Q.tlng('x + (px + 5e-1) / 4', '9')} AS lng, {Q.tlat('y + (py + 5e-1) / 4', '9')} AS lat FROM {_TB}, (SELECT unnest(range(0, 4)) AS px), (SELECT unnest(range(0, 4)) AS py))")}""")
def _(d):
    p = I.tile_pixels(tiles9(d).select(F.lit(9).alias("z"), "x", "y"), 32635, 4)
    return p.select("x", "y", "px", "py", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"))


@query("choose_level", """SELECT id AS scene_id, CAST(coalesce(arg_max(l, 10 * pow(2, l)) FILTER (10 * pow(2e0, l) <= t * 1.01), 0) AS INT) AS level FROM (SELECT id, 5 + cloud * 3 AS t FROM v_scenes), (VALUES (0), (1), (2), (3), (4)) AS lv(l) GROUP BY id""")
def _(d):
    s = d.scenes.select(F.col("id").alias("scene_id"), (5 + F.col("cloud") * 3).alias("target_res"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"))
    return I.choose_level(s.withColumn("res", 10 * F.pow(F.lit(2.0), F.col("level")))).select("scene_id", "level")


@query("window_for", """SELECT id, CAST(greatest(0, floor((x - 300000) / 1e1) - 1) AS BIGINT) AS x0, CAST(least(1000, ceil((x + 500 - 300000) / 1e1) + 1) AS BIGINT) AS x1, CAST(greatest(0, floor((5000000 - 4996000) / 1e1) - 1) AS BIGINT) AS y0, CAST(least(1000, ceil((5000000 - 4995000) / 1e1) + 1) AS BIGINT) AS y1
FROM (SELECT id, 295000 + CAST(substr(id, 2) AS BIGINT) * 7 % 20000 AS x FROM v_scenes) WHERE least(1000, ceil((x + 500 - 300000) / 1e1) + 1) > greatest(0, floor((x - 300000) / 1e1) - 1)""")
def _(d):
    x = (295000 + F.substring("id", 2, 20).cast("long") * 7 % 20000).cast("double")
    df = d.scenes.select("id", x.alias("w"), F.lit(4995000.0).alias("s"), (x + 500).alias("e"), F.lit(4996000.0).alias("n"), F.lit(300000.0).alias("origin_x"),
                         F.lit(5000000.0).alias("origin_y"), F.lit(10.0).alias("res"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return I.window_for(df).select("id", *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1")])


# scene pixels from score cells (two bands), classes from density cells
_PX = "(SELECT CAST(cy % 3 AS INT) AS scene_id, cx AS ix, CAST(floor(cy / 3e0) AS INT) AS iy, CASE WHEN (cx + cy) % 9 = 0 THEN 0e0 ELSE 1000 + score * 5e3 END AS red, CASE WHEN (cx + cy) % 9 = 0 THEN 0e0 ELSE 1500 + (cx * 37 + cy * 11) % 2000 END AS nir FROM v_score_cells)"
_SCL = "(SELECT 1 AS scene_id, cx AS ix, cy AS iy, q % 12 AS cls FROM v_density_cells)"


def px(d):
    off = (F.col("cx") + F.col("cy")) % 9 == 0
    return d.score_cells.select((F.col("cy") % 3).alias("scene_id"), F.col("cx").alias("ix"), F.floor(F.col("cy") / 3).cast("int").alias("iy"),
                                F.when(off, 0.0).otherwise(1000 + F.col("score") * 5000).alias("red"), F.when(off, 0.0).otherwise(1500.0 + (F.col("cx") * 37 + F.col("cy") * 11) % 2000).alias("nir"))


def scl(d):
    return d.density_cells.select(F.lit(1).alias("scene_id"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), (F.col("q") % 12).alias("cls"))


@query("cloud_mask", f"SELECT p.scene_id, p.ix, p.iy FROM {_PX} p LEFT JOIN {_SCL} m ON m.scene_id = p.scene_id AND m.ix = CAST(floor(p.ix / 2e0) AS INT) AND m.iy = CAST(floor(p.iy / 2e0) AS INT) WHERE coalesce(m.cls, 0) NOT IN (1, 3, 8, 9, 10)")
def _(d):
    return I.cloud_mask(px(d), scl(d)).select("scene_id", "ix", "iy")


_PTS = "(SELECT event_id, CAST(event_id % 3 AS INT) AS scene_id, (event_id * 7919 % 10100) / 1e2 - 5e-1 AS sx, (event_id * 104729 % 3500) / 1e2 - 5e-1 AS sy FROM events)"
_SAMPLE = f"""(SELECT event_id, scene_id, CASE WHEN n = 4 THEN br ELSE nr END AS red, CASE WHEN n = 4 THEN bn ELSE nn END AS nir FROM (
  SELECT s.event_id, s.scene_id, count(*) AS n, sum(w * red) AS br, sum(w * nir) AS bn, max(CASE WHEN p.ix = floor(sx + 5e-1) AND p.iy = floor(sy + 5e-1) THEN red END) AS nr, max(CASE WHEN p.ix = floor(sx + 5e-1) AND p.iy = floor(sy + 5e-1) THEN nir END) AS nn
  FROM (SELECT *, CAST(floor(sx) AS INT) + i AS cx, CAST(floor(sy) AS INT) + j AS cy, CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END * CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END AS w FROM {_PTS}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(i, j)) s
  JOIN (SELECT * FROM {_PX} WHERE red > 0 OR nir > 0) p ON p.scene_id = s.scene_id AND p.ix = s.cx AND p.iy = s.cy GROUP BY 1, 2) WHERE n = 4 OR nr IS NOT NULL)"""


def samples(d):
    e = F.col("event_id")
    pts = d.table("events").select(e, (e % 3).cast("int").alias("scene_id"), (e * 7919 % 10100 / 1e2 - 0.5).alias("sx"), (e * 104729 % 3500 / 1e2 - 0.5).alias("sy"))
    return I.sample_scene(pts, ["event_id"], px(d), ["red", "nir"])


@query("sample_scene", f"SELECT event_id, scene_id, round(red, 6) AS red, round(nir, 6) AS nir FROM {_SAMPLE}")
def _(d):
    return samples(d).select("event_id", "scene_id", F.round("red", 6).alias("red"), F.round("nir", 6).alias("nir"))


@query("composite_tiles", f"""SELECT tile, filled, round(red_sum, 2) AS red_sum FROM (SELECT CAST(floor(p / 1.6e1) AS BIGINT) AS tile, count(*) AS filled, sum(red) AS red_sum FROM (
  SELECT event_id % 2000 AS p, arg_min(red, (event_id * 31 % 97, scene_id, event_id)) AS red FROM {_SAMPLE} GROUP BY 1) GROUP BY 1)""")
def _(d):
    s = samples(d).withColumn("p", F.col("event_id") % 2000).withColumn("paint", F.struct((F.col("event_id") * 31 % 97).alias("o"), F.col("scene_id").alias("s"), F.col("event_id").alias("e")))
    c = I.composite_tiles(s, ["p"], ["red", "nir"])
    return c.groupBy(F.floor(F.col("p") / 16).alias("tile")).agg(F.count(F.lit(1)).alias("filled"), F.round(F.sum("red"), 2).alias("red_sum"))


def _tone(v):
    return f"floor(255 * pow(greatest(0e0, least(1e0, (floor({v} + 5e-1) / 255 - 2e-2) / 8e-1)), 8.5e-1) + 5e-1)"


@query("true_color", f"""SELECT event_id, CAST(round_even(greatest(0, least(255, l + (r - l) * 1.2e0)), 0) AS INT) AS r, CAST(round_even(greatest(0, least(255, l + (b - l) * 1.2e0)), 0) AS INT) AS b FROM (SELECT *, 2.99e-1 * r + 5.87e-1 * g + 1.14e-1 * b AS l FROM (
  SELECT event_id, {_tone('event_id % 256')} AS r, {_tone('event_id * 7 % 256')} AS g, {_tone('event_id * 13 % 256')} AS b FROM events))""")
def _(d):
    e = F.col("event_id")
    p = d.table("events").select(e, (e % 256).cast("double").alias("r"), (e * 7 % 256).cast("double").alias("g"), (e * 13 % 256).cast("double").alias("b"))
    return I.true_color(p).select("event_id", "r", "b")


@query("ndvi", f"""SELECT event_id, round(v, 6) AS ndvi, CAST(greatest(0, least(255, floor((v + 2e-1) / 1.1 * 255 + 5e-1))) AS INT) AS step FROM (SELECT event_id, CASE WHEN r + n > 0 THEN (n - r) / (n + r) ELSE 0e0 END AS v FROM (
  SELECT event_id, greatest(0e0, red * 1e-4 - 1e-1) AS r, greatest(0e0, nir * 1e-4 - 1e-1) AS n FROM {_SAMPLE}))""")
def _(d):
    return I.ndvi(samples(d)).select("event_id", F.round("ndvi", 6).alias("ndvi"), "step")


@query("scene_signature", f"SELECT x, y, count(*) AS scenes FROM {ORDER_SQL} GROUP BY x, y")
def _(d):
    o = I.paint_order(tiles9(d), I.best_scenes_per_grid(boxed(d)))
    sig = I.scene_signature(o, ["x", "y"])
    return o.groupBy("x", "y").agg(F.count(F.lit(1)).alias("scenes")).join(sig.where("signature <> ''").select("x", "y"), ["x", "y"])


_T14 = f"(SELECT DISTINCT 14 AS z, {Q.tx('lng', '14')} AS x, {Q.ty('lat', '14')} AS y FROM v_places)"


def tiles14(d):
    from fellwalk.operators.spatial import with_tile
    return with_tile(d.places, 14).select("z", "x", "y").distinct()


@query("stale_tiles", f"SELECT z, x, y FROM {_T14} WHERE x % 4 <> 0 OR y % 3 = 0")
def _(d):
    cur = tiles14(d).withColumn("signature", F.concat_ws("-", "x", "y"))
    old = cur.where("x % 4 = 0").withColumn("signature", F.when(F.col("y") % 3 == 0, "old").otherwise(F.col("signature")))
    return I.stale_tiles(cur, old, ["z", "x", "y"]).select("z", "x", "y")


@query("updated_manifest", f"SELECT z, x, y, CASE WHEN x % 4 = 0 AND y % 3 <> 0 THEN 'old' ELSE 'new' END AS signature FROM {_T14} WHERE NOT (x % 4 <> 0 AND y % 5 = 0) AND NOT (x % 4 = 0 AND y % 3 = 0 AND y % 5 = 0)")
def _(d):
    cur = tiles14(d).withColumn("signature", F.lit("new"))
    old = cur.where("x % 4 = 0").withColumn("signature", F.lit("old"))
    work = cur.where("x % 4 <> 0 or y % 3 = 0").select("z", "x", "y")
    return I.updated_manifest(cur, old, work, work.where("y % 5 = 0"), ["z", "x", "y"])


@query("dirty_ancestors", f"SELECT DISTINCT CAST(p AS INT) AS z, x >> CAST(14 - p AS INT) AS x, y >> CAST(14 - p AS INT) AS y FROM {_T14}, (SELECT unnest(range(6, 14)) AS p)")
def _(d):
    return I.dirty_ancestors(tiles14(d), 6)


@query("downsample_pyramid", "SELECT 9 AS z, CAST(floor(cx / 2e0) AS BIGINT) AS px, CAST(floor(cy / 2e0) AS BIGINT) AS py, round(sum(score * a) / sum(a), 9) AS r, sum(a) / 4 AS a FROM (SELECT *, 1e0 + cx % 3 AS a FROM v_score_cells) GROUP BY 1, 2, 3")
def _(d):
    p = d.score_cells.select(F.lit(10).alias("z"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("score").alias("r"), (1.0 + F.col("cx") % 3).alias("a"))
    return I.downsample_pyramid(p, ["r"]).select("z", "px", "py", F.round("r", 9).alias("r"), "a")


@query("sampling_regions")
def _(d):
    lat = d.places.select(F.floor(F.col("lng") / 0.1).alias("gx"), F.floor(F.col("lat") / 0.1).alias("gy")).distinct()
    k = F.col("s_suppkey")
    val = d.table("supplier").select((25.0 + (k * 7919) % 300000 / 1e5).alias("lng"), (44.0 + (k * 104729) % 300000 / 1e5).alias("lat"))
    return I.sampling_regions(lat, 0.1, 0.05, 7, val, 0.15).select("gx", "gy", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


# training tiles: score cells cut into tiles of 100 x 10, line pieces across them
_TP = "(SELECT CAST(floor(cy / 1e1) AS INT) AS tile, cx AS ix, cy % 10 AS iy, score FROM v_score_cells)"


def tp(d):
    return d.score_cells.select(F.floor(F.col("cy") / 10).cast("int").alias("tile"), F.col("cx").alias("ix"), (F.col("cy") % 10).alias("iy"), "score")


def pieces(d):
    t = tp(d).select("tile").distinct()
    return t.select("tile", F.lit(2.2).alias("ax"), (F.col("tile") % 5 + 1.3).alias("ay"), F.lit(90.4).alias("bx"), (F.col("tile") % 4 + 4.1).alias("by"), (F.col("tile") % 7 == 0).alias("tunnel"),
                    F.when(F.col("tile") % 3 == 0, "river").when(F.col("tile") % 3 == 1, "stream").otherwise("dam").alias("kind"), (F.col("tile") % 4 == 0).alias("culvert"))


def _burn(cond, r):
    disc = ", ".join(f"({x}, {y})" for x, y in [(x, y) for x in range(-1, 2) for y in range(-1, 2) if x * x + y * y <= r * r + 0.25])
    return f"""(SELECT DISTINCT tile, cx + ox AS ix, cy + oy AS iy FROM (SELECT tile, CAST(floor(2.2 + (9.04e1 - 2.2e0) * i / n) AS INT) AS cx, CAST(floor(ay + (by_ - ay) * i / n) AS INT) AS cy FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (
      SELECT *, CAST(ceil(sqrt(pow(9.04e1 - 2.2e0, 2) + pow(by_ - ay, 2)) * 2) AS INT) AS n FROM (SELECT DISTINCT tile, tile % 5 + 1.3e0 AS ay, tile % 4 + 4.1e0 AS by_ FROM {_TP}) WHERE {cond}))), (VALUES {disc}) AS o(ox, oy))"""


@query("label_pixels", f"""SELECT p.tile, p.ix, p.iy, CASE WHEN b.tile IS NULL THEN 0 ELSE 1 END AS label, coalesce(m.cls, 0) NOT IN (1, 3, 8, 9, 10) AND score > 0 AS valid FROM {_TP} p LEFT JOIN {_burn('tile % 7 <> 0', 0.75)} b ON b.tile = p.tile AND b.ix = p.ix AND b.iy = p.iy
 LEFT JOIN (SELECT cy AS tile, cx AS ix, q % 4 AS iy, max(q % 12) AS cls FROM v_density_cells GROUP BY 1, 2, 3) m ON m.tile = p.tile AND m.ix = CAST(floor(p.ix / 2e0) AS INT) AND m.iy = CAST(floor(p.iy / 2e0) AS INT)""")
def _(d):
    c = d.density_cells.groupBy(F.col("cy").alias("tile"), F.col("cx").alias("ix"), (F.col("q") % 4).alias("iy")).agg(F.max(F.col("q") % 12).alias("cls"))
    return I.label_pixels(tp(d), pieces(d), c, ["score"]).select("tile", "ix", "iy", "label", "valid")


@query("water_pixels", f"SELECT p.tile, count(w.tile) AS water, count(CASE WHEN b.tile IS NOT NULL THEN w.tile END) AS overlap FROM {_TP} p LEFT JOIN {_burn('tile % 7 <> 0', 0.75)} b ON b.tile = p.tile AND b.ix = p.ix AND b.iy = p.iy LEFT JOIN {_burn('tile % 3 < 2 AND tile % 4 <> 0', 1.0)} w ON w.tile = p.tile AND w.ix = p.ix AND w.iy = p.iy GROUP BY p.tile")
def _(d):
    empty = d.density_cells.where("false").select(F.col("cy").alias("tile"), F.col("cx").alias("ix"), F.col("cy").alias("iy"), F.col("q").alias("cls"))
    w = I.water_pixels(I.label_pixels(tp(d), pieces(d), empty, ["score"]), pieces(d))
    return w.groupBy("tile").agg(F.sum("water").cast("long").alias("water"), F.sum(F.col("water") * F.col("label")).cast("long").alias("overlap"))


@query("training_tile_filter", f"SELECT CAST(tile AS STRING) AS tile, round(avg(label), 6) AS density, CASE WHEN tile IN (2, 5) THEN 'validation' ELSE 'train' END AS split FROM (SELECT tile, ix, iy, CASE WHEN (ix + iy) % (tile + 20) = 0 THEN 1e0 ELSE 0e0 END AS label FROM {_TP}) GROUP BY tile HAVING max(ix) >= 95 AND max(iy) >= 9 AND avg(label) >= 9e-3")
def _(d):
    lab = tp(d).select(F.col("tile").cast("string").alias("tile"), "ix", ((F.col("iy") + 1) * 10 - 1).alias("iy"), F.when((F.col("ix") + F.col("iy")) % (F.col("tile") + 20) == 0, 1).otherwise(0).alias("label"))
    return I.training_tile_filter(lab, ["2", "5"]).select("tile", F.round("density", 6).alias("density"), "split")


def _eval_sql(ts):
    return f"""
WITH p AS (SELECT t, tile, ix, iy FROM {_TP}, (VALUES {', '.join(f'({t:e})' for t in ts)}) AS v(t) WHERE score >= t), l AS (SELECT tile, ix, iy FROM {_TP} WHERE (ix * 3 + iy * 7 + tile) % 19 = 0), w AS (SELECT tile, ix, iy FROM {_TP} WHERE (ix + iy) % 4 = 0),
nl AS (SELECT DISTINCT tile, ix + a AS ix, iy + b AS iy FROM l, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)), np AS (SELECT DISTINCT t, tile, ix + a AS ix, iy + b AS iy FROM p, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)),
a AS (SELECT t, count(*) AS n, count(nl.tile) AS hit, count(CASE WHEN nl.tile IS NULL THEN w.tile END) AS stream FROM p LEFT JOIN nl USING (tile, ix, iy) LEFT JOIN w USING (tile, ix, iy) GROUP BY t),
b AS (SELECT v.t, count(*) AS n, count(np.tile) AS found FROM l CROSS JOIN (VALUES {', '.join(f'({t:e})' for t in ts)}) AS v(t) LEFT JOIN np ON np.t = v.t AND np.tile = l.tile AND np.ix = l.ix AND np.iy = l.iy GROUP BY v.t),
m AS (SELECT b.t, coalesce(hit * 1e0 / a.n, 0e0) AS pr, found * 1e0 / b.n AS rc, coalesce(stream * 1e0 / a.n, 0e0) AS cf FROM b LEFT JOIN a ON a.t = b.t), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0e0 END AS f1 FROM m)
SELECT t, round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1, round(cf, 6) AS confusion{", t = (SELECT arg_max(t, (f1, -t)) FROM f) AS best" if len(ts) > 1 else ""} FROM f"""


def _eval(d, ts):
    lab, wat = tp(d).where("(ix * 3 + iy * 7 + tile) % 19 = 0"), tp(d).where("(ix + iy) % 4 = 0")
    p = tp(d).withColumnRenamed("score", "prob")
    out = I.threshold_sweep(p, lab, wat, ts) if len(ts) > 1 else I.detector_eval(p, lab, wat, ts[0])
    rest = [c for c in out.columns if c in ("t", "best")]
    return out.select(*rest, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "confusion")])


@query("detector_eval", _eval_sql([0.1]))
def _(d):
    return _eval(d, [0.1])


@query("threshold_sweep", _eval_sql([0.02, 0.1, 0.2, 0.3]))
def _(d):
    return _eval(d, [0.02, 0.1, 0.2, 0.3])
