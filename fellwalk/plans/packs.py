"""Queries over tile packages and trail reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.operators import packs as P
from fellwalk.operators.spatial import COUNTRY_OUTLINE, line_length
from fellwalk.plans import sqltext as Q
from fellwalk.plans.geo import SUPPLIER_POINTS, WAY_POINTS_SQL, supplier_points
from fellwalk.plans.registry import query
from fellwalk.plans.trails import TRAILS_SQL, trails

_K = "CASE sid % 5 WHEN 0 THEN 'country' WHEN 1 THEN 'area' ELSE 'mountains' END"
PACKS_SQL = f"(SELECT sid AS pack_id, {_K} AS kind, lng - 1e-1 AS w, lat - 1e-1 AS s, lng + 1e-1 AS e, lat + 1e-1 AS n, CAST(9 + sid % 4 AS INT) AS max_zoom FROM {SUPPLIER_POINTS})"
_LAYERS = [("imagery", 9, 13), ("terrain", 8, 11)]


def packs(d):
    k = F.col("sid")
    layers = F.array(*[F.struct(F.lit(l).alias("layer"), F.lit(a).alias("z0"), F.lit(b).alias("z1")) for l, a, b in _LAYERS])
    return supplier_points(d).select(k.alias("pack_id"), F.when(k % 5 == 0, "country").when(k % 5 == 1, "area").otherwise("mountains").alias("kind"),
                                     (F.col("lng") - 0.1).alias("w"), (F.col("lat") - 0.1).alias("s"), (F.col("lng") + 0.1).alias("e"), (F.col("lat") + 0.1).alias("n"),
                                     (9 + k % 4).cast("int").alias("max_zoom"), layers.alias("layers"))


_EDGES = ", ".join(f"({a[0]:e}, {a[1]:e}, {b[0]:e}, {b[1]:e})" for a, b in zip(COUNTRY_OUTLINE, COUNTRY_OUTLINE[1:]))
_ZL = ", ".join(f"('{l}', {z})" for l, a, b in [*_LAYERS, ("cells", 11, 11)] for z in range(a, b + 1))
_RAW = f"""(SELECT pack_id, kind, layer, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM (SELECT pack_id, kind, layer, z, {Q.tx('w', 'z')} AS x0, CAST(floor({Q.txf('e', 'z')} - 1e-9) AS INT) AS x1,
   {Q.ty('n', 'z')} AS y0, CAST(floor({Q.tyf('s', 'z')} - 1e-9) AS INT) AS y1 FROM {PACKS_SQL}, (VALUES {_ZL}) AS zl(layer, z))))"""
TILES_CTE = f"""raw AS MATERIALIZED (SELECT * FROM {_RAW}), ct AS (SELECT DISTINCT z, x, y FROM raw WHERE kind = 'country'),
bb AS (SELECT z, x, y, {Q.tlng('x', 'z')} - 2e-2 AS w, {Q.tlng('x + 1', 'z')} + 2e-2 AS e, {Q.tlat('y + 1', 'z')} - 2e-2 AS s, {Q.tlat('y', 'z')} + 2e-2 AS n FROM ct),
sm AS (SELECT z, x, y, i, j, w + (e - w) * i / 4e0 AS px, s + (n - s) * j / 4e0 AS py FROM bb, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)),
ins AS (SELECT DISTINCT z, x, y FROM (SELECT z, x, y, i, j FROM sm, (VALUES {_EDGES}) AS o(x1, y1, x2, y2) GROUP BY 1, 2, 3, 4, 5 HAVING sum(CASE WHEN {Q.crosses('px', 'py', 'x1', 'y1', 'x2', 'y2')} THEN 1 ELSE 0 END) % 2 = 1)),
tiles AS MATERIALIZED (SELECT * FROM raw WHERE kind <> 'country' OR (z, x, y) IN (SELECT (z, x, y) FROM ins))"""
_PLAN = "SELECT pack_id, kind, count(*) AS tiles, CAST(sum(CASE WHEN layer = 'imagery' AND z > 11 THEN 1 ELSE 0 END) AS BIGINT) AS rendered, round(sum(CASE layer WHEN 'imagery' THEN 26 WHEN 'terrain' THEN 70 ELSE 90 END) / 1.024e3, 6) AS estimate_mb FROM tiles GROUP BY pack_id, kind"


@query("plan_packs", f"WITH {TILES_CTE} {_PLAN}")
def _(d):
    return P.plan_packs(P.pack_tiles(packs(d)), 11).select("pack_id", "kind", "tiles", "rendered", F.round("estimate_mb", 6).alias("estimate_mb"))


@query("oversized", f"WITH a AS (SELECT s_suppkey AS pack_id, (s_suppkey * 171) % 9000 AS tiles, CASE WHEN s_suppkey % 2 = 0 THEN 'area' ELSE 'city' END AS kind FROM supplier) SELECT pack_id, tiles FROM a WHERE kind = 'area' AND tiles > 4000")
def _(d):
    k = F.col("s_suppkey")
    p = d.table("supplier").select(k.alias("pack_id"), (k * 171 % 9000).alias("tiles"), F.when(k % 2 == 0, "area").otherwise("city").alias("kind"))
    return P.oversized(p).select("pack_id", "tiles")


@query("missing_tiles", f"WITH {TILES_CTE} SELECT pack_id, count(*) AS missing FROM tiles WHERE (x + y) % 3 <> 0 OR layer = 'terrain' GROUP BY pack_id")
def _(d):
    t = P.pack_tiles(packs(d))
    inv = t.where("(x + y) % 3 = 0 and layer <> 'terrain'").select("layer", "z", "x", "y").distinct()
    return P.missing_tiles(t, inv).groupBy("pack_id").agg(F.count(F.lit(1)).alias("missing"))


@query("removable_tiles", f"""
WITH inv AS (SELECT DISTINCT 12 - CAST(k % 3 AS INT) AS z, {Q.tx('lng', '(12 - k % 3)')} AS x, {Q.ty('lat', '(12 - k % 3)')} AS y FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS k FROM v_places)),
bb AS (SELECT z, x, y, {Q.tlng('x', 'z')} AS w, {Q.tlng('x + 1', 'z')} AS e, {Q.tlat('y + 1', 'z')} AS s, {Q.tlat('y', 'z')} AS n FROM inv),
c AS (SELECT p.pack_id, bb.z, bb.x, bb.y FROM bb JOIN {PACKS_SQL} p ON bb.w < p.e AND bb.e > p.w AND bb.s < p.n AND bb.n > p.s AND bb.z <= p.max_zoom)
SELECT pack_id, z, x, y FROM c WHERE pack_id % 2 = 0 AND (z, x, y) NOT IN (SELECT (z, x, y) FROM c WHERE pack_id % 2 = 1)""")
def _(d):
    from fellwalk.functions.geo import tile_x, tile_y
    z = (12 - F.substring("id", 2, 20).cast("long") % 3).cast("int")
    inv = d.places.withColumn("z", z).select("z", tile_x("lng", "z").alias("x"), tile_y("lat", "z").alias("y")).distinct()
    p = packs(d)
    return P.removable_tiles(p.where("pack_id % 2 = 0"), p.where("pack_id % 2 = 1"), inv)


@query("tiles_from_urls", """SELECT page_id, z, x, y FROM (SELECT page_id, page_id % 24 AS z, page_id * 7 % 5000 AS x, page_id * 11 % 4000 AS y, page_id % 5 AS k FROM pages) WHERE k <> 4 AND z <= 22 AND x < pow(2, z) AND y < pow(2, z)""")
def _(d):
    k = F.col("page_id")
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    u = d.table("pages").select(k, F.concat(host, F.lit("/tiles/"), (k % 24).cast("string"), F.lit("/"), (k * 7 % 5000).cast("string"), F.lit("/"), (k * 11 % 4000).cast("string"),
                                            F.when(k % 5 == 4, "/meta").when(k % 5 == 3, ".webp?v=2").otherwise(".png")).alias("url"))
    return P.tiles_from_urls(u).select("page_id", "z", "x", "y")


@query("pack_shards", f"SELECT pack_id, shard_x, CAST(unnest(range(CAST(floor(s) AS INT), CAST(floor(n) AS INT) + 1)) AS INT) AS shard_y FROM (SELECT *, CAST(unnest(range(CAST(floor(w) AS INT), CAST(floor(e) AS INT) + 1)) AS INT) AS shard_x FROM {PACKS_SQL})")
def _(d):
    return P.pack_shards(packs(d))


@query("trail_report", f"""
WITH l AS (SELECT way_id, sum({Q.hav('lng', 'lat', 'x2', 'y2')}) AS m FROM (SELECT *, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM {WAY_POINTS_SQL} WINDOW w AS (PARTITION BY way_id ORDER BY seq)) GROUP BY way_id)
SELECT coalesce(kind, 'all') AS kind, coalesce(surface_class, 'all') AS surface_class, coalesce(access_foot, 'all') AS access_foot, count(*) AS ways, round(coalesce(sum(m), 0e0), 2) AS length_m FROM {TRAILS_SQL} t LEFT JOIN l USING (way_id) GROUP BY ROLLUP (kind, surface_class, access_foot)""")
def _(d):
    return P.trail_report(trails(d), line_length(d.way_points, "way_id")).select("kind", "surface_class", "access_foot", "ways", F.round("length_m", 2).alias("length_m"))
