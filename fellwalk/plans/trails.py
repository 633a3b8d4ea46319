"""Queries over trail classification and the trail network."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.functions import trails as R
from fellwalk.operators import spatial as S
from fellwalk.operators import trails as T
from fellwalk.plans import sqltext as Q
from fellwalk.plans.geo import WAY_POINTS_SQL
from fellwalk.plans.registry import query

_HEX = "CASE n WHEN 'red' THEN '#d7263d' WHEN 'blue' THEN '#1f6fd1' WHEN 'yellow' THEN '#f2c418' WHEN 'green' THEN '#2e9e44' WHEN 'white' THEN '#f5f5f5' WHEN 'black' THEN '#222222' WHEN 'orange' THEN '#f28c18' WHEN 'purple' THEN '#8e44ad' WHEN 'brown' THEN '#8b5a2b' END"
MARKINGS_SQL = f"""(SELECT rel_id, rname, color, CASE WHEN color IS NOT NULL THEN shape END AS shape FROM (
  SELECT rel_id, rname, coalesce({_HEX}, CASE WHEN colour LIKE '#%' THEN colour END) AS color,
    CASE WHEN regexp_matches(fg, 'stripe|bar') THEN 'stripe' WHEN regexp_matches(fg, 'cross') THEN 'cross' WHEN regexp_matches(fg, 'dot|circle') THEN 'dot'
         WHEN regexp_matches(fg, 'triangle') THEN 'triangle' WHEN np < 3 THEN 'stripe' ELSE 'other' END AS shape
  FROM (SELECT rel_id, coalesce(name, ref) AS rname, colour, fg, np, lower(coalesce(nullif(split_part(fg, '_', 1), ''), nullif(p1, ''), nullif(colour, ''), '')) AS n
    FROM (SELECT *, coalesce(split_part(symbol, ':', 3), '') AS fg, split_part(symbol, ':', 1) AS p1,
                 coalesce(length(symbol) - length(replace(symbol, ':', '')) + 1, 0) AS np FROM v_relations))))"""


@query("parse_markings", f"SELECT rel_id, coalesce(color, '') AS color, coalesce(shape, '') AS shape FROM {MARKINGS_SQL}")
def _(d):
    return T.parse_markings(d.relations).select(
        "rel_id", F.coalesce("color", F.lit("")).alias("color"), F.coalesce("shape", F.lit("")).alias("shape"))


def _acc(*cols):
    vals = ", ".join(f"CASE WHEN {c} IN ('yes','designated','permissive','destination','customers') THEN 'yes' "
                     f"WHEN {c} IN ('no','private','forestry','agricultural','delivery','military','discouraged') THEN 'no' END" for c in cols)
    return vals


_ROAD = "('tertiary','unclassified','residential','living_street','service')"
_PATHS = "('path','footway','bridleway','cycleway','steps','via_ferrata','pedestrian')"
# classified ways: one row per way of v_way_tags
TRAILS_SQL = f"""(SELECT way_id, highway, surface, name, n_routes, difficulty, surface_class, track_grade, mtb_scale, access_foot, access_bike, access_moto, car_traffic, hs AS hidden_score,
  CASE WHEN n_routes > 0 THEN 'marked' WHEN highway IN {_ROAD} THEN 'road' WHEN hs >= 6e-1 THEN 'hidden' WHEN highway = 'track' THEN 'track' ELSE 'path' END AS kind
FROM (SELECT *,
  CASE WHEN highway IN {_ROAD} OR n_routes > 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 3e-1 + CASE trail_visibility WHEN 'bad' THEN 3e-1 ELSE 0e0 END
    + CASE WHEN informal = 'yes' THEN 2e-1 ELSE 0e0 END + CASE WHEN name IS NULL THEN 1e-1 ELSE 0e0 END + CASE WHEN highway = 'path' THEN 1e-1 ELSE 0e0 END
    + CASE WHEN difficulty >= 3 THEN 1e-1 ELSE 0e0 END - CASE WHEN highway = 'track' AND tracktype IN ('grade1', 'grade2') THEN 2e-1 ELSE 0e0 END)) END AS hs
 FROM (SELECT t.*, m.access, m.bicycle, m.motor_vehicle, m.informal, coalesce(r.n_routes, 0) AS n_routes,
   CASE sac_scale WHEN 'hiking' THEN 1 WHEN 'mountain_hiking' THEN 2 WHEN 'alpine_hiking' THEN 4 ELSE 0 END AS difficulty,
   CASE surface WHEN 'asphalt' THEN 'paved' WHEN 'gravel' THEN 'gravel' WHEN 'ground' THEN 'dirt' WHEN 'rock' THEN 'rock' ELSE
     CASE substr(tracktype, 6, 1) WHEN '1' THEN 'gravel' WHEN '2' THEN 'gravel' WHEN '3' THEN 'dirt' WHEN '4' THEN 'grass' WHEN '5' THEN 'grass'
       ELSE CASE WHEN highway IN {_ROAD} AND highway <> 'service' THEN 'paved' ELSE 'unknown' END END END AS surface_class,
   CASE WHEN tracktype IS NULL THEN 0 ELSE CAST(substr(tracktype, 6, 1) AS INT) END AS track_grade,
   CASE WHEN m.mtb_scale IS NULL THEN -1 ELSE least(6, CAST(m.mtb_scale AS INT)) END AS mtb_scale,
   coalesce({_acc('m.access')}, CASE WHEN highway = 'cycleway' THEN 'unknown' ELSE 'yes' END) AS access_foot,
   coalesce({_acc('m.bicycle', 'm.access')}, CASE WHEN highway = 'cycleway' OR highway IN {_ROAD} THEN 'yes' ELSE 'unknown' END) AS access_bike,
   coalesce({_acc('m.motor_vehicle', 'm.access')}, CASE WHEN highway IN {_PATHS} THEN 'no' WHEN highway = 'track' THEN 'unknown' ELSE 'yes' END) AS access_moto,
   CASE WHEN highway = 'track' AND tracktype = 'grade1' THEN 3e-1 WHEN highway = 'track' THEN 1.5e-1 WHEN highway = 'unclassified' THEN 5.5e-1 WHEN highway = 'residential' THEN 5e-1 ELSE 0e0 END
     * CASE WHEN coalesce(m.motor_vehicle, m.access) IN ('private', 'forestry') THEN 2.5e-1 WHEN coalesce(m.motor_vehicle, m.access) IN ('destination', 'permissive') THEN 6e-1 ELSE 1e0 END
     * CASE WHEN m.service IS NOT NULL THEN 5e-1 ELSE 1e0 END * CASE WHEN surface IN ('gravel', 'ground') THEN 6e-1 ELSE 1e0 END
     * CASE WHEN m.width = '2.5 m' THEN 7e-1 ELSE 1e0 END AS car_traffic
  FROM v_way_tags t JOIN v_way_tags_more m USING (way_id)
  LEFT JOIN (SELECT way_id, count(DISTINCT rel_id) AS n_routes FROM v_route_members JOIN v_relations USING (rel_id) GROUP BY way_id) r USING (way_id))))"""


def trails(d):
    return T.classify_trails(d.ways, T.route_membership(d.route_members, d.relations))


def _tags_only(d, **cols):
    return d.ways.select("way_id", *[c.alias(a) for a, c in cols.items()])


@query("hidden_score", f"SELECT way_id, round(hidden_score, 6) AS hidden_score FROM {TRAILS_SQL}")
def _(d):
    return trails(d).select("way_id", F.round("hidden_score", 6).alias("hidden_score"))


@query("access", f"SELECT way_id, access_foot, access_bike, access_moto FROM {TRAILS_SQL}")
def _(d):
    return _tags_only(d, access_foot=R.access("foot"), access_bike=R.access("bike"), access_moto=R.access("moto"))


@query("surface_class", f"SELECT way_id, surface_class, track_grade FROM {TRAILS_SQL}")
def _(d):
    return _tags_only(d, surface_class=R.surface_class(), track_grade=R.track_grade())


@query("car_traffic", f"SELECT way_id, round(car_traffic, 6) AS car_traffic FROM {TRAILS_SQL}")
def _(d):
    return _tags_only(d, car_traffic=F.round(R.car_traffic(), 6))


@query("route_membership", f"""
SELECT way_id, count(*) AS n_routes, string_agg(concat(CAST(rel_id AS STRING), ':', coalesce(rname, ''), ':', coalesce(color, '')), '|' ORDER BY rel_id) AS routes
FROM (SELECT DISTINCT rel_id, way_id FROM v_route_members) JOIN {MARKINGS_SQL} USING (rel_id) GROUP BY way_id""")
def _(d):
    m = T.route_membership(d.route_members, d.relations)
    text = F.transform("routes", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), F.coalesce(r["name"], F.lit("")), F.lit(":"), F.coalesce(r["color"], F.lit(""))))
    return m.select("way_id", F.size("routes").cast("long").alias("n_routes"), F.array_join(text, "|").alias("routes"))


@query("classify_trails", f"""SELECT way_id, kind, round(hidden_score, 6) AS hidden_score, difficulty, surface_class, track_grade, mtb_scale,
  access_foot, access_bike, access_moto, n_routes FROM {TRAILS_SQL}""")
def _(d):
    return trails(d).select("way_id", "kind", F.round("hidden_score", 6).alias("hidden_score"), "difficulty", "surface_class", "track_grade",
                            "mtb_scale", "access_foot", "access_bike", "access_moto", F.size("routes").alias("n_routes"))


_POI_TAGS = """CASE p_partkey % 12 WHEN 0 THEN 'natural=peak' WHEN 1 THEN 'natural=saddle' WHEN 2 THEN 'waterway=waterfall' WHEN 3 THEN 'natural=spring'
  WHEN 4 THEN 'natural=cave_entrance' WHEN 5 THEN 'tourism=viewpoint' WHEN 6 THEN 'tourism=alpine_hut' WHEN 7 THEN 'tourism=wilderness_hut' WHEN 8 THEN 'amenity=shelter'
  WHEN 9 THEN 'tourism=camp_site' ELSE 'shop=bakery' END"""


def poi_nodes(d):
    part = d.table("part")
    kv = F.split(F.expr(_POI_TAGS), "=")
    ele = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.col("p_size").cast("string"), F.lit(",5 m")))
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name"))
    entries = F.array(F.struct(kv[0].alias("key"), kv[1].alias("value")), F.struct(F.lit("ele").alias("key"), ele.alias("value")),
                      F.struct(F.lit("name").alias("key"), name.alias("value")))
    return part.select(F.col("p_partkey").alias("id"), (25.0 + (F.col("p_partkey") * 7919) % 20000 / 1e6).alias("lng"),
                       (45.0 + (F.col("p_partkey") * 104729) % 15000 / 1e6).alias("lat"),
                       F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull())).alias("tags"))


POIS_SQL = f"""(SELECT p_partkey AS id, CASE split_part(t, '=', 2) WHEN 'cave_entrance' THEN 'cave' WHEN 'alpine_hut' THEN 'hut' WHEN 'wilderness_hut' THEN 'hut'
    WHEN 'camp_site' THEN 'camp' ELSE split_part(t, '=', 2) END AS kind,
  CASE WHEN p_partkey % 3 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_size + 5e-1 END AS ele
 FROM (SELECT *, {_POI_TAGS} AS t FROM part) WHERE t <> 'shop=bakery')"""


@query("classify_pois", f"SELECT id, kind, coalesce(name, '') AS name, coalesce(ele, -1e0) AS ele FROM {POIS_SQL}")
def _(d):
    return T.classify_pois(poi_nodes(d)).select("id", "kind", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ele", F.lit(-1.0)).alias("ele"))


@query("upsert_elements", """
SELECT o_custkey AS way_id, arg_max(o_orderkey, o_orderkey) AS load, arg_max(o_orderstatus, o_orderkey) AS status,
  round(arg_max(o_totalprice, o_orderkey), 2) AS size FROM orders GROUP BY o_custkey""")
def _(d):
    o = d.table("orders").select(F.col("o_custkey").alias("way_id"), F.col("o_orderkey").alias("load"),
                                 F.col("o_orderstatus").alias("status"), F.round("o_totalprice", 2).alias("size"))
    return T.upsert_elements(o, "way_id", "load")


@query("junctions", "SELECT node_id, count(*) AS uses FROM v_way_vertices GROUP BY node_id HAVING count(*) > 1")
def _(d):
    return T.junctions(d.way_vertices)


@query("assign_cells", f"""
WITH b AS (SELECT way_id, {Q.tx('min(lng)', '16')} AS x0, {Q.tx('max(lng)', '16')} AS x1, {Q.ty('max(lat)', '16')} AS y0, {Q.ty('min(lat)', '16')} AS y1
  FROM {WAY_POINTS_SQL} GROUP BY way_id),
u AS (SELECT way_id, unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM b)
SELECT way_id, 16 AS z, CAST(x AS INT) AS x, CAST(unnest(range(y0, y1 + 1)) AS INT) AS y FROM u""")
def _(d):
    return T.assign_cells(d.way_points, 16)


def _aligned(d):
    """Shifted geometry for every third way; every ninth way lost a vertex and must be ignored."""
    v = d.way_points.where("way_id % 3 = 0 and not (way_id % 9 = 0 and seq = 0)")
    return v.select("way_id", "seq", (F.col("lng") + 1e-4).alias("lng"), (F.col("lat") - 1e-4).alias("lat"), (F.col("way_id") % 20 + 0.4).alias("shift_m"))


@query("overlay_alignment", f"""
SELECT way_id, seq, round(CASE WHEN ok THEN lng + 1e-4 ELSE lng END, 6) AS lng, round(CASE WHEN ok THEN lat - 1e-4 ELSE lat END, 6) AS lat,
  CASE WHEN ok THEN way_id % 20 + 4e-1 ELSE 0e0 END AS aligned_m FROM (SELECT *, way_id % 3 = 0 AND way_id % 9 <> 0 AS ok FROM {WAY_POINTS_SQL})""")
def _(d):
    out = T.overlay_alignment(d.way_points, _aligned(d))
    return out.select("way_id", "seq", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.coalesce("aligned_m", F.lit(0.0)).alias("aligned_m"))


@query("union_detected", f"""
SELECT source, kind, count(*) AS trails, round(sum(confidence), 3) AS confidence FROM (
  SELECT 'osm' AS source, kind, 1e0 AS confidence FROM {TRAILS_SQL}
  UNION ALL SELECT 'gps', 'detected', (vec_id % 100) / 1e2 FROM embeddings) GROUP BY source, kind""")
def _(d):
    det = d.table("embeddings").select((-F.col("vec_id") - 1).alias("way_id"), F.lit("gps").alias("source"), F.lit("detected").alias("kind"),
                                       (F.col("vec_id") % 100 / 100).alias("confidence"))
    base = trails(d).select("way_id", "source", "kind", "confidence")
    stale = base.select((-F.col("way_id") - 1).alias("way_id"), F.lit("gps").alias("source"), "kind", "confidence")
    out = T.union_detected(base.unionByName(stale), det, "gps")
    return out.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("trails"), F.round(F.sum("confidence"), 3).alias("confidence"))


@query("trails_in_view", f"""
WITH cells AS (SELECT way_id, unnest(range({Q.tx('min(lng)', '16')}, {Q.tx('max(lng)', '16')} + 1)) AS x, {Q.ty('max(lat)', '16')} AS y0, {Q.ty('min(lat)', '16')} AS y1
  FROM {WAY_POINTS_SQL} GROUP BY way_id),
c AS (SELECT way_id, x, unnest(range(y0, y1 + 1)) AS y FROM cells),
w AS (SELECT node_id AS view_id, lng - 1e-3 AS w, lat - 1e-3 AS s, lng + 1e-3 AS e, lat + 1e-3 AS n FROM v_nodes),
t AS (SELECT view_id, unnest(range({Q.tx('w', '16')}, CAST(floor({Q.txf('e', '16')} - 1e-9) AS INT) + 1)) AS x, {Q.ty('n', '16')} AS y0, CAST(floor({Q.tyf('s', '16')} - 1e-9) AS INT) AS y1 FROM w),
u AS (SELECT view_id, x, unnest(range(y0, y1 + 1)) AS y FROM t)
SELECT view_id, kind, count(DISTINCT way_id) AS trails FROM u JOIN c USING (x, y) JOIN {TRAILS_SQL} k USING (way_id)
WHERE kind IN ('marked', 'hidden') AND view_id IN (SELECT view_id FROM u GROUP BY view_id HAVING count(*) <= 2) GROUP BY view_id, kind""")
def _(d):
    n = d.nodes
    views = n.select(F.col("node_id").alias("view_id"), (F.col("lng") - 1e-3).alias("w"), (F.col("lat") - 1e-3).alias("s"),
                     (F.col("lng") + 1e-3).alias("e"), (F.col("lat") + 1e-3).alias("n"))
    return T.trails_per_view(trails(d), T.tile_boxes(d.way_points, 16), views, ["marked", "hidden"], max_cells=2, z=16)


FIRST_ROUTE_SQL = f"""(SELECT way_id, first(rname ORDER BY rel_id) AS rname, first(color ORDER BY rel_id) FILTER (color IS NOT NULL) AS color,
   first(shape ORDER BY rel_id) FILTER (color IS NOT NULL) AS shape FROM (SELECT DISTINCT rel_id, way_id FROM v_route_members) JOIN {MARKINGS_SQL} USING (rel_id) GROUP BY way_id)"""
_COLOR_NAME = "CASE color WHEN '#d7263d' THEN 'red' WHEN '#1f6fd1' THEN 'blue' WHEN '#f2c418' THEN 'yellow' WHEN '#2e9e44' THEN 'green' WHEN '#f5f5f5' THEN 'white' WHEN '#222222' THEN 'black' WHEN '#f28c18' THEN 'orange' WHEN '#8e44ad' THEN 'purple' WHEN '#8b5a2b' THEN 'brown' END"
SEGMENT_SQL = f"""(SELECT way_id, kind, coalesce(t.name, rname) AS label, {_COLOR_NAME} || ' ' || CASE shape WHEN 'other' THEN 'mark' ELSE shape END AS marking
   FROM {TRAILS_SQL} t LEFT JOIN {FIRST_ROUTE_SQL} f USING (way_id))"""


@query("segment_info", f"SELECT way_id, kind, coalesce(label, '') AS label, coalesce(marking, '') AS marking FROM {SEGMENT_SQL}")
def _(d):
    return T.segment_info(trails(d)).select("way_id", "kind", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("marking", F.lit("")).alias("marking"))


@query("leg_name", f"""SELECT way_id, coalesce('the ' || marking || ' trail', label, CASE kind WHEN 'marked' THEN 'the marked trail' WHEN 'path' THEN 'the path'
  WHEN 'track' THEN 'the forest track' WHEN 'road' THEN 'the road' WHEN 'hidden' THEN 'the hidden trail' ELSE 'the trail' END) AS leg FROM {SEGMENT_SQL}""")
def _(d):
    return T.segment_info(trails(d)).select("way_id", T.leg_name(F.col("marking"), F.col("label"), F.col("kind")).alias("leg"))


@query("trail_length_by_cell", f"""
WITH v AS (SELECT way_id, seq, lng, lat, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM {WAY_POINTS_SQL} WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
l AS (SELECT way_id, sum({Q.hav('lng', 'lat', 'x2', 'y2')}) AS m, max(CASE WHEN seq = 0 THEN lng END) AS lng, max(CASE WHEN seq = 0 THEN lat END) AS lat FROM v GROUP BY way_id HAVING count(x2) > 0),
a AS (SELECT {Q.tx('lng', '14')} AS x, {Q.ty('lat', '14')} AS y, kind, count(*) AS ways, sum(m) AS m, CAST(sum(n_routes) AS BIGINT) AS memberships FROM l JOIN {TRAILS_SQL} t USING (way_id) GROUP BY 1, 2, 3)
SELECT x, y, kind, ways, round(m, 2) AS length_m, memberships, round(m / sum(m) OVER (PARTITION BY x, y), 6) AS share FROM a""")
def _(d):
    out = T.trail_length_by_cell(trails(d), d.way_points, 14)
    return out.select("x", "y", "kind", "ways", F.round("length_m", 2).alias("length_m"), "memberships", F.round("share", 6).alias("share"))


