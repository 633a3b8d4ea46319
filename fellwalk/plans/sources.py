"""Round trips through the readers and writers, on files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.operators import trails as T
from fellwalk.plans import sqltext as Q
from fellwalk.plans.geo import WAY_POINTS_SQL
from fellwalk.plans.registry import query
from fellwalk.plans.scratch import scratch
from fellwalk.plans.trails import POIS_SQL, SEGMENT_SQL, TRAILS_SQL, FIRST_ROUTE_SQL, poi_nodes, trails
from fellwalk.sources import catalogs, gazetteer, geojson, gpx, grids, osm


def _text(df, path):
    df.write.text(path)
    return path


def _way_arrays(d):
    """One row per way with its ordered vertex array (fixture data; real ways are bounded)."""
    return d.way_points.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id", "lng", "lat"))).alias("v"))


_OSM_SQL = f"""SELECT way_id, highway, count(*) AS vertices, CAST(sum(node_id) AS BIGINT) AS node_sum, round(sum(lng), 6) AS lng_sum, round(sum(lat), 6) AS lat_sum
FROM {WAY_POINTS_SQL} JOIN v_way_tags USING (way_id) GROUP BY way_id, highway HAVING count(*) >= 2"""


def _osm_summary(t):
    v = t["vertices"].groupBy("way_id").agg(F.count(F.lit(1)).alias("vertices"), F.sum("node_id").alias("node_sum"),
                                            F.round(F.sum("lng"), 6).alias("lng_sum"), F.round(F.sum("lat"), 6).alias("lat_sum"))
    return t["ways"].select("way_id", F.try_element_at("tags", F.lit("highway")).alias("highway")).join(v, "way_id")


@query("read_osm_json", _OSM_SQL)
def _(d):
    w = _way_arrays(d).join(d.ways, "way_id")
    geom = F.when(F.col("way_id") % 2 == 0, F.transform("v", lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lon"))))
    ways = w.select(F.to_json(F.struct(F.array(F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.col("v.node_id").alias("nodes"),
                                                        geom.alias("geometry"), "tags")).alias("elements"))).alias("value"))
    nodes = d.nodes.select(F.to_json(F.struct(F.array(F.struct(F.lit("node").alias("type"), F.col("node_id").alias("id"), "lat", F.col("lng").alias("lon"))).alias("elements"))).alias("value"))
    path = _text(ways.unionByName(nodes), scratch(d.spark, "osm-json"))
    return _osm_summary(osm.read_osm_json(d.spark, path, multiline=False))


@query("read_osm_xml", _OSM_SQL)
def _(d):
    w = _way_arrays(d).join(d.ways, "way_id")
    ways = w.select(F.col("way_id").alias("_id"), F.transform("v", lambda p: F.struct(p["node_id"].alias("_ref"))).alias("nd"),
                    F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag"))
    nodes = d.nodes.select(F.col("node_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lng").alias("_lon"),
                           F.array(F.struct(F.lit("ele").alias("_k"), F.col("ele").cast("string").alias("_v"))).alias("tag"))
    path = scratch(d.spark, "osm-xml")
    for tag, df in (("way", ways), ("node", nodes)):
        df.write.format("xml").option("rootTag", "osm").option("rowTag", tag).save(f"{path}/{tag}")
    return _osm_summary(osm.read_osm_xml(d.spark, f"{path}/*"))


@query("filter_trail_elements", """
SELECT way_id, hw AS highway, CAST(1 + (surface IS NOT NULL)::INT + (service IS NOT NULL)::INT AS BIGINT) AS kept_tags FROM (
  SELECT way_id, surface, service, CASE way_id % 7 WHEN 0 THEN 'service' WHEN 1 THEN 'motorway' ELSE highway END AS hw FROM v_way_tags JOIN v_way_tags_more USING (way_id))
WHERE hw <> 'motorway' AND NOT (hw = 'service' AND coalesce(service, '') IN ('driveway', 'alley')) AND way_id % 23 <> 0""")
def _(d):
    k = F.col("way_id")
    hw = F.when(k % 7 == 0, "service").when(k % 7 == 1, "motorway").otherwise(F.try_element_at("tags", F.lit("highway")))
    entries = F.array(F.struct(F.lit("highway").alias("key"), hw.alias("value")), *[
        F.struct(F.lit(t).alias("key"), F.try_element_at("tags", F.lit(t)).alias("value")) for t in ("surface", "service")],
        F.struct(F.lit("footway").alias("key"), F.when(k % 23 == 0, "traffic_island").alias("value")), F.struct(F.lit("source").alias("key"), F.lit("survey").alias("value")))
    w = d.ways.select("way_id", F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull())).alias("tags"))
    out = osm.filter_ways(w, osm.SKIP_SERVICE_CELLS)
    return out.select("way_id", F.col("tags")["highway"].alias("highway"), F.size("tags").cast("long").alias("kept_tags"))


@query("filter_pois", f"SELECT kind, count(*) AS pois FROM {POIS_SQL} GROUP BY kind")
def _(d):
    return T.classify_pois(osm.filter_pois(poi_nodes(d))).groupBy("kind").agg(F.count(F.lit(1)).alias("pois"))


_CELLS_SQL = f"""
WITH j AS (SELECT node_id FROM v_way_vertices GROUP BY node_id HAVING count(*) > 1),
v AS (SELECT way_id, seq, node_id, floor(lng * 1e6 + 5e-1) AS x, floor(lat * 1e6 + 5e-1) AS y, max(seq) OVER (PARTITION BY way_id) AS last FROM {WAY_POINTS_SQL})
SELECT v.way_id, count(*) AS vertices, CAST(sum(CASE WHEN j.node_id IS NOT NULL OR seq = 0 OR seq = last THEN v.node_id ELSE -(way_id * 16777216 + seq + 1) END) AS BIGINT) AS node_sum,
  round(sum(x / 1e6), 6) AS lng_sum, round(sum(y / 1e6), 6) AS lat_sum FROM v LEFT JOIN j ON j.node_id = v.node_id GROUP BY v.way_id"""


@query("trail_cells_round_trip", _CELLS_SQL)
def _(d):
    cells = osm.trail_cells(d.ways, d.way_points, d.route_members, poi_nodes(d), z=14)
    path = scratch(d.spark, "trail-cells")
    osm.write_trail_cells(cells, path)
    back = osm.read_trail_cells(d.spark, path)
    return back["vertices"].groupBy("way_id").agg(F.count(F.lit(1)).alias("vertices"), F.sum("node_id").alias("node_sum"),
                                                  F.round(F.sum("lng"), 6).alias("lng_sum"), F.round(F.sum("lat"), 6).alias("lat_sum"))


@query("read_cell_documents", f"""
SELECT way_id, seq, CASE WHEN seq % 2 = 0 THEN node_id ELSE -(way_id * 16777216 + seq + 1) END AS node_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM {WAY_POINTS_SQL}""")
def _(d):
    w = _way_arrays(d)
    xs = F.transform("v", lambda p: F.floor(p["lng"] * 1e6 + 0.5))
    ys = F.transform("v", lambda p: F.floor(p["lat"] * 1e6 + 0.5))
    deltas = lambda a: F.transform(a, lambda x, i: x - F.coalesce(F.get(a, i - 1), F.lit(0)))
    coords = F.flatten(F.zip_with(deltas(xs), deltas(ys), lambda a, b: F.array(a, b)))
    junc = F.transform(F.filter("v", lambda p: p["seq"] % 2 == 0), lambda p: F.array(p["seq"].cast("long"), p["node_id"]))
    doc = F.concat(F.lit('{"v":1,"w":[['), F.col("way_id").cast("string"), F.lit(",0,"), F.to_json(coords), F.lit(","), F.to_json(junc), F.lit("]]}"))
    path = _text(w.select(doc.alias("value")), scratch(d.spark, "cell-docs"))
    return osm.read_cell_documents(d.spark, path).select("way_id", F.col("seq").cast("int").alias("seq"), "node_id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def _tracks(d):
    t = d.trace_points
    return t.select(F.concat(F.lit("t"), F.col("trace_id").cast("string")).alias("track"), "seq", "lng", "lat",
                    F.when(F.col("accuracy") % 3 != 0, 500 + F.col("accuracy") / 8).alias("ele"), F.timestamp_seconds(1700000000 + F.col("t_s")).alias("ts"),
                    F.concat(F.lit("A & B <"), F.col("trace_id").cast("string"), F.lit(">")).alias("name"))


_GPX_SQL = """
SELECT concat('A & B <', CAST(trace_id AS STRING), '>') AS name, CAST(seq - 1 AS INT) AS seq, round(lng, 7) AS lng, round(lat, 7) AS lat,
  CASE WHEN accuracy % 3 <> 0 THEN floor((500 + accuracy / 8e0) * 10 + 5e-1) / 10 ELSE -1e0 END AS ele, CAST(1700000000 + t_s AS BIGINT) AS t
FROM v_trace_points WHERE trace_id IN (SELECT trace_id FROM v_trace_points GROUP BY trace_id HAVING count(*) > 1)"""


@query("gpx_round_trip", _GPX_SQL)
def _(d):
    path = scratch(d.spark, "gpx")
    gpx.write_gpx(_tracks(d), "track", path)
    p = gpx.read_gpx(d.spark, path)["points"]
    return p.select("name", "seq", "lng", "lat", F.coalesce("ele", F.lit(-1.0)).alias("ele"), F.unix_timestamp("ts").alias("t"))


@query("read_trace_pages", """SELECT count(*) AS points, count(DISTINCT trace_id) AS pages, true AS all_last
  FROM v_trace_points WHERE trace_id IN (SELECT trace_id FROM v_trace_points GROUP BY trace_id HAVING count(*) > 1)""")
def _(d):
    path = scratch(d.spark, "pages")
    gpx.write_gpx(_tracks(d), "track", path)
    p = gpx.read_trace_pages(d.spark, path)
    return p.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("file").alias("pages"), F.bool_and("last_page").alias("all_last"))


@query("read_stac_scenes", """
SELECT id, concat('35T', substr('ABCDEFGH', CAST(rn % 8 + 1 AS INT), 1), 'L') AS grid, CASE WHEN rn % 2 = 0 THEN 32635 ELSE 32634 END AS epsg,
  CASE WHEN rn % 5 = 0 THEN 1e2 ELSE cloud END AS cloud, nodata, epoch(acquired_at) AS t, round(25 + rn / 1e4, 6) AS w
FROM (SELECT *, CAST(substr(id, 2) AS BIGINT) AS rn FROM v_scenes) WHERE rn % 11 <> 0""")
def _(d):
    rn = F.substring("id", 2, 20).cast("long")
    s = d.scenes.withColumn("rn", rn)
    grid = F.when(F.col("rn") % 11 != 0, F.concat(F.lit("MGRS-35T"), F.expr("substr('ABCDEFGH', int(rn % 8 + 1), 1)"), F.lit("L")))
    props = F.struct(grid.alias("grid:code"), F.when(F.col("rn") % 2 == 1, 32634).alias("proj:epsg"), F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"),
                     F.when(F.col("rn") % 5 != 0, F.col("cloud")).alias("eo:cloud_cover"), F.col("nodata").alias("s2:nodata_pixel_percentage"))
    props = F.when(F.col("rn") % 11 != 0, props).otherwise(F.struct(F.lit(None).cast("string").alias("grid:code"), F.lit(None).cast("int").alias("proj:epsg"), F.lit("x").alias("datetime"), F.col("cloud").alias("eo:cloud_cover"), F.col("nodata").alias("s2:nodata_pixel_percentage")))
    lng = 25 + F.col("rn") / 1e4
    doc = F.to_json(F.struct(F.array(F.struct("id", F.array(lng, F.lit(45.0), lng + 1, F.lit(46.0)).alias("bbox"), props.alias("properties"))).alias("features")))
    path = _text(s.select(doc.alias("value")), scratch(d.spark, "stac"))
    out = catalogs.read_stac_scenes(d.spark, path, multiline=False)
    return out.select("id", "grid", "epsg", "cloud", "nodata", F.unix_timestamp("acquired_at").cast("double").alias("t"), F.round("w", 6).alias("w"))


@query("search_scenes", """SELECT id FROM (SELECT *, 25 + CAST(substr(id, 2) AS BIGINT) / 1e4 AS w FROM v_scenes)
WHERE cloud < 15 AND acquired_at >= TIMESTAMP '1996-01-01' AND w <= 2.6e1 AND w + 5e-1 >= 2.55e1""")
def _(d):
    lng = 25 + F.substring("id", 2, 20).cast("long") / 1e4
    s = d.scenes.withColumns({"w": lng, "s": F.lit(45.0), "e": lng + 0.5, "n": F.lit(46.0)})
    return catalogs.search_scenes(s, 25.5, 45.0, 26.0, 45.5, F.lit("1996-01-01").cast("timestamp"), 15).select("id")


@query("scene_file_index", """
SELECT id, CASE WHEN k % 3 <> 0 THEN concat('store/35/T/LM/2024/', CAST(1 + k % 12 AS STRING), '/', id, '/B04.tif') ELSE '' END AS red,
  CASE WHEN k % 3 <> 0 THEN concat('store/35/T/LM/2024/', CAST(1 + k % 12 AS STRING), '/', id, '/L2A_PVI.tif') ELSE '' END AS preview
FROM (SELECT o_orderkey AS k, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'S3A' ELSE 'S2B' END, '_T35TLM_2024', lpad(CAST(1 + o_orderkey % 12 AS STRING), 2, '0'), '07T',
   lpad(CAST(o_orderkey AS STRING), 6, '0'), '_L2A') AS id FROM orders)""")
def _(d):
    k = F.col("o_orderkey")
    sid = F.concat(F.when(k % 3 == 0, "S3A").otherwise("S2B"), F.lit("_T35TLM_2024"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lit("07T"), F.lpad(k.cast("string"), 6, "0"), F.lit("_L2A"))
    out = catalogs.scene_file_index(d.table("orders").select(sid.alias("id")), "store")
    return out.select("id", F.coalesce("red", F.lit("")).alias("red"), F.coalesce("preview", F.lit("")).alias("preview"))


@query("read_observations", """
SELECT round(2.5e1 + x / 1e4, 6) AS lng, round(4.5e1 + y / 1e4, 6) AS lat, event_id % 3 = 0 AS obscured, coalesce(CASE WHEN event_id % 4 <> 0 THEN (event_id % 500) / 1e0 END, -1e0) AS accuracy_m, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t
FROM (SELECT *, (event_id * 7919) % 20000 AS x, (event_id * 104729) % 15000 AS y FROM events) WHERE event_id % 10 <> 0 AND event_id % 13 <> 0""")
def _(d):
    e = F.col("event_id")
    loc = F.when(e % 10 != 0, F.concat((45.0 + (e * 104729) % 15000 / 1e4).cast("string"), F.lit(","), (25.0 + (e * 7919) % 20000 / 1e4).cast("string")))
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = d.table("events").select(F.to_json(F.struct(F.array(F.struct(
        loc.alias("location"), (e % 3 == 0).alias("obscured"), F.when(e % 4 != 0, (e % 500).cast("double")).alias("positional_accuracy"),
        F.when(e % 2 == 0, t).alias("time_observed_at"), F.when(e % 13 != 0, t).otherwise("soon").alias("observed_on"))).alias("results"))).alias("value"), e)
    rows = rows.where(~((e % 13 == 0) & (e % 2 == 0)))
    path = _text(rows.select("value"), scratch(d.spark, "obs"))
    out = catalogs.read_observations(d.spark, path, multiline=False)
    return out.select(F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), "obscured", F.coalesce("accuracy_m", F.lit(-1.0)).alias("accuracy_m"), F.unix_timestamp("observed_at").alias("t"))


@query("filter_occurrences", """
SELECT round(2.5e1 + (event_id * 7919) % 20000 / 1e4, 6) AS lng, CAST(2000 + event_id % 20 AS INT) AS year FROM events
WHERE event_id % 6 <> 0 AND (event_id % 4 = 0 OR (event_id % 40) * 100 <= 1500) AND event_type IN ('click', 'view')""")
def _(d):
    e = F.col("event_id")
    basis = F.when(F.col("event_type") == "click", "OBSERVATION").when(F.col("event_type") == "view", "HUMAN_OBSERVATION").otherwise("PRESERVED_SPECIMEN")
    rec = d.table("events").select((25.0 + (e * 7919) % 20000 / 1e4).alias("decimalLongitude"), F.lit(45.0).alias("decimalLatitude"),
                                   F.when(e % 4 != 0, (e % 40) * 100).alias("coordinateUncertaintyInMeters"), basis.alias("basisOfRecord"),
                                   F.when(e % 6 == 0, "hidden").alias("informationWithheld"), (2000 + e % 20).cast("int").alias("year"))
    return catalogs.filter_occurrences(rec).select(F.round("lng", 6).alias("lng"), "year")


@query("decode_byte_grid", """
WITH w AS (SELECT max(cx) + 1 AS w FROM v_density_cells), r AS (SELECT DISTINCT cy FROM v_density_cells), g AS (SELECT cy, unnest(range(w)) AS cx FROM r, w)
SELECT CAST(g.cy AS STRING) AS path, CAST(g.cx AS INT) AS cx, CAST(coalesce(q, 0) AS INT) AS q FROM g LEFT JOIN v_density_cells c ON c.cx = g.cx AND c.cy = g.cy""")
def _(d):
    width = (d.density_cells.agg(F.max("cx")).first()[0] or 0) + 1
    at = F.map_from_entries(F.collect_list(F.struct("cx", "q")))
    row = d.density_cells.groupBy("cy").agg(at.alias("v"))
    value = lambda x: F.lpad(F.hex(F.coalesce(F.try_element_at("v", x), F.lit(0)).cast("long")), 2, "0")
    files = row.select(F.col("cy").cast("string").alias("path"), F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), value), "")).alias("content"))
    return grids.decode_byte_grid(files, width, 1).select("path", "cx", "q")


@query("write_byte_grid", """
SELECT tile_lon, tile_lat, CAST(100 AS BIGINT) AS cells, CAST(sum(q) AS BIGINT) AS total, CAST(sum(q * (ix * 7 + iy)) AS BIGINT) AS placed FROM (
  SELECT CAST(floor(24 + cx / 1e1) AS INT) AS tile_lon, CAST(ceil(47 - cy / 1e1 - 1e-9) AS INT) - 1 AS tile_lat, cx % 10 AS ix, cy % 10 AS iy, CASE WHEN cy % 20 < 10 THEN q ELSE 0 END AS q FROM v_density_cells)
GROUP BY tile_lon, tile_lat HAVING sum(q) > 0""")
def _(d):
    cells = d.density_cells.withColumn("q", F.when(F.col("cy") % 20 < 10, F.col("q")).otherwise(0))
    path = scratch(d.spark, "fine")
    grids.write_byte_grid(grids.fine_tiles(cells, 24.0, 47.0, 0.1, 10), path, 10)
    name = lambda k: F.regexp_extract("path", r"(-?\d+)_(-?\d+)\.bin$", k).cast("int")
    return grids.read_byte_grid(d.spark, path, 10, 10).groupBy(name(1).alias("tile_lon"), name(2).alias("tile_lat")).agg(
        F.count(F.lit(1)).alias("cells"), F.sum("q").alias("total"), F.sum(F.col("q") * (F.col("cx") * 7 + F.col("cy"))).alias("placed"))


@query("decode_dem_pixels", "SELECT p_partkey, (128 + p_size % 8) * 256 + p_partkey % 256 + (p_size * 5 % 256) / 2.56e2 - 32768 AS ele FROM part")
def _(d):
    px = d.table("part").select("p_partkey", (128 + F.col("p_size") % 8).alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("b"))
    return grids.decode_dem_pixels(px).select("p_partkey", "ele")


@query("tile_manifest_round_trip", f"""SELECT 14 AS z, {Q.tx('lng', '14')} AS x, {Q.ty('lat', '14')} AS y, CAST(count(*) AS STRING) AS signature FROM v_places GROUP BY 1, 2, 3""")
def _(d):
    from fellwalk.operators.spatial import with_tile
    m = with_tile(d.places, 14).groupBy("z", "x", "y").agg(F.count(F.lit(1)).cast("string").alias("signature"))
    path = scratch(d.spark, "manifest")
    grids.write_tile_manifest(m, "v2", path)
    return grids.read_tile_manifest(d.spark, path, "v2")


@query("read_road_routes", f"""
WITH v AS (SELECT way_id, seq, lng, lat, CASE WHEN seq < 2 THEN 1 ELSE 2 END AS step, lag(lng) OVER w AS px, lag(lat) OVER w AS py FROM {WAY_POINTS_SQL} WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY way_id ORDER BY seq) - 1 AS INT) AS s FROM v WHERE px IS NULL OR px <> lng OR py <> lat)
SELECT CAST(way_id AS STRING) AS request_id, s AS seq, round(lng, 6) AS lng, round(lat, 6) AS lat, CASE WHEN s = 0 THEN '' WHEN step = 1 THEN 'Main street' ELSE 'DN1' END AS name FROM k WHERE way_id % 5 <> 0""")
def _(d):
    w = _way_arrays(d)
    pt = lambda p: F.array(p["lng"], p["lat"])

    def step(cond, name, ref):
        return F.struct(F.lit(name).alias("name"), F.lit(ref).alias("ref"), F.struct(F.transform(F.filter("v", cond), pt).alias("coordinates")).alias("geometry"))

    legs = F.array(F.struct(F.array(step(lambda p: p["seq"] < 2, "Main street", "X"), step(lambda p: p["seq"] >= 1, "", "DN1")).alias("steps")))
    doc = F.to_json(F.struct(F.col("way_id").cast("string").alias("request_id"), F.when(F.col("way_id") % 5 == 0, "NoRoute").otherwise("Ok").alias("code"),
                             F.array(F.struct(F.lit(100.0).alias("distance"), F.lit(10.0).alias("duration"), legs.alias("legs"))).alias("routes")))
    path = _text(w.select(doc.alias("value")), scratch(d.spark, "roads"))
    out = catalogs.read_road_routes(d.spark, path)
    return out.select("request_id", "seq", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"), F.coalesce("name", F.lit("")).alias("name"))


@query("read_geocoder_results", """
SELECT name, CASE osm WHEN 'peak' THEN 'peak' WHEN 'reservoir' THEN 'water' WHEN 'alpine_hut' THEN 'hut' WHEN 'village' THEN 'town' ELSE 'pin' END AS kind,
  concat(replace(osm, '_', ' '), CASE WHEN cat % 4 = 0 THEN ' · Town, County' ELSE ' · County' END) AS detail, CASE osm WHEN 'village' THEN 13 ELSE 15 END AS zoom
FROM (SELECT *, CASE cat % 5 WHEN 0 THEN 'peak' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'alpine_hut' WHEN 3 THEN 'village' ELSE 'shop_x' END AS osm FROM v_places) WHERE cat % 7 <> 0""")
def _(d):
    c = F.col("cat")
    osm_value = F.when(c % 5 == 0, "peak").when(c % 5 == 1, "reservoir").when(c % 5 == 2, "alpine_hut").when(c % 5 == 3, "village").otherwise("shop_x")
    props = F.struct("name", osm_value.alias("osm_value"), F.when(c % 4 == 0, "Town").alias("town"), F.lit("County").alias("county"),
                     F.when(c % 7 == 0, "HU").when(c % 2 == 0, "RO").alias("countrycode"))
    doc = F.to_json(F.struct(F.lit("q").alias("query"), F.array(F.struct(F.struct(F.array("lng", "lat").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("features")))
    path = _text(d.places.select(doc.alias("value")), scratch(d.spark, "geocoder"))
    return catalogs.read_geocoder_results(d.spark, path).select("name", "kind", "detail", "zoom")


@query("write_trails_geojson", f"""
SELECT t.way_id, t.kind, coalesce(s.label, '') AS name, CASE WHEN f.color1 IS NOT NULL THEN f.color1 ELSE CASE t.kind WHEN 'marked' THEN '#d7263d' WHEN 'path' THEN '#f3e6c4' WHEN 'track' THEN '#d9a55b' WHEN 'road' THEN '#e8e8e8' WHEN 'hidden' THEN '#ff5fc8' END END AS color,
  coalesce('mark-' || replace(f.color, '#', '') || '-' || f.shape, '') AS mark1, t.surface_class AS surface
FROM {TRAILS_SQL} t JOIN {SEGMENT_SQL} s USING (way_id) LEFT JOIN (SELECT way_id, color, shape, color AS color1 FROM {FIRST_ROUTE_SQL}) f USING (way_id)""")
def _(d):
    t = trails(d).withColumn("aligned_m", F.lit(None).cast("double"))
    coords = _way_arrays(d).select("way_id", F.transform("v", lambda p: F.array(p["lng"], p["lat"])).alias("coords"))
    all_ways = d.ways.select("way_id").join(coords, "way_id", "left").withColumn("coords", F.coalesce("coords", F.array().cast("array<array<double>>")))
    path = scratch(d.spark, "geojson")
    geojson.write_trails_geojson(t, all_ways, path)
    p = "$.properties."
    j = lambda k: F.get_json_object("value", p + k)
    return d.spark.read.text(path).select(j("wayId").cast("long").alias("way_id"), j("kind").alias("kind"), j("name").alias("name"), j("color").alias("color"), j("mark1").alias("mark1"), j("surface").alias("surface"))


@query("write_pois_geojson", f"""
SELECT id, concat_ws(' ', name, CASE WHEN ele IS NOT NULL AND ele <> 0 THEN concat(CAST(CAST(floor(ele + 5e-1) AS BIGINT) AS STRING), ' m') END) AS label FROM {POIS_SQL}""")
def _(d):
    path = scratch(d.spark, "pois")
    geojson.write_pois_geojson(T.classify_pois(poi_nodes(d)), path)
    return d.spark.read.text(path).select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.get_json_object("value", "$.properties.label").alias("label"))


@query("gazetteer_round_trip", """
SELECT id, name, cat, round(lng, 5) AS lng, round(lat, 5) AS lat, CAST(floor(lng) AS INT) AS shard_x, CAST(floor(lat) AS INT) AS shard_y, count(*) OVER (PARTITION BY cat) AS cat_count FROM v_places""")
def _(d):
    p = d.places
    path = scratch(d.spark, "gazetteer")
    gazetteer.write_gazetteer(p, p.where("cat = 34"), p.where("cat = 32"), path)
    core = gazetteer.read_gazetteer(d.spark, path)
    meta = gazetteer.read_gazetteer(d.spark, path, "meta")
    return core.join(meta, "cat").select("id", "name", "cat", F.round("lng", 5).alias("lng"), F.round("lat", 5).alias("lat"), "shard_x", "shard_y", F.col("n").alias("cat_count"))
