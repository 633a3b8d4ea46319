"""Queries over navigation, recording and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.functions.geo import haversine_m
from fellwalk.functions import speed as V
from fellwalk.operators import nav as N
from fellwalk.operators import routing as O
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.ordered import with_neighbour
from fellwalk.operators.spatial import line_segments
from fellwalk.plans import routing as R
from fellwalk.plans import sqltext as Q
from fellwalk.plans.geo import SUPPLIER_POINTS, supplier_roads
from fellwalk.plans.registry import query
from fellwalk.plans.scratch import scratch
from fellwalk.streaming import fixes as L

_R = "(SELECT c_custkey AS route_id, k AS seq, 2.5e1 + dx + (c_custkey % 7) * 1e-4 AS lng, 4.5e1 + dy + (c_custkey % 5) * 1e-4 AS lat, 500 + (c_custkey * 13 + k * 37) % 100 / 1e0 AS ele FROM customer, (VALUES (0, 0e0, 0e0), (1, 2e-3, 8e-4), (2, 4e-3, 2.5e-3), (3, 5e-3, 2.6e-3)) AS v(k, dx, dy))"


def routes(d):
    k = F.col("c_custkey")
    v = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for i, x, y in ((0, 0.0, 0.0), (1, 2e-3, 8e-4), (2, 4e-3, 2.5e-3), (3, 5e-3, 2.6e-3))])
    return d.table("customer").select(k.alias("route_id"), F.explode(v).alias("v")).select("route_id", "v.seq", (25.0 + F.col("v.dx") + F.col("route_id") % 7 * 1e-4).alias("lng"),
                                                                                         (45.0 + F.col("v.dy") + F.col("route_id") % 5 * 1e-4).alias("lat"), (500.0 + (F.col("route_id") * 13 + F.col("v.seq") * 37) % 100).alias("ele"))


def fixes(d):
    return d.trace_points.withColumnRenamed("trace_id", "session_id").withColumn("route_id", F.col("session_id") + 1).withColumn("accuracy", F.col("accuracy").cast("double"))


PROG = f"""(SELECT *, sum(st) OVER (PARTITION BY route_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum, sum(st) OVER (PARTITION BY route_id) AS len, sum(up) OVER (PARTITION BY route_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS climb FROM (
  SELECT *, coalesce({Q.hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')}, 0e0) AS st, greatest(0e0, coalesce(lead(ele) OVER w - ele, 0e0)) AS up FROM {_R} WINDOW w AS (PARTITION BY route_id ORDER BY seq)))"""


@query("route_progress_tables", f"SELECT route_id, seq, round(cum, 3) AS cum_m, round(climb, 3) AS climb_left, round(len, 3) AS length_m FROM {PROG}")
def _(d):
    return N.route_progress_tables(routes(d)).select("route_id", "seq", *[F.round(c, 3).alias(c) for c in ("cum_m", "climb_left", "length_m")])


FOLLOW = f"""(SELECT session_id, seq, accuracy, arg_min(along, (o, sg)) AS along, arg_min(len, (o, sg)) AS len, arg_min(climb2, (o, sg)) AS climb, min(o) AS offs FROM (SELECT *, cum + t * (c2 - cum) AS along, round(sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2)), 6) AS o FROM (
  SELECT *, greatest(0e0, least(1e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) AS t FROM (SELECT f.trace_id AS session_id, f.seq, accuracy, s.seq AS sg, cum, c2, climb2, len, (f.lng - s.lng) * mx AS qx, (f.lat - s.lat) * 1.1054e5 AS qy, (x2 - s.lng) * mx AS dx, (y2 - s.lat) * 1.1054e5 AS dy
   FROM (SELECT *, 1.1132e5 * cos(radians(lat)) AS mx FROM v_trace_points) f JOIN (SELECT *, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2, lead(cum) OVER w AS c2, lead(climb) OVER w AS climb2 FROM {PROG} WINDOW w AS (PARTITION BY route_id ORDER BY seq)) s ON s.route_id = f.trace_id + 1 AND x2 IS NOT NULL))) GROUP BY 1, 2, 3)"""


def follow(d):
    progress = N.route_progress_tables(routes(d)).withColumn("duration_s", 1000.0 + F.col("route_id") % 100)
    return N.follow_route(fixes(d), progress)


@query("follow_route", f"SELECT session_id, seq, round(along, 3) AS along, round(greatest(0e0, len - along), 3) AS remaining, round((1000 + (session_id + 1) % 100) * greatest(0e0, len - along) / len, 3) AS remaining_s, round(climb, 3) AS climb_left, round(offs, 3) AS offset_m FROM {FOLLOW}")
def _(d):
    return follow(d).select("session_id", "seq", *[F.round(c, 3).alias(c) for c in ("along", "remaining", "remaining_s", "climb_left")], F.round("offset", 3).alias("offset_m"))


OFF = f"(SELECT *, row_number() OVER w - coalesce(max(CASE WHEN offs <= greatest(45, accuracy * 1.5) THEN rn END) OVER (PARTITION BY session_id ORDER BY seq), 0) >= 3 AS off_route FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM {FOLLOW}) WINDOW w AS (PARTITION BY session_id ORDER BY seq))"


@query("off_route", f"SELECT session_id, seq, off_route FROM {OFF}")
def _(d):
    return N.off_route(follow(d)).select("session_id", "seq", "off_route")


@query("arrived", f"SELECT session_id, min(seq) AS arrived_seq FROM {FOLLOW} WHERE len - along < 30 GROUP BY session_id")
def _(d):
    return N.arrived(follow(d))


def turns(d):
    seg = routes(d).where("seq < 3").select("route_id", "seq", (F.col("route_id") * 10 + F.col("seq")).alias("way_id"), F.when(F.col("route_id") % 3 == 0, "the path").otherwise(F.concat(F.lit("Way "), F.col("seq").cast("string"))).alias("leg"))
    return N.maneuvers(N.route_progress_tables(routes(d)), seg)


@query("maneuvers")
def _(d):
    return turns(d).select("route_id", "seq", F.round("along", 2).alias("along"), "type", "text")


@query("announcements")
def _(d):
    return N.announcements(N.off_route(follow(d)), turns(d))


# Sequential rules as recursion over the rows of a session, numbered by rn.
RECORDED = f"""WITH RECURSIVE ok AS (SELECT trace_id AS session_id, lng, lat, t_s, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS rn FROM v_trace_points WHERE accuracy <= 50),
r AS (SELECT session_id, rn, t_s, lng AS x, lat AS y, 0e0 AS m, true AS kept FROM ok WHERE rn = 1 UNION ALL
 SELECT session_id, rn, t_s, CASE WHEN m >= 5 THEN lng ELSE x END, CASE WHEN m >= 5 THEN lat ELSE y END, m, m >= 5 FROM
  (SELECT o.*, r.x, r.y, {Q.hav('r.x', 'r.y', 'o.lng', 'o.lat')} AS m FROM r JOIN ok o ON o.session_id = r.session_id AND o.rn = r.rn + 1))
SELECT session_id, count(*) AS points, round(sum(m), 3) AS distance_m, max(t_s) - min(t_s) AS duration_s FROM r WHERE kept GROUP BY session_id"""


@query("record_tracks", RECORDED + " HAVING count(*) > 1")
def _(d):
    return N.saved_tracks(N.record_tracks(fixes(d))).select("session_id", "points", F.round("distance_m", 3).alias("distance_m"), "duration_s")


@query("risk_monitor", f"""WITH RECURSIVE ok AS (SELECT trace_id AS session_id, seq, lng, lat, t_s FROM v_trace_points),
r AS (SELECT session_id, seq, t_s, t_s AS t, lng AS x, lat AS y, true AS due FROM ok WHERE seq = 1 UNION ALL
 SELECT session_id, seq, t_s, CASE WHEN due THEN t_s ELSE t END, CASE WHEN due THEN lng ELSE x END, CASE WHEN due THEN lat ELSE y END, due FROM
  (SELECT o.*, r.t, r.x, r.y, o.t_s - r.t >= 30 OR {Q.hav('r.x', 'r.y', 'o.lng', 'o.lat')} >= 150 AS due FROM r JOIN ok o ON o.session_id = r.session_id AND o.seq = r.seq + 1))
SELECT session_id, seq, t_s FROM r WHERE due""")
def _(d):
    return N.risk_monitor(fixes(d))


@query("risk_alerts", """WITH RECURSIVE lv AS (SELECT trace_id AS session_id, seq, t_s * 10 AS t_s, (seq * 7 + trace_id) % 5 < 2 AS high FROM v_trace_points),
ch AS (SELECT session_id, seq, t_s, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM
 (SELECT *, coalesce(lag(high) OVER (PARTITION BY session_id ORDER BY seq), false) AS before FROM lv) WHERE high AND NOT before),
r AS (SELECT *, t_s AS t, true AS warned FROM ch WHERE rn = 1 UNION ALL
 SELECT c.*, CASE WHEN c.t_s - r.t > 600 THEN c.t_s ELSE r.t END, c.t_s - r.t > 600 FROM r JOIN ch c ON c.session_id = r.session_id AND c.rn = r.rn + 1)
SELECT session_id, seq, CAST(t_s AS INT) AS t_s FROM r WHERE warned""")
def _(d):
    lv = F.when((F.col("seq") * 7 + F.col("session_id")) % 5 < 2, "very-high").otherwise("high")
    return N.risk_alerts(fixes(d).select("session_id", "seq", (F.col("t_s") * 10).cast("int").alias("t_s"), lv.alias("level")))


@query("smooth_heading", """WITH RECURSIVE b AS (SELECT trace_id AS session_id, seq, (seq * 37 + trace_id) % 360 - 18e1 AS bearing FROM v_trace_points),
r AS (SELECT session_id, seq, bearing AS h FROM b WHERE seq = 1 UNION ALL
 SELECT b.session_id, b.seq, r.h + ((b.bearing - r.h + 540) % 360 - 180) * 5e-1 FROM r JOIN b ON b.session_id = r.session_id AND b.seq = r.seq + 1)
SELECT session_id, seq, round(h, 6) AS heading FROM r""")
def _(d):
    b = fixes(d).select("session_id", "seq", ((F.col("seq") * 37 + F.col("session_id")) % 360 - 180.0).alias("bearing"))
    return N.smooth_heading(b).select("session_id", "seq", F.round("heading", 6).alias("heading"))


@query("snap_positions", f"""WITH sg AS (SELECT sid, k AS seq, lng + vax AS ax, lat + vay AS ay, lng + vbx AS x2, lat + vby AS y2 FROM {SUPPLIER_POINTS} s,
    (VALUES (0, -6e-2, -2e-2, 1e-2, 1.5e-2), (1, 1e-2, 1.5e-2, 5e-2, 4e-2)) AS v(k, vax, vay, vbx, vby) WHERE sid % 4 <> 0),
c AS (SELECT id, sid, seq, (p.lng - ax) * mx AS qx, (p.lat - ay) * 1.1132e5 AS qy, (x2 - ax) * mx AS dx, (y2 - ay) * 1.1132e5 AS dy, ax, ay, x2, y2 FROM (SELECT *, cos(radians(lat)) * 1.1132e5 AS mx FROM v_places) p
    JOIN sg ON p.lng BETWEEN least(ax, x2) - 1e-1 AND greatest(ax, x2) + 1e-1 AND p.lat BETWEEN least(ay, y2) - 1e-1 AND greatest(ay, y2) + 1e-1),
t AS (SELECT *, greatest(0e0, least(1e0, (qx * dx + qy * dy) / (dx * dx + dy * dy))) AS t FROM c),
r AS (SELECT *, round(sqrt(pow(qx - t * dx, 2) + pow(qy - t * dy, 2)), 6) AS m FROM t)
SELECT id, sid AS line_id, seq, round(m, 3) AS dist_m, round(ax + t * (x2 - ax), 6) AS snap_lng, round(ay + t * (y2 - ay), 6) AS snap_lat FROM r WHERE m < 2000
QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, sid, seq) = 1""")
def _(d):
    roads = line_segments(supplier_roads(d), "line_id").withColumn("footway", F.when(F.col("line_id") % 4 == 0, "sidewalk"))
    hit = N.snap_positions(d.places, "id", roads, 2000.0)
    return hit.select("id", "line_id", "seq", F.round("dist_m", 3).alias("dist_m"), *[F.round(c, 6).alias(c) for c in ("snap_lng", "snap_lat")])


@query("gps_gap_report", "SELECT user_id AS session_id, CAST(rn AS INT) AS seq, CAST(gap AS BIGINT) AS gap_s FROM (SELECT user_id, row_number() OVER w - 1 AS rn, epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap >= 20")
def _(d):
    from pyspark.sql import Window as W
    e = d.table("events").select(F.col("user_id").alias("session_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t_s"))
    return N.gps_gap_report(e)


@query("import_track_route", f"""WITH p AS (SELECT trace_id % 40 AS file, trace_id AS line, seq, lng, lat, count(*) OVER (PARTITION BY trace_id) AS n FROM v_trace_points), b AS (SELECT file, arg_max(line, (n, -line)) AS line FROM p GROUP BY file),
s AS (SELECT p.file, p.line, {Q.hav('lng', 'lat', 'lead(lng) OVER w', 'lead(lat) OVER w')} AS m FROM p JOIN b ON b.file = p.file AND b.line = p.line WINDOW w AS (PARTITION BY p.line ORDER BY seq))
SELECT file, line, round(sum(m), 3) AS distance_m, round(sum(m) / 1.1e0, 3) AS duration_s FROM s GROUP BY file, line""")
def _(d):
    p = d.trace_points.select((F.col("trace_id") % 40).alias("file"), F.col("trace_id").alias("line"), "seq", "lng", "lat")
    return N.import_track_route(p).select("file", "line", F.round("distance_m", 3).alias("distance_m"), F.round("duration_s", 3).alias("duration_s"))


STREAM_T = "(1700000000 + t_s + CAST(floor(seq / 9e0) AS BIGINT) * 60)"  # a pause after every ninth fix
STREAM_SLICES = 4


def _stream(d, job, name):
    """Fixes in time slices, one after the other, through a streaming job into a table.

    The job goes on from its checkpoint with each slice, and takes all files of a slice in one micro-batch. So no
    file of a slice is behind a watermark that another one has moved, however many files a slice has.
    """
    src, out, ck = (scratch(d.spark, f"{name}-{x}") for x in ("in", "out", "ck"))
    f = with_neighbour(fixes(d), ["session_id"], "seq", {"lng": "_x", "lat": "_y", "t_s": "_t"}, offset=-1)
    speed = haversine_m("_x", "_y", "lng", "lat") / (F.col("t_s") - F.col("_t"))
    f = cut(f.select("session_id", "seq", "lng", "lat", "accuracy", speed.alias("speed"), F.expr(STREAM_T).cast("long").alias("_s")))
    lo, hi = f.agg(F.min("_s"), F.max("_s")).first()
    if hi is None:
        lo = hi = 0
    part = F.least(F.lit(STREAM_SLICES - 1), F.floor((F.col("_s") - lo) * STREAM_SLICES / (hi - lo + 1)))

    def replay():
        L.write_table(job(L.read_fix_stream(d.spark, src, None)), out, ck).awaitTermination()

    for i in range(STREAM_SLICES):
        f.where(part == i).withColumn("ts", F.timestamp_seconds("_s")).drop("_s").write.mode("append").parquet(src)
        replay()
    L.end_replay(d.spark, src, F.timestamp_seconds(F.lit(hi)))
    replay()
    return d.spark.read.parquet(out)


@query("record_tracks_stream", f"SELECT session_id, points, distance_m FROM ({RECORDED})")
def _(d):
    r = _stream(d, L.record_tracks, "record")
    return r.groupBy("session_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("dist_m"), 3).alias("distance_m"))


@query("scan_requests_stream", f"""WITH RECURSIVE f AS (SELECT trace_id AS session_id, seq, {STREAM_T} AS s, CAST(floor(lng * 200 + 5e-1) AS BIGINT) AS bx, CAST(floor(lat * 200 + 5e-1) AS BIGINT) AS byy, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS rn FROM v_trace_points),
st(session_id, rn, seq, bx, byy, last, boxes, hit) AS (SELECT session_id, rn, seq, bx, byy, s, [bx * 100000 + byy], TRUE FROM f WHERE rn = 1
 UNION ALL SELECT session_id, rn, seq, bx, byy, CASE WHEN go THEN s ELSE last END, CASE WHEN go THEN list_append(boxes, bx * 100000 + byy) ELSE boxes END, go
  FROM (SELECT f.*, last, boxes, f.s - last >= 60 AND NOT list_contains(boxes, f.bx * 100000 + f.byy) AS go FROM st JOIN f ON f.session_id = st.session_id AND f.rn = st.rn + 1))
SELECT session_id, seq, bx / 2e2 AS box_lng, byy / 2e2 AS box_lat FROM st WHERE hit""")
def _(d):
    return _stream(d, L.scan_requests, "scan").select("session_id", "seq", "box_lng", "box_lat")


#: The fixes that leave their route, on their way to the route's end.
_LEFT = f"""(SELECT session_id * 100000 + o.seq AS req, v.lng AS fx, v.lat AS fy, e.lng AS tx, e.lat AS ty FROM (SELECT session_id, seq FROM (SELECT *, lag(off_route) OVER (PARTITION BY session_id ORDER BY seq) AS was FROM {OFF}) WHERE off_route AND NOT coalesce(was, FALSE)) o
 JOIN v_trace_points v ON v.trace_id = session_id AND v.seq = o.seq JOIN {_R} e ON e.route_id = session_id + 1 AND e.seq = 3)"""


def off_slices(d, name):
    """Progress of all sessions in time slices, as files of a stream folder."""
    src = scratch(d.spark, f"{name}-in")
    f = follow(d).select("session_id", "seq", "offset", "accuracy").join(fixes(d).select("session_id", "seq", "lng", "lat", F.expr(STREAM_T).cast("long").alias("_s")), ["session_id", "seq"])
    f = cut(f.withColumn("ts", F.timestamp_seconds("_s")))
    lo, hi = f.agg(F.coalesce(F.min("_s"), F.lit(0)), F.coalesce(F.max("_s"), F.lit(0))).first()
    part = F.least(F.lit(STREAM_SLICES - 1), F.floor((F.col("_s") - lo) * STREAM_SLICES / (hi - lo + 1)))
    for i in range(STREAM_SLICES):
        f.where(part == i).drop("_s").coalesce(1).write.mode("append").parquet(src)  # one file a slice, so that a micro-batch is a slice
    return d.spark.readStream.schema(f.drop("_s").schema).option("maxFilesPerTrigger", 1).parquet(src)


def rerouting(d):
    """A batch planner of routes from fixes to the ends of their sessions' routes."""
    edges = cut(O.edge_costs(R.table(d), V.prefs()).select("src", "dst", "way_id", "cost"))
    nodes = cut(R.used_nodes(d))
    ends = cut(routes(d).where("seq = 3").select((F.col("route_id") - 1).alias("session_id"), F.col("lng").alias("to_lng"), F.col("lat").alias("to_lat")))

    def plan(left):
        req = left.join(ends, "session_id").select((F.col("session_id") * 100000 + F.col("seq")).alias("req"), F.col("lng").alias("from_lng"), F.col("lat").alias("from_lat"), "to_lng", "to_lat")
        return O.plan_routes(req, edges, nodes)
    return plan


@query("reroute_stream", R.paths_cte(R.snap_sql(_LEFT)) + " SELECT req, r.source, r.target, round(dist, 3) AS cost FROM r JOIN d ON d.source = r.source AND d.node = r.target")
def _(d):
    out, ck = (scratch(d.spark, f"reroute-{x}") for x in ("out", "ck"))
    L.reroute(L.off_route(off_slices(d, "reroute")), rerouting(d), out, ck).awaitTermination()
    return d.spark.read.parquet(out).select("req", "source", "target", F.round("cost", 3).alias("cost"))


@query("live_heat_stream", f"""SELECT CAST(floor(s / 1e1) * 10 AS BIGINT) AS start, CAST(floor(lng / 1e-3) AS BIGINT) AS cx, CAST(floor(lat / 1e-3) AS BIGINT) AS cy, count(*) AS fixes, round(avg(m / 5), 3) AS mean_speed
FROM (SELECT *, {STREAM_T} AS s, {Q.hav('lag(lng) OVER w', 'lag(lat) OVER w', 'lng', 'lat')} AS m FROM v_trace_points WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) GROUP BY 1, 2, 3""")
def _(d):
    return _stream(d, lambda f: L.live_heat(f, 0.001, "10 seconds", "1 day"), "heat").select(F.unix_timestamp("start").alias("start"), "cx", "cy", "fixes", F.round("mean_speed", 3).alias("mean_speed"))


@query("sessionize_stream", f"""SELECT session_id, min(s) AS start, count(*) AS fixes FROM (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY seq) AS part FROM
 (SELECT trace_id AS session_id, seq, {STREAM_T} AS s, CASE WHEN s - lag(s) OVER (PARTITION BY trace_id ORDER BY seq) < 30 THEN 0 ELSE 1 END AS brk FROM v_trace_points)) GROUP BY session_id, part""")
def _(d):
    return _stream(d, lambda f: L.sessionize(f, "30 seconds", "1 day"), "sessions").select("session_id", F.unix_timestamp("start").alias("start"), "fixes")
