"""Routable edges, costs, least-cost paths and route statistics."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions import risk as K
from fellwalk.functions import speed as V
from fellwalk.functions.geo import clamp, haversine_m
from fellwalk.operators.cells import nearest_points, nearest_segments_dense
from fellwalk.operators.density import Grid, local_density_coarse
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.ordered import CHUNK, ranked_sums, running_sums, with_neighbour
from fellwalk.operators.overlay import ancestors, contract
from fellwalk.operators.spatial import fill_elevation_gaps, line_segments


def build_edges(vertices: DataFrame) -> DataFrame:
    """Directed edges src, dst, way_id, length_m between consecutive distinct nodes, both directions.

    A way may run over the same pair twice; parallel edges of one way collapse to the shortest.
    """
    seg = with_neighbour(vertices, ["way_id"], "seq", {"node_id": "prev", "lng": "px", "lat": "py"}, offset=-1)
    fwd = seg.where(F.col("prev").isNotNull() & (F.col("prev") != F.col("node_id"))).select(
        F.col("prev").alias("src"), F.col("node_id").alias("dst"), "way_id", haversine_m("px", "py", "lng", "lat").alias("length_m"))
    both = fwd.withColumn("_d", F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")),
                                                   F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))))
    return both.groupBy(F.col("_d.a").alias("src"), F.col("_d.b").alias("dst"), "way_id").agg(F.min("length_m").alias("length_m"))


def edge_table(edges: DataFrame, trails: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with trail attributes and slope. nodes(node_id, ele)."""
    e = nodes.select(F.col("node_id").alias("src"), F.col("ele").alias("ele_a"))
    f = nodes.select(F.col("node_id").alias("dst"), F.col("ele").alias("ele_b"))
    out = edges.join(trails, "way_id").join(e, "src", "left").join(f, "dst", "left")
    return out.withColumn("slope", V.slope(F.col("length_m"), F.col("ele_a"), F.col("ele_b")))


def edge_costs(table: DataFrame, p: Column, weights: Column | None = None) -> DataFrame:
    """Passable edges with time_s and cost for one preference struct."""
    if "wildlife_penalty" not in table.columns:
        table = table.withColumn("wildlife_penalty", F.lit(None).cast("double"))
    v = V.expert_speed(p["mode"], F.col("slope"))
    if weights is not None:
        v = V.learned_speed(v, V.route_features(F.col("slope")), weights)
    return (table.where(V.allowed(p)).withColumn("speed", v).where("speed > 0")
            .withColumn("time_s", F.col("length_m") / F.col("speed")).withColumn("cost", F.col("time_s") * V.preference_cost(p)))


def wildlife_penalty(vertices: DataFrame, cells: DataFrame, grid: Grid, sigma_km: float = 0.15) -> DataFrame:
    """0..1.2 per way from the mean density at its quarter, middle and three-quarter vertices."""
    n = vertices.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.array(F.floor(F.col("n") / 4), F.floor(F.col("n") / 2), F.floor(3 * F.col("n") / 4))
    pick = n.select("way_id", F.posexplode(at).alias("k", "seq")).withColumn("seq", F.col("seq").cast("int"))
    pts = vertices.join(pick, ["way_id", "seq"]).select("way_id", "k", "lng", "lat")
    uniq = pts.select("lng", "lat").distinct().withColumn("pid", F.struct("lng", "lat"))
    d = local_density_coarse(uniq, "pid", cells, grid, sigma_km).select("pid.lng", "pid.lat", "density")
    mean = pts.join(d, ["lng", "lat"]).groupBy("way_id").agg(F.avg("density").alias("density"))
    return mean.select("way_id", clamp(F.log10(F.greatest("density", F.lit(0.003)) / 0.003) / 2, 0.0, 1.2).alias("wildlife_penalty"))


def snap_endpoints(requests: DataFrame, nodes: DataFrame, max_m: float = 500.0) -> DataFrame:
    """Nearest graph node at both ends; requests without one are dropped. requests(req, from_lng, ...)."""
    both = requests.select("req", F.explode(F.array(
        F.struct(F.lit(0).alias("end"), F.col("from_lng").alias("lng"), F.col("from_lat").alias("lat")),
        F.struct(F.lit(1).alias("end"), F.col("to_lng").alias("lng"), F.col("to_lat").alias("lat")))).alias("p"))
    pts = both.select(F.struct("req", "p.end").alias("pid"), "p.lng", "p.lat")
    hit = nearest_points(pts, "pid", nodes, "node_id", max_m)
    per = hit.groupBy("pid.req").agg(*[F.max(F.when(F.col("pid.end") == e, F.col(c))).alias(f"{c}_{e}") for e in (0, 1) for c in ("node_id", "dist_m")])
    return per.where("node_id_0 is not null and node_id_1 is not null").select(
        "req", F.col("node_id_0").alias("source"), F.col("node_id_1").alias("target"), F.col("dist_m_0").alias("snap_from"), F.col("dist_m_1").alias("snap_to"))


@dataclass
class RouteTree:
    """steps(source, node, dist, prev, via, hops) between junctions, and the overlay's members that unpack them."""

    steps: DataFrame
    members: DataFrame


def shortest_paths(requests: DataFrame, edges: DataFrame) -> tuple[DataFrame, RouteTree]:
    """Least-cost distances for many source/target pairs at once.

    requests(req, source, target); edges(src, dst, way_id, cost), costs not negative. Returns (costs(req, cost),
    tree); the tree reaches every needed target. The search runs on the overlay graph, whose junctions are those
    of the network and the ends of the requests; sources share it. Every round relaxes only nodes that improved
    and are cheaper than the dearest open target of the source; every eighth round the sources without such nodes
    leave the working table. It ends when nothing improves. Ties prefer the smaller (previous node, junction).
    """
    pairs = cut(requests.select("source", "target").distinct())
    graph = contract(edges, pairs.select(F.col("source").alias("node")).union(pairs.select("target")))
    cols = ("dist", "prev", "via", "hops")
    dist = cut(pairs.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), *[F.lit(None).cast("bigint").alias(c) for c in cols[1:]]).distinct().withColumn("fresh", F.lit(True)))
    done = []
    for k in count(1):
        reached = pairs.join(dist.select("source", F.col("node").alias("target"), "dist"), ["source", "target"], "left")
        bound = reached.groupBy("source").agg(F.max(F.coalesce("dist", F.lit(float("inf")))).alias("bound"))
        front = dist.where("fresh").join(bound, "source").where(F.col("dist") < F.col("bound"))
        if k % 8 == 0:
            busy = cut(front.select("source").distinct())
            done.append(cut(dist.join(busy, "source", "left_anti").drop("fresh")))
            dist = cut(dist.join(busy, "source", "left_semi"))
            front = dist.where("fresh").join(bound, "source").where(F.col("dist") < F.col("bound"))
        step = (front.select("source", F.col("node").alias("src"), "dist", "bound").join(graph.shortcuts, "src")
                .withColumn("d", F.col("dist") + F.col("cost")).where(F.col("d") <= F.col("bound"))
                .groupBy("source", F.col("dst").alias("node"))
                .agg(F.min(F.struct(F.col("d").alias("dist"), "via", F.col("src").alias("prev"), "hops")).alias("n")))
        merged = dist.join(step, ["source", "node"], "full")
        better = F.col("n.dist").isNotNull() & (F.col("dist").isNull() | (F.col("n.dist") < F.col("dist")))
        dist = cut(merged.select("source", "node", *[F.when(better, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in cols], better.alias("fresh")))
        if dist.where("fresh").isEmpty():
            break
    steps = dist.drop("fresh")
    for part in done:
        steps = steps.unionByName(part)
    costs = requests.join(steps.select("source", F.col("node").alias("target"), "dist"), ["source", "target"]).select("req", F.col("dist").alias("cost"))
    return costs, RouteTree(steps, graph.members)


def backtrack(requests: DataFrame, tree: RouteTree) -> DataFrame:
    """Path rows (req, back, node, prev, way_id), back = edges from the target; the source row has no prev.

    Junctions by pointer doubling over the tree, then the edges of the chains between them.
    """
    steps = tree.steps.join(requests.select("source").distinct(), "source", "left_semi")
    start = requests.select(F.col("req").alias("key"), "source", F.col("target").alias("node"), F.lit(0).cast("long").alias("back")).join(steps.select("source", "node"), ["source", "node"], "left_semi")
    path = cut(ancestors(start, steps).join(steps, ["source", "node"]).select(F.col("key").alias("req"), "back", "node", "prev", "via"))
    unpacked = path.where("prev is not null").select("req", F.col("back").alias("_b"), "via", F.col("node").alias("end")).join(tree.members, ["via", "end"])
    rows = unpacked.select("req", (F.col("_b") + F.col("left") - 1).alias("back"), F.col("dst").alias("node"), F.col("src").alias("prev"), "way_id")
    return rows.unionByName(path.where("prev is null").select("req", "back", "node", "prev", F.lit(None).cast("bigint").alias("way_id")))


def plan_routes(requests: DataFrame, edges: DataFrame, nodes: DataFrame, max_m: float = 500.0) -> DataFrame:
    """(req, source, target, cost) of requests(req, from_lng, from_lat, to_lng, to_lat) that can be snapped and have a route."""
    snapped = cut(snap_endpoints(requests, nodes, max_m))
    costs, _ = shortest_paths(snapped, edges)
    return snapped.join(costs, "req").select("req", "source", "target", "cost")


def route_rows(path: DataFrame, table: DataFrame) -> DataFrame:
    """Path steps in travel order with their edge attributes; table is the costed edge table."""
    last = path.groupBy("req").agg(F.max("back").alias("last"))
    steps = path.join(last, "req").where("prev is not null").select(
        "req", (F.col("last") - F.col("back")).alias("seq"), F.col("prev").alias("src"), F.col("node").alias("dst"), "way_id")
    return steps.join(table, ["src", "dst", "way_id"])


def route_summary(rows: DataFrame, mode: Column, hidden_at: float = 0.6) -> DataFrame:
    """Distance, duration, climb and shares per request, way ids in order without repeats as text."""
    known = F.col("ele_a").isNotNull() & F.col("ele_b").isNotNull()
    rise = F.when(known, F.col("ele_b") - F.col("ele_a")).otherwise(0.0)
    share = lambda cond: F.sum(F.when(cond, F.col("length_m")).otherwise(0.0)) / F.sum("length_m")
    agg = rows.groupBy("req").agg(
        F.sum("length_m").alias("distance_m"), F.sum("time_s").alias("duration_s"), F.sum(F.greatest(rise, F.lit(0.0))).alias("ascent_m"),
        F.sum(F.greatest(-rise, F.lit(0.0))).alias("descent_m"), share((F.col("kind") == "detected") | (F.col("hidden_score") >= hidden_at)).alias("hidden_share"),
        share(F.col("surface_class") != "paved").alias("offroad_share"), share(V.access_of(mode) == "unknown").alias("unknown_share"))
    prev = with_neighbour(rows.select("req", "seq", "way_id"), ["req"], "seq", {"way_id": "_p"}, offset=-1)
    ways = prev.where(F.col("_p").isNull() | (F.col("_p") != F.col("way_id")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "way_id"))), lambda s: s["way_id"].cast("string")), ",")
    return agg.join(ways.groupBy("req").agg(text.alias("way_ids")), "req")


def route_exposure(vertices: DataFrame, route: str, cells: DataFrame, grid: Grid, season: Column, sigma_km: float = 0.3, points: int | None = None) -> DataFrame:
    """Risk index of the mean density over the vertices; `points` thins long routes to about as many."""
    v = vertices
    if points:
        n = vertices.groupBy(route).agg(F.count(F.lit(1)).alias("n"))
        v = vertices.join(n, route).where(F.col("seq") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0)
    uniq = v.select("lng", "lat").distinct().withColumn("pid", F.struct("lng", "lat"))
    d = local_density_coarse(uniq, "pid", cells, grid, sigma_km).select("pid.lng", "pid.lat", "density")
    out = v.join(d, ["lng", "lat"]).groupBy(route).agg(F.avg("density").alias("density"))
    return out.withColumn("index", K.risk_index(F.col("density") * season))


def route_profile(vertices: DataFrame, route: str, points: int | None = None) -> DataFrame:
    """Profile points cum_m, ele_filled of every vertex; `points` thins long routes to about as many for display. Routes with fewer than two heights or 50 m give none."""
    filled = fill_elevation_gaps(vertices, [route])
    step = with_neighbour(filled, [route], "seq", {"lng": "_px", "lat": "_py"}, offset=-1)
    step = step.withColumn("step_m", F.coalesce(haversine_m("_px", "_py", "lng", "lat"), F.lit(0.0))).drop("_px", "_py")
    cum = running_sums(step, [route], ["seq"], {"step_m": "cum_m"}, F.floor(F.col("seq") / CHUNK))
    stats = step.groupBy(route).agg(F.count(F.lit(1)).alias("n"), F.count("ele").alias("known"), F.sum("step_m").alias("length_m"),
                                    F.min("ele_filled").alias("min_ele"), F.max("ele_filled").alias("max_ele")).where("known >= 2 and length_m >= 50")
    every = F.greatest(F.lit(1), F.floor(F.col("n") / points)) if points else F.lit(1)
    return cum.join(stats, route).where((F.col("seq") % every == 0) | (F.col("seq") == F.col("n") - 1)).select(
        route, "seq", "cum_m", "ele_filled", "length_m", "min_ele", "max_ele")


def road_route_metrics(vertices: DataFrame, route: str) -> DataFrame:
    """Ascent and descent over gap-filled heights."""
    filled = fill_elevation_gaps(vertices, [route])
    d = with_neighbour(filled.select(route, "seq", "ele_filled"), [route], "seq", {"ele_filled": "_p"}, offset=-1)
    rise = F.coalesce(F.col("ele_filled") - F.col("_p"), F.lit(0.0))
    return d.groupBy(route).agg(F.sum(F.greatest(rise, F.lit(0.0))).alias("ascent_m"), F.sum(F.greatest(-rise, F.lit(0.0))).alias("descent_m"))


def daylight_margin(routes: DataFrame) -> DataFrame:
    """Arrival against the next sunset: margin_ms, late and dark flags. routes(start_ms, duration_s, lng, lat)."""
    start = F.col("start_ms")
    out = routes.withColumns({"sunset_ms": K.next_sunset_ms(start, "lng", "lat"), "arrival_ms": start + F.col("duration_s") * 1000,
                              "dark": K.sun_elevation_ms(start, "lng", "lat") < K.SUN_HORIZON})
    return out.withColumn("margin_ms", F.col("sunset_ms") - F.col("arrival_ms")).withColumn("late", ~F.col("dark") & F.coalesce(F.col("margin_ms") < 0, F.lit(False)))


# ---------------------------------------------------------------- speed training rows

def map_match(points: DataFrame, vertices: DataFrame, max_m: float = 12.0) -> DataFrame:
    """Trace segments with the way nearest to their midpoint (null when none within max_m)."""
    seg = with_neighbour(points, ["trace_id"], "seq", {"lng": "px", "lat": "py", "t_s": "pt"}, offset=-1).where("px is not null")
    seg = seg.select("trace_id", "seq", "px", "py", "lng", "lat", (F.col("t_s") - F.col("pt")).alias("dt"), haversine_m("px", "py", "lng", "lat").alias("d"))
    mid = seg.select(F.struct("trace_id", "seq").alias("pid"), ((F.col("px") + F.col("lng")) / 2).alias("lng"), ((F.col("py") + F.col("lat")) / 2).alias("lat"))
    hit = nearest_segments_dense(mid, "pid", line_segments(vertices, "way_id"), ["way_id", "seq"], max_m).select("pid.trace_id", "pid.seq", "way_id")
    return seg.join(hit.hint("merge"), ["trace_id", "seq"], "left")


CHUNK_M = 100.0  # fixed value


def trace_chunks(matched: DataFrame) -> DataFrame:
    """Stretches of about 100 m on one way: trace_id, chunk, way_id, d, t and both end positions.

    Breaks (no match, dt <= 0 or > 30 s, d > 80 m, way change) make islands; the greedy cut then runs
    inside one island, which ends at the first break.
    """
    ok = F.col("way_id").isNotNull() & (F.col("dt") > 0) & (F.col("dt") <= 30) & (F.col("d") <= 80)
    rows = with_neighbour(matched.withColumn("ok", ok), ["trace_id"], "seq", {"way_id": "_w", "ok": "_ok"}, offset=-1)
    new = F.col("ok") & (~F.coalesce("_ok", F.lit(False)) | (F.coalesce("_w", F.lit(-1)) != F.col("way_id")))
    rows = rows.withColumn("_new", new.cast("int"))
    isl = running_sums(rows, ["trace_id"], ["seq"], {"_new": "island"}, F.floor(F.col("seq") / CHUNK)).where("ok")
    steps = F.array_sort(F.collect_list(F.struct("seq", "d", "dt", "px", "py", "lng", "lat")))
    g = isl.groupBy("trace_id", "island", "way_id").agg(steps.alias("s"))
    zero = F.expr("named_struct('c', 0L, 'd', 0.0D, 'ids', cast(array() as array<bigint>))")

    def cut_at(acc, x):
        full = acc["d"] >= CHUNK_M
        c = acc["c"] + F.when(full, 1).otherwise(0).cast("bigint")
        return F.struct(c.alias("c"), (F.when(full, 0.0).otherwise(acc["d"]) + x["d"]).alias("d"), F.concat(acc["ids"], F.array(c)).alias("ids"))

    ids = F.aggregate("s", zero, cut_at, lambda a: a["ids"])
    flat = g.select("trace_id", "island", "way_id", F.explode(F.arrays_zip("s", ids.alias("ids"))).alias("z"))
    return (flat.groupBy("trace_id", "island", "way_id", F.col("z.ids").alias("part"))
            .agg(F.sum("z.s.d").alias("d"), F.sum("z.s.dt").alias("t"), F.min(F.struct("z.s.seq", "z.s.px", "z.s.py")).alias("a"),
                 F.max(F.struct("z.s.seq", "z.s.lng", "z.s.lat")).alias("b"))
            .select("trace_id", F.col("a.seq").alias("chunk"), "way_id", "d", "t", F.col("a.px").alias("a_lng"), F.col("a.py").alias("a_lat"),
                    F.col("b.lng").alias("b_lng"), F.col("b.lat").alias("b_lat")))


def good_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where((F.col("d") >= CHUNK_M * 0.6) & (F.col("t") >= 10) & (F.col("d") / F.col("t") > 0.3))


def upper_median(rows: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """sorted[floor(n/2)] per group by rank; a group of any size is ranked by ranges of the value."""
    v = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    v = ranked_sums(v, keys, [value], {"_c": "_r"})
    n = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    reached = v.join(n, keys).where(F.col("_r") > F.floor(F.col("_n") / 2))
    return reached.groupBy(*keys).agg(F.min(value).alias(alias))


def trace_mode(chunks: DataFrame, min_chunks: int = 3) -> DataFrame:
    """How a trace was travelled, from the upper median speed of its good chunks."""
    g = good_chunks(chunks).withColumn("v", F.col("d") / F.col("t"))
    enough = g.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_chunks).select("trace_id")
    m = upper_median(g.join(enough, "trace_id"), ["trace_id"], "v", "v")
    return m.withColumn("mode", F.when(F.col("v") < 8 / 3.6, "foot").when(F.col("v") < 30 / 3.6, "bike").otherwise("moto"))


def speed_training_rows(chunks: DataFrame, modes: DataFrame, trails: DataFrame, elevation: DataFrame) -> DataFrame:
    """Feature rows: log ratio of observed to expert speed. elevation(lng, lat, ele) covers the chunk ends."""
    ea = elevation.select(F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"), F.col("ele").alias("ele_a"))
    eb = elevation.select(F.col("lng").alias("b_lng"), F.col("lat").alias("b_lat"), F.col("ele").alias("ele_b"))
    c = (good_chunks(chunks).join(modes.select("trace_id", "mode"), "trace_id").join(ea, ["a_lng", "a_lat"]).join(eb, ["b_lng", "b_lat"])
         .withColumn("flat", haversine_m("a_lng", "a_lat", "b_lng", "b_lat")).where("flat >= 30")
         .withColumn("slope", (F.col("ele_b") - F.col("ele_a")) / F.col("flat")).where(F.abs("slope") <= 0.6).join(trails, "way_id"))
    c = c.withColumns({"v_obs": F.col("d") / F.col("t"), "v_expert": V.expert_speed(F.col("mode"), F.col("slope")), "x": V.route_features(F.col("slope"))}).where("v_expert > 0")
    return c.select("trace_id", "chunk", "way_id", "mode", "x", clamp(F.log(F.col("v_obs") / F.col("v_expert")), -2.0, 1.5).alias("y"),
                    F.least("d", F.lit(200.0)).alias("w"), "v_obs", "v_expert")


def home_weights(rows: DataFrame, regions: DataFrame, home: tuple[float, float], radius_km: float = 40.0, factor: float = 3.0) -> DataFrame:
    """Rows of regions near home count `factor` times. regions(region, lng, lat)."""
    near = regions.select("region", (haversine_m("lng", "lat", F.lit(home[0]), F.lit(home[1])) <= radius_km * 1000).alias("home"))
    out = rows.join(near, "region", "left").withColumn("home", F.coalesce("home", F.lit(False)))
    return out.withColumn("w", F.when(F.col("home"), F.col("w") * factor).otherwise(F.col("w")))
