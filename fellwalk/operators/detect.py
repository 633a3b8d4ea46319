"""Hidden-trail detection on sparse cell tables keyed by scan."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions.geo import WGS84_A, clamp, haversine_m, utm
from fellwalk.operators.cells import box_cells, nearest_points, offsets, ring8, segment_cells, square
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.graphs import connected_components
from fellwalk.operators.ordered import running_sums, with_neighbour
from fellwalk.operators.spatial import densify_lines, line_segments, simplify_lines

# Fixed values of the two detectors, alignment and fusion.
GPS = {"cell": 4.0, "min_traces": 2, "known_m": 20.0, "min_area": 400.0, "min_length": 80.0, "simplify_m": 3.0, "snap_extra": 20.0}
IMAGERY = {"cell": 5.0, "known_m": 20.0, "min_area": 600.0, "min_length": 120.0, "simplify_m": 5.0, "snap_extra": 25.0}
BAND_M, PARALLEL_M, PARALLEL_SHARE = 8.0, 40.0, 0.6
ALIGN = {"max_shift": 25.0, "min_prob": 0.3, "min_support": 0.6, "min_shift": 5.0, "taper": 30.0, "sample": 10.0, "step": 2.5}
AGREE_M, AGREE_SHARE = 25.0, 0.5
KEY = ["scan_id", "cx", "cy"]
BLOCK = 64  # cells a side; only a way to deal rows


def merc_x(lng) -> Column:
    return WGS84_A * F.radians(lng)


def merc_y(lat) -> Column:
    return WGS84_A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def make_grids(scans: DataFrame, cell_m: float) -> DataFrame:
    """Mercator grid per scan box: cell_m is the ground size at the box centre."""
    step = cell_m / F.cos(F.radians((F.col("s") + F.col("n")) / 2))
    g = scans.select("scan_id", "w", "s", "e", "n", merc_x("w").alias("x0"), merc_y("n").alias("y1"), step.alias("step"))
    return g.withColumns({"width": F.ceil((merc_x("e") - F.col("x0")) / F.col("step")).cast("int"),
                          "height": F.ceil((F.col("y1") - merc_y("s")) / F.col("step")).cast("int")})


def cell_lnglat(cx, cy) -> tuple[Column, Column]:
    x = F.col("x0") + (cx + 0.5) * F.col("step")
    y = F.col("y1") - (cy + 0.5) * F.col("step")
    return F.degrees(x / WGS84_A), F.degrees(2 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)


def trace_segments(points: DataFrame) -> DataFrame:
    """Consecutive point pairs without standstills (< 0.5 m), gaps (> 60 m) and glitches (> 40 m/s); v is null when untimed."""
    rows = with_neighbour(points, ["trace_id"], "seq", {"lng": "ax", "lat": "ay", "t_s": "_t"}, offset=-1).where("ax is not null")
    d, dt = haversine_m("ax", "ay", "lng", "lat"), F.col("t_s") - F.col("_t")
    rows = rows.withColumns({"d": d, "v": F.when(dt > 0, d / dt)})
    return rows.where((F.col("d") >= 0.5) & (F.col("d") <= 60) & ~F.coalesce(F.col("v") > 40, F.lit(False))).select(
        "trace_id", "seq", "ax", "ay", F.col("lng").alias("bx"), F.col("lat").alias("by"), "d", "v")


def disc(radius: float) -> list[tuple[int, int]]:
    r = math.ceil(radius)
    return [(x, y) for x, y in square(r) if x * x + y * y <= radius * radius + 0.25]


def to_scans(segments: DataFrame, scans: DataFrame, pad: float = 0.002, size: float = 0.02) -> DataFrame:
    """Segments with the id of every scan box they may touch."""
    s = box_cells(scans.select("scan_id", "w", "s", "e", "n"), F.col("w") - pad, F.col("s") - pad, F.col("e") + pad, F.col("n") + pad, size)
    hit = ((F.least("ax", "bx") <= F.col("e") + pad) & (F.greatest("ax", "bx") >= F.col("w") - pad)
           & (F.least("ay", "by") <= F.col("n") + pad) & (F.greatest("ay", "by") >= F.col("s") - pad))
    cols = segments.columns
    return segment_cells(segments, size).join(s, ["_cx", "_cy"]).where(hit).select("scan_id", *cols).distinct()


def line_cells(segments: DataFrame, grids: DataFrame, keep: list[str]) -> DataFrame:
    """Cells visited in half-cell steps along each segment; cells repeat as often as they are visited."""
    g = segments.join(grids, "scan_id")
    fx = lambda c: (merc_x(c) - F.col("x0")) / F.col("step")
    fy = lambda c: (F.col("y1") - merc_y(c)) / F.col("step")
    g = g.withColumns({"fax": fx("ax"), "fay": fy("ay"), "fbx": fx("bx"), "fby": fy("by")})
    g = g.withColumn("k", F.greatest(F.lit(1), F.ceil(F.hypot(F.col("fbx") - F.col("fax"), F.col("fby") - F.col("fay")) * 2)).cast("int"))
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("k")).cast("int")
    return g.select("scan_id", *keep, at("fax", "fbx").alias("cx"), at("fay", "fby").alias("cy"), "width", "height")


def _inside(cells: DataFrame) -> DataFrame:
    return cells.where((F.col("cx") >= 0) & (F.col("cy") >= 0) & (F.col("cx") < F.col("width")) & (F.col("cy") < F.col("height")))


def rasterize_lines(segments: DataFrame, grids: DataFrame, radius_m: float, cell_m: float) -> DataFrame:
    """Distinct cells within radius_m of the segments: thin line cells first, then the disc around each once."""
    thin = line_cells(segments, grids, []).distinct()
    return _inside(offsets(thin, disc(radius_m / cell_m))).select(*KEY).distinct()


def trace_heat(segments: DataFrame, grids: DataFrame, cell_m: float) -> DataFrame:
    """Distinct traces, speed sum and speed count per cell of an 8 m band; speed counts every visit."""
    visits = line_cells(segments, grids, ["trace_id", "v"])
    reach = disc(BAND_M / cell_m)
    r = max(x for x, _ in reach)
    # the line cells near a block of one trace meet there, so that neither the cells of their discs nor these sums are shuffled
    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - r) / BLOCK), F.floor((F.col(c) + r) / BLOCK)))
    per = visits.withColumn("bx", blocks("cx")).withColumn("by", blocks("cy"))
    dealt = per.repartition("scan_id", "trace_id", "bx", "by")
    lines = dealt.groupBy("scan_id", "trace_id", "bx", "by", "cx", "cy", "width", "height").agg(F.sum("v").alias("v"), F.count("v").alias("k"))
    spread = _inside(offsets(lines, reach)).where((F.floor(F.col("cx") / BLOCK) == F.col("bx")) & (F.floor(F.col("cy") / BLOCK) == F.col("by")))
    one = spread.groupBy(*KEY, "trace_id", "bx", "by").agg(F.sum("v").alias("v"), F.sum("k").alias("k"))
    return one.groupBy(*KEY).agg(F.count(F.lit(1)).alias("heat"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("speed_sum"), F.sum("k").alias("speed_n"))


def candidate_cells(heat: DataFrame, known: DataFrame, min_traces: int) -> DataFrame:
    return heat.where(F.col("heat") >= min_traces).join(known, KEY, "left_anti").select(*KEY)


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def _size(cells: DataFrame, grids: DataFrame) -> DataFrame:
    return cells.join(grids.select("scan_id", "width", "height"), "scan_id")


def dilate(cells: DataFrame, grids: DataFrame) -> DataFrame:
    return _inside(_size(offsets(cells, CROSS).select(*KEY).distinct(), grids)).select(*KEY)


def erode(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """Cells whose four neighbours are all set; the grid's border is cleared."""
    full = offsets(cells, CROSS).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n = 5").select(*KEY)
    s = _size(full, grids)
    return s.where((F.col("cx") > 0) & (F.col("cy") > 0) & (F.col("cx") < F.col("width") - 1) & (F.col("cy") < F.col("height") - 1)).select(*KEY)


def close(cells: DataFrame, grids: DataFrame, times: int = 1) -> DataFrame:
    for _ in range(times):
        cells = dilate(cells, grids)
    for _ in range(times):
        cells = erode(cells, grids)
    return cells


def _id() -> Column:
    return F.struct("scan_id", "cy", "cx")


HALF = [(1, 0), (-1, 1), (0, 1), (1, 1)]


def components(cells: DataFrame) -> DataFrame:
    """8-connected components: cell key and label (struct of the smallest cell)."""
    c = cut(cells.select(*KEY).distinct())
    near = offsets(c.withColumn("a", _id()), HALF).join(c, KEY, "left_semi").select("a", _id().alias("b"))
    lab = connected_components(c.select(_id().alias("id")), near)
    return lab.select("id.scan_id", "id.cx", "id.cy", "label")


def remove_small(cells: DataFrame, min_cells: int) -> DataFrame:
    lab = components(cells)
    big = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells).select("label")
    return lab.join(big, "label", "left_semi").select(*KEY)


def hysteresis(scores: DataFrame, lo: float, hi: float, blocked: DataFrame | None = None) -> DataFrame:
    """Cells >= lo connected to a cell >= hi, outside `blocked`."""
    ok = scores.where(F.col("score") >= lo)
    if blocked is not None:
        ok = ok.join(blocked, KEY, "left_anti")
    lab = components(ok).join(ok, KEY)
    keep = lab.groupBy("label").agg(F.max("score").alias("m")).where(F.col("m") >= hi).select("label")
    return lab.join(keep, "label", "left_semi").select(*KEY)


# neighbour offsets seen from the receiving cell, in the order p2..p9 (north, then clockwise)
_P = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def _thin_pass(cells: DataFrame, grids: DataFrame, second: bool) -> DataFrame:
    """One sub-pass: cells with the flag `gone`."""
    send = F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(256).alias("b")),
                   *[F.struct(F.lit(-x).alias("x"), F.lit(-y).alias("y"), F.lit(1 << k).alias("b")) for k, (x, y) in enumerate(_P)])
    rows = cells.withColumn("o", F.explode(send)).select(
        "scan_id", (F.col("cx") + F.col("o.x")).cast("int").alias("cx"), (F.col("cy") + F.col("o.y")).cast("int").alias("cy"), F.col("o.b").alias("b"))
    m = rows.groupBy(*KEY).agg(F.sum("b").cast("int").alias("m")).where(F.col("m") >= 256)
    p = [F.col("m").bitwiseAND(1 << k) > 0 for k in range(8)]
    n = sum((x.cast("int") for x in p[1:]), p[0].cast("int"))
    turns = sum(((~a & b).cast("int") for a, b in zip(p[1:], p[2:] + p[:1])), (~p[0] & p[1]).cast("int"))
    north, east, south, west = p[0], p[2], p[4], p[6]
    keep = ((north & east & west) | (north & south & west)) if second else ((north & east & south) | (east & south & west))
    inner = (F.col("cx") > 0) & (F.col("cy") > 0) & (F.col("cx") < F.col("width") - 1) & (F.col("cy") < F.col("height") - 1)
    gone = inner & n.between(2, 6) & (turns == 1) & ~keep
    return _size(m, grids).select(*KEY, gone.alias("gone"))


def skeletonize(cells: DataFrame, grids: DataFrame, max_rounds: int = 500) -> DataFrame:
    """Two-sub-pass thinning to one-cell-wide lines; all deletions of a sub-pass happen at once."""
    cur = cut(cells.select(*KEY).distinct())
    n = cur.count()
    for _ in range(max_rounds):
        first = _thin_pass(cur, grids, False).where("not gone").select(*KEY)
        new = cut(_thin_pass(first, grids, True).where("not gone").select(*KEY))
        left = new.count()
        if left == n:
            return new
        cur, n = new, left
    raise RuntimeError(f"thinning did not settle after {max_rounds} rounds")


def trace_skeleton(cells: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Chains between cells of degree other than 2 (and whole loops): chain, seq, cell.

    Directed steps form linked lists; pointer doubling ranks every step from the start of its
    list. Of the two directions the one with the smaller first step stays, so each edge occurs once.
    """
    c = cut(cells.select(*KEY).distinct())
    e = cut(offsets(c.withColumn("a", _id()), ring8()).join(c, KEY, "left_semi").select("a", _id().alias("b")))
    deg = e.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    inner = cut(deg.where("deg = 2").select(F.col("a").alias("id")))
    lab = connected_components(inner, e.join(inner.select(F.col("id").alias("a")), "a", "left_semi").join(inner.select(F.col("id").alias("b")), "b", "left_semi"))
    open_ = (e.join(inner.select(F.col("id").alias("b")), "b", "left_anti").join(lab.withColumnRenamed("id", "a"), "a").select("label").distinct())
    loops = lab.join(open_, "label", "left_anti").select("label").distinct()
    mid = cut(inner.join(loops.select(F.col("label").alias("id")), "id", "left_anti"))  # a loop starts at its smallest cell
    # step (a, b) follows (z, a) when a is an inner cell and z its other neighbour
    back = e.join(mid.select(F.col("id").alias("a")), "a").alias("s").join(
        e.select(F.col("a").alias("z"), F.col("b").alias("a2")).alias("t"), (F.col("s.a") == F.col("t.a2")) & (F.col("t.z") != F.col("s.b")))
    prev = back.select(F.struct("s.a", "s.b").alias("id"), F.struct(F.col("t.z").alias("a"), F.col("t.a2").alias("b")).alias("prev"))
    state = cut(e.select(F.struct("a", "b").alias("id")).join(prev, "id", "left").select("id", "prev", F.when(F.col("prev").isNull(), 0).otherwise(1).alias("rank"),
                                                                                      F.coalesce("prev", "id").alias("head")))
    for _ in range(max_rounds):
        if state.where("prev is not null").isEmpty():
            break
        far = state.select(F.col("id").alias("prev"), F.col("prev").alias("p2"), F.col("rank").alias("r2"), F.col("head").alias("h2"))
        j = state.join(far, "prev", "left")
        state = cut(j.select("id", F.col("p2").alias("prev"), (F.col("rank") + F.when(F.col("prev").isNotNull(), F.col("r2")).otherwise(0)).alias("rank"),
                             F.when(F.col("prev").isNotNull(), F.col("h2")).otherwise(F.col("head")).alias("head")))
    else:
        raise RuntimeError("chains did not settle")
    last = state.groupBy("head").agg(F.max(F.struct("rank", "id")).alias("l"))
    rev = F.struct(F.col("l.id.b").alias("a"), F.col("l.id.a").alias("b"))
    keep = last.where((F.col("head") < rev) | (F.col("head") == rev)).select("head")
    steps = state.join(keep, "head", "left_semi")
    rows = steps.select(F.col("head").alias("chain"), (F.col("rank") + 1).alias("seq"), F.col("id.b").alias("c")).unionByName(
        steps.where("rank = 0").select(F.col("head").alias("chain"), F.lit(0).alias("seq"), F.col("id.a").alias("c")))
    return rows.select(F.concat_ws(":", *[F.col(f"chain.{e}.{k}").cast("string") for e in ("a", "b") for k in ("scan_id", "cy", "cx")]).alias("chain"), "seq",
                       F.col("c.scan_id").alias("scan_id"), F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"))


def drop_parallel(chains: DataFrame, near: DataFrame) -> DataFrame:
    """Drops chains with at least 60 % of their cells near mapped ways."""
    f = chains.join(near.select(*KEY).distinct().withColumn("_n", F.lit(1.0)), KEY, "left")
    keep = f.groupBy("chain").agg(F.avg(F.coalesce("_n", F.lit(0.0))).alias("share")).where(F.col("share") < PARALLEL_SHARE).select("chain")
    return chains.join(keep, "chain", "left_semi")


def chain_usage(chains: DataFrame, heat: DataFrame) -> DataFrame:
    """foot, bike or vehicle by mean speed; null when no speed is known."""
    u = chains.join(heat, KEY, "left").groupBy("chain").agg((F.sum("speed_sum") / F.nullif(F.sum("speed_n"), F.lit(0))).alias("v"))
    return u.withColumn("usage", F.when(F.col("v") < 8 / 3.6, "foot").when(F.col("v") < 32 / 3.6, "bike").when(F.col("v").isNotNull(), "vehicle"))


def chains_to_lines(chains: DataFrame, grids: DataFrame, scores: DataFrame, simplify_m: float, cell_m: float, min_length: float,
                    confidence: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Simplified vertices (chain, seq, scan_id, cx, cy, lng, lat) and chain attributes (chain, length_m, confidence)."""
    flat = chains.select("chain", "seq", "scan_id", "cx", "cy", F.col("cx").cast("double").alias("px"), F.col("cy").cast("double").alias("py"))
    flat = cut(flat)
    kept = simplify_lines(flat, "chain", simplify_m / cell_m, x="px", y="py")
    lng, lat = cell_lnglat(F.col("cx"), F.col("cy"))
    v = kept.join(grids.select("scan_id", "x0", "y1", "step"), "scan_id").select("chain", F.col("seq").alias("pos"), "scan_id", "cx", "cy", lng.alias("lng"), lat.alias("lat"))
    v = v.withColumn("seq", F.row_number().over(W.partitionBy("chain").orderBy("pos")) - 1).drop("pos")
    length = line_segments(v, "chain").groupBy("chain").agg(F.sum(haversine_m("ax", "ay", "bx", "by")).alias("length_m")).where(F.col("length_m") >= min_length)
    mean = flat.join(scores.select(*KEY, F.col("score").cast("double").alias("_s")), KEY, "left").groupBy("chain").agg(F.avg(F.coalesce("_s", F.lit(0.0))).alias("mean"))
    info = length.join(mean, "chain").select("chain", "length_m", clamp(confidence(F.col("mean")), 0.0, 1.0).alias("confidence"))
    return v.join(info.select("chain"), "chain", "left_semi"), info


def snap_ends(lines: DataFrame, nodes: DataFrame, max_m: float) -> DataFrame:
    """Extends line ends to the nearest mapped node; open ends that meet in one cell share an id.

    lines(chain, seq, scan_id, cx, cy, lng, lat), nodes(node_id, lng, lat) -> chain, seq, node_id, lng, lat. New
    ids are negative hashes of the cell (ends) or of chain and position (inside).
    """
    n = lines.groupBy("chain").agg(F.max("seq").alias("last"))
    l = lines.join(n, "chain")
    ends = l.where("seq = 0 or seq = last").select(F.struct("chain", "seq").alias("pid"), "lng", "lat", "scan_id", "cx", "cy", "seq")
    hit = nearest_points(ends.select("pid", "lng", "lat"), "pid", nodes, "node_id", max_m, steps=(1.0,))
    hit = hit.join(nodes.groupBy("node_id").agg(F.min(F.struct("lng", "lat")).alias("p")), "node_id").select(
        "pid.chain", "pid.seq", F.col("node_id").alias("snap"), F.col("p.lng").alias("sx"), F.col("p.lat").alias("sy"))
    neg = lambda *c: -F.abs(F.xxhash64(*c) % (1 << 52)) - 1
    rows = l.join(hit, ["chain", "seq"], "left")
    is_end = (F.col("seq") == 0) | (F.col("seq") == F.col("last"))
    own = rows.select("chain", (F.col("seq") * 2 + 1).alias("k"), F.when(is_end & F.col("snap").isNull(), neg("scan_id", "cx", "cy")).otherwise(neg("chain", "seq")).alias("node_id"), "lng", "lat")
    ext = rows.where("snap is not null").select("chain", F.when(F.col("seq") == 0, 0).otherwise(F.col("seq") * 2 + 2).alias("k"), F.col("snap").alias("node_id"), F.col("sx").alias("lng"), F.col("sy").alias("lat"))
    out = own.unionByName(ext)
    return out.withColumn("seq", F.row_number().over(W.partitionBy("chain").orderBy("k")) - 1).drop("k")


def resample_probability(grids: DataFrame, pixels: DataFrame, epsg: int, origin_x: float, origin_y: float, res: float) -> DataFrame:
    """UTM probability pixels(ix, iy, prob) at the centres of the scan grids, nearest pixel."""
    g = grids.withColumn("cy", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("cx", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    lng, lat = cell_lnglat(F.col("cx"), F.col("cy"))
    g = g.select(*KEY, lng.alias("lng"), lat.alias("lat"))
    e, n = utm("lng", "lat", F.lit(epsg))
    g = g.withColumns({"_e": e, "_n": n})
    g = g.select(*KEY, F.floor((F.col("_e") - origin_x) / res).cast("int").alias("ix"), F.floor((origin_y - F.col("_n")) / res).cast("int").alias("iy"))
    return g.join(pixels, ["ix", "iy"]).select(*KEY, F.col("prob").alias("score"))


def _finish(chains, grids, scores, ways_seg, cell_m, cfg, confidence):
    near = rasterize_lines(ways_seg, grids, PARALLEL_M, cell_m)
    chains = cut(drop_parallel(chains, near))
    return (chains, *chains_to_lines(chains, grids, scores, cfg["simplify_m"], cell_m, cfg["min_length"], confidence))


def detect_from_traces(points: DataFrame, scans: DataFrame, way_segments: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New trails of GPS traces, per scan box: vertices and attributes (usage, confidence, length)."""
    cfg = GPS
    grids = cut(make_grids(scans, cfg["cell"]))
    heat = cut(trace_heat(to_scans(trace_segments(points), scans), grids, cfg["cell"]))
    ways = to_scans(way_segments, scans)
    cand = candidate_cells(heat, rasterize_lines(ways, grids, cfg["known_m"], cfg["cell"]), cfg["min_traces"])
    mask = remove_small(close(cand, grids), math.ceil(cfg["min_area"] / cfg["cell"] ** 2))
    chains = trace_skeleton(skeletonize(mask, grids))
    chains, lines, info = _finish(chains, grids, heat.withColumnRenamed("heat", "score"), ways, cfg["cell"], cfg, lambda m: 1 - F.exp(-m / 3))
    info = info.join(chain_usage(chains, heat).select("chain", "usage"), "chain", "left").withColumn("source", F.lit("gps"))
    return snap_ends(lines, nodes, cfg["known_m"] + cfg["snap_extra"]), info


def detect_from_probability(scores: DataFrame, grids: DataFrame, scans: DataFrame, way_segments: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """New trails of a probability raster on scan grids (5 m cells)."""
    cfg = IMAGERY
    ways = to_scans(way_segments, scans)
    known = rasterize_lines(ways, grids, cfg["known_m"], cfg["cell"])
    mask = hysteresis(scores, threshold * 0.5, threshold, known)
    mask = remove_small(close(mask, grids, 2), math.ceil(cfg["min_area"] / cfg["cell"] ** 2))
    chains = trace_skeleton(skeletonize(mask, grids))
    conf = lambda m: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (m - threshold) / (1 - threshold)) * 0.8 + 0.2)
    _, lines, info = _finish(chains, grids, scores, ways, cfg["cell"], cfg, conf)
    return snap_ends(lines, nodes, cfg["known_m"] + cfg["snap_extra"]), info.withColumn("source", F.lit("imagery"))


def align_ways(vertices: DataFrame, pixels: DataFrame, epsg: int, origin_x: float, origin_y: float, res: float, width: int, height: int,
               o: dict | None = None) -> DataFrame:
    """Shifts ways sideways onto the probability ridge: way_id, seq, lng, lat, shift_m, support.

    vertices(way_id, seq, node_id, lng, lat); pixels(ix, iy, prob). Only ways with consistent evidence are
    returned; vertex counts never change and junctions and ends stay in place.
    """
    o = {**ALIGN, **(o or {})}
    head = vertices.where("seq = 0").select("way_id", F.col("lng").alias("lng0"), F.col("lat").alias("lat0"))
    v = vertices.join(head, "way_id").withColumn("kx", 111320 * F.cos(F.radians("lat0")))
    v = v.withColumns({"x": (F.col("lng") - F.col("lng0")) * F.col("kx"), "y": (F.col("lat") - F.col("lat0")) * 110540})
    v = with_neighbour(v, ["way_id"], "seq", {"x": "_px", "y": "_py"}, offset=-1)
    v = v.withColumn("st", F.coalesce(F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py")), F.lit(0.0)))
    v = running_sums(v, ["way_id"], ["seq"], {"st": "along"}, F.floor(F.col("seq") / 4096))
    tot = v.groupBy("way_id").agg(F.max("along").alias("len"), F.max("seq").alias("last")).where("len >= 60")
    v = cut(v.join(tot, "way_id"))
    n = F.greatest(F.lit(2), F.floor(F.col("len") / o["sample"] + 0.5) + 1).cast("int")
    seg = with_neighbour(v.withColumn("n", n), ["way_id"], "seq", {"x": "x2", "y": "y2", "along": "along2"}, offset=1).where("x2 is not null")
    gap = F.col("len") / (F.col("n") - 1)
    # samples of a segment: positions in (along, along2], the very first one included
    k0 = F.when(F.col("seq") == 0, 0).otherwise(F.floor(F.col("along") / gap + 1e-9) + 1).cast("int")
    k1 = F.when(F.col("seq") == F.col("last") - 1, F.col("n") - 1).otherwise(F.floor(F.col("along2") / gap + 1e-9)).cast("int")
    s = seg.where(k1 >= k0).withColumn("k", F.explode(F.sequence(k0, k1)))
    a = F.col("len") * F.col("k") / (F.col("n") - 1)
    t = (a - F.col("along")) / F.greatest(F.lit(1e-9), F.col("along2") - F.col("along"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    ln = F.when(F.hypot(dx, dy) > 0, F.hypot(dx, dy)).otherwise(1.0)
    s = s.select("way_id", "k", "n", "len", "lng0", "lat0", "kx", (F.col("x") + dx * t).alias("x"), (F.col("y") + dy * t).alias("y"), (-dy / ln).alias("nx"), (dx / ln).alias("ny"))
    m = int(round(o["max_shift"] / o["step"]))
    s = s.withColumn("d", F.explode(F.array(*[F.lit(i * o["step"]) for i in range(-m, m + 1)])))
    s = s.withColumns({"lng": F.col("lng0") + (F.col("x") + F.col("nx") * F.col("d")) / F.col("kx"), "lat": F.col("lat0") + (F.col("y") + F.col("ny") * F.col("d")) / 110540})
    e, nn = utm("lng", "lat", F.lit(epsg))
    s = s.withColumns({"_e": e, "_n": nn}).withColumns({"fx": (F.col("_e") - origin_x) / res - 0.5, "fy": (origin_y - F.col("_n")) / res - 0.5})
    s = s.withColumns({"ix": F.floor("fx").cast("int"), "iy": F.floor("fy").cast("int")})
    inside = (F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < width - 1) & (F.col("iy") < height - 1)
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    ax, ay = F.col("fx") - F.col("ix"), F.col("fy") - F.col("iy")
    c = s.where(inside).withColumn("c", corner).select(
        "way_id", "k", "n", "d", (F.col("ix") + F.col("c.i")).alias("ix"), (F.col("iy") + F.col("c.j")).alias("iy"),
        (F.when(F.col("c.i") == 1, ax).otherwise(1 - ax) * F.when(F.col("c.j") == 1, ay).otherwise(1 - ay)).alias("w"))
    p = c.join(pixels.select("ix", "iy", "prob"), ["ix", "iy"], "left").groupBy("way_id", "k", "n", "d").agg(F.sum(F.col("w") * F.coalesce("prob", F.lit(0.0))).alias("p"))
    # the first of equal scores wins, scanning from the left
    best = p.groupBy("way_id", "k", "n").agg(F.max(F.struct((F.col("p") - 0.004 * F.abs("d")).alias("s"), (-F.col("d")).alias("nd"), "p")).alias("b"))
    off = best.select("way_id", "k", "n", F.when(F.col("b.p") >= o["min_prob"], -F.col("b.nd")).alias("off"))
    sup = off.groupBy("way_id", "n").agg((F.count("off") / F.col("n")).alias("support")).where(F.col("support") >= o["min_support"]).select("way_id", "support")
    grid = tot.withColumn("n", F.greatest(F.lit(2), F.floor(F.col("len") / o["sample"] + 0.5) + 1).cast("int")).join(sup, "way_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    off = grid.join(off.select("way_id", "k", "off"), ["way_id", "k"], "left")
    w = W.partitionBy("way_id").orderBy("k")
    vals = F.array_sort(F.array_compact(F.collect_list("off").over(w.rowsBetween(-4, 4))))
    off = off.withColumn("med", F.try_element_at(vals, (F.floor(F.size(vals) / 2) + 1).cast("int")))
    known = F.when(F.col("med").isNotNull(), F.struct("k", "med"))
    off = off.withColumns({"_a": F.last(known, True).over(w.rowsBetween(W.unboundedPreceding, 0)), "_b": F.first(known, True).over(w.rowsBetween(0, W.unboundedFollowing))})
    lin = F.col("_a.med") + (F.col("_b.med") - F.col("_a.med")) * (F.col("k") - F.col("_a.k")) / F.nullif(F.col("_b.k") - F.col("_a.k"), F.lit(0))
    off = off.withColumn("fill", F.coalesce("med", lin, F.col("_a.med"), F.col("_b.med"))).withColumn("smooth", F.avg("fill").over(w.rowsBetween(-2, 2)))
    off = cut(off.select("way_id", "k", "n", "len", "support", "smooth"))
    rank = F.row_number().over(W.partitionBy("way_id").orderBy(F.abs("smooth")))
    shift = off.withColumn("_r", rank).where(F.col("_r") == F.floor(F.col("n") / 2) + 1).select("way_id", F.abs("smooth").alias("shift_m"), "support").where(F.col("shift_m") >= o["min_shift"])
    uses = vertices.groupBy("node_id").agg(F.count(F.lit(1)).alias("uses"))
    v = v.join(shift, "way_id").join(uses, "node_id").withColumn("_anchor", F.when((F.col("uses") > 1) | (F.col("seq") == 0) | (F.col("seq") == F.col("last")), F.col("along")))
    wa = W.partitionBy("way_id").orderBy("seq")
    dist = F.least(F.col("along") - F.last("_anchor", True).over(wa.rowsBetween(W.unboundedPreceding, 0)), F.first("_anchor", True).over(wa.rowsBetween(0, W.unboundedFollowing)) - F.col("along"))
    v = v.withColumns({"taper": F.least(F.lit(1.0), dist / o["taper"]), "nx_": F.lead("x").over(wa), "ny_": F.lead("y").over(wa), "n": n})
    f = F.col("along") / F.col("len") * (F.col("n") - 1)
    v = v.withColumn("_k", F.least(F.col("n") - 2, F.floor(f).cast("int"))).withColumn("_f", f - F.col("_k"))
    s0 = off.select("way_id", F.col("k").alias("_k"), F.col("smooth").alias("s0"))
    s1 = off.select("way_id", (F.col("k") - 1).alias("_k"), F.col("smooth").alias("s1"))
    v = v.join(s0, ["way_id", "_k"]).join(s1, ["way_id", "_k"])
    d = (F.col("s0") + (F.col("s1") - F.col("s0")) * F.col("_f")) * F.col("taper")
    bx, by = F.coalesce("nx_", "x") - F.coalesce("_px", "x"), F.coalesce("ny_", "y") - F.coalesce("_py", "y")
    ln = F.when(F.hypot(bx, by) > 0, F.hypot(bx, by)).otherwise(1.0)
    return v.select("way_id", "seq", (F.col("lng") - by / ln * d / F.col("kx")).alias("lng"), (F.col("lat") + bx / ln * d / 110540).alias("lat"), "shift_m", "support")


def merge_detections(gps: DataFrame, gps_lines: DataFrame, imagery: DataFrame, imagery_lines: DataFrame) -> DataFrame:
    """GPS trails with raised confidence where imagery agrees, plus unmatched imagery trails.

    An imagery line agrees with a GPS line when half of its 10 m samples lie within 25 m. (way_id, confidence, source).
    """
    samples = densify_lines(imagery_lines, "way_id", 10.0).withColumnRenamed("way_id", "im")
    n = samples.groupBy("im").agg(F.count(F.lit(1)).alias("n"))
    size = 0.001
    seg = segment_cells(line_segments(gps_lines, "way_id").select(F.col("way_id").alias("g"), "ax", "ay", "bx", "by"), size)
    mx = 111320 * F.cos(F.radians("lat"))
    reach = AGREE_M / 110000.0
    pts = box_cells(samples, F.col("lng") - reach / F.cos(F.radians("lat")), F.col("lat") - reach, F.col("lng") + reach / F.cos(F.radians("lat")), F.col("lat") + reach, size)
    dx, dy = (F.col("bx") - F.col("ax")) * mx, (F.col("by") - F.col("ay")) * 110540
    qx, qy = (F.col("lng") - F.col("ax")) * mx, (F.col("lat") - F.col("ay")) * 110540
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, clamp((qx * dx + qy * dy) / l2, 0.0, 1.0)).otherwise(0.0)
    near = pts.join(seg, ["_cx", "_cy"]).where(F.hypot(qx - t * dx, qy - t * dy) <= AGREE_M).select("im", "g", "seq", "part").distinct()
    agree = near.groupBy("im", "g").agg(F.count(F.lit(1)).alias("k")).join(n, "im").where(F.col("k") / F.col("n") >= AGREE_SHARE).select("im", "g")
    conf = agree.join(imagery.select(F.col("way_id").alias("im"), "confidence"), "im").groupBy("g").agg(
        F.min(1 - F.col("confidence")).alias("lo"), F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-300)))).alias("ls"))
    boosted = gps.join(conf.withColumnRenamed("g", "way_id"), "way_id", "left")
    miss = F.when(F.col("lo").isNull(), 1.0).when(F.col("lo") <= 0, 0.0).otherwise(F.exp("ls"))
    boosted = boosted.select("way_id", (1 - (1 - F.col("confidence")) * miss).alias("confidence"), F.when(F.col("lo").isNull(), "gps").otherwise("gps;imagery").alias("source"))
    rest = imagery.join(agree.select(F.col("im").alias("way_id")).distinct(), "way_id", "left_anti").select("way_id", "confidence", F.lit("imagery").alias("source"))
    return boosted.unionByName(rest)


def discovery_summary(trails: DataFrame, lines: DataFrame) -> DataFrame:
    """Trails and metres per scan and source."""
    m = line_segments(lines, "way_id").groupBy("way_id").agg(F.sum(haversine_m("ax", "ay", "bx", "by")).alias("m"))
    return trails.join(m, "way_id", "left").groupBy("scan_id", "source").agg(F.count(F.lit(1)).alias("trails"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("length_m"))


def nearby_ways(vertices: DataFrame, boxes: DataFrame, pad: float = 0.002, size: float = 0.01) -> DataFrame:
    """(scan_id, way_id) of ways with a vertex strictly inside the padded box."""
    b = box_cells(boxes.select("scan_id", "w", "s", "e", "n"), F.col("w") - pad, F.col("s") - pad, F.col("e") + pad, F.col("n") + pad, size)
    v = vertices.select("way_id", "lng", "lat").withColumns({"_cx": F.floor(F.col("lng") / size), "_cy": F.floor(F.col("lat") / size)})
    hit = ((F.col("lng") > F.col("w") - pad) & (F.col("lng") < F.col("e") + pad) & (F.col("lat") > F.col("s") - pad) & (F.col("lat") < F.col("n") + pad))
    return v.join(b, ["_cx", "_cy"]).where(hit).select("scan_id", "way_id").distinct()


PATCH, OVERLAP = 256, 24  # fixed values


def patch_grid(rasters: DataFrame, patch: int = PATCH, overlap: int = OVERLAP) -> DataFrame:
    """Patches per raster(raster_id, w, h): window px, py, pw, ph and owned range x0..x1, y0..y1 (exclusive)."""
    step = patch - 2 * overlap
    pw, ph = F.least(F.lit(patch), F.ceil(F.col("w") / 8) * 8).cast("int"), F.least(F.lit(patch), F.ceil(F.col("h") / 8) * 8).cast("int")
    r = rasters.withColumns({"pw": pw, "ph": ph})
    r = r.withColumn("y0", F.explode(F.sequence(F.lit(0), F.col("h") - 1, F.lit(step)))).withColumn("x0", F.explode(F.sequence(F.lit(0), F.col("w") - 1, F.lit(step))))
    px = F.greatest(F.lit(0), F.least(F.col("x0") - overlap, F.col("w") - F.col("pw")))
    py = F.greatest(F.lit(0), F.least(F.col("y0") - overlap, F.col("h") - F.col("ph")))
    r = r.withColumns({"px": px, "py": py})
    return r.withColumns({"ox": F.greatest("x0", "px"), "oy": F.greatest("y0", "py"), "x1": F.least(F.col("x0") + step, F.col("px") + F.col("pw"), F.col("w")),
                          "y1": F.least(F.col("y0") + step, F.col("py") + F.col("ph"), F.col("h"))})


def score_patches(patches: DataFrame, pixels: DataFrame, bands: list[str], infer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], patch: int = PATCH) -> DataFrame:
    """Runs a batch scorer over patch pixels and keeps the owned centre as probability.

    A patch is bounded (patch x patch pixels), so one array per patch and band is safe. `infer` maps batches
    with raster_id, x0, y0, pw, ph and band arrays to the same rows with an array column `logits`.
    """
    size = patch
    p = patches.select("raster_id", "x0", "y0", "px", "py", "pw", "ph")
    tiles = (p.withColumn("_tx", F.explode(F.sequence(F.floor(F.col("px") / size), F.floor((F.col("px") + F.col("pw") - 1) / size))))
             .withColumn("_ty", F.explode(F.sequence(F.floor(F.col("py") / size), F.floor((F.col("py") + F.col("ph") - 1) / size)))))
    px = pixels.withColumns({"_tx": F.floor(F.col("ix") / size), "_ty": F.floor(F.col("iy") / size)})
    j = tiles.join(px, ["raster_id", "_tx", "_ty"]).where(
        (F.col("ix") >= F.col("px")) & (F.col("ix") < F.col("px") + F.col("pw")) & (F.col("iy") >= F.col("py")) & (F.col("iy") < F.col("py") + F.col("ph")))
    pos = ((F.col("iy") - F.col("py")) * F.col("pw") + F.col("ix") - F.col("px")).cast("int")
    arr = j.groupBy("raster_id", "x0", "y0", "pw", "ph").agg(F.array_sort(F.collect_list(F.struct(pos.alias("pos"), *bands))).alias("v"))
    arr = arr.select("raster_id", "x0", "y0", "pw", "ph", F.col("v.pos").alias("pos"), *[F.col(f"v.{b}").alias(b) for b in bands])
    out = arr.mapInPandas(infer, "raster_id bigint, x0 int, y0 int, pos array<int>, logits array<double>")
    z = patches.select("raster_id", "x0", "y0", "px", "py", "pw", "ox", "oy", "x1", "y1").join(out, ["raster_id", "x0", "y0"])
    z = z.select("raster_id", "px", "py", "pw", "ox", "oy", "x1", "y1", F.explode(F.arrays_zip("pos", "logits")).alias("z"))
    ix, iy = F.col("px") + F.col("z.pos") % F.col("pw"), F.col("py") + F.floor(F.col("z.pos") / F.col("pw")).cast("int")
    z = z.withColumns({"ix": ix, "iy": iy}).where((F.col("ix") >= F.col("ox")) & (F.col("ix") < F.col("x1")) & (F.col("iy") >= F.col("oy")) & (F.col("iy") < F.col("y1")))
    return z.select("raster_id", "ix", "iy", (1 / (1 + F.exp(-F.col("z.logits")))).alias("prob"))


def normalize_bands(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Digital numbers to -1..1 model inputs."""
    return pixels.withColumns({b: clamp(F.col(b) * 1e-4 - 0.1, 0.0, 0.5) / 0.25 - 1 for b in bands})
