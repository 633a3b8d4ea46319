"""Tile, polygon, line and raster-sampling jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions.geo import (clamp, col, epsg_from_mgrs, ground_resolution, haversine_m, planar_km,
                                    round_half_up, tile_lat, tile_lng, tile_x, tile_xf, tile_y, tile_yf, utm)
from fellwalk.operators.cells import box_cells, segment_cells
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.ordered import CHUNK, running_sums, with_neighbour

# Outline of the country the data covers (lng, lat), closed.
COUNTRY_OUTLINE = [
    (22.15, 47.95), (22.9, 48.05), (24.0, 47.95), (24.9, 47.75), (26.6, 48.25), (27.4, 48.4),
    (28.2, 47.9), (28.1, 46.8), (28.2, 45.9), (28.6, 45.3), (29.7, 45.25), (29.55, 44.8),
    (28.6, 44.2), (28.55, 43.75), (27.7, 43.75), (27.0, 44.1), (25.4, 43.65), (24.2, 43.7),
    (22.9, 43.85), (22.4, 44.5), (21.4, 44.75), (21.35, 45.2), (20.3, 46.1), (21.2, 46.4),
    (21.6, 47.0), (22.0, 47.4), (22.15, 47.95),
]


def with_distance(df: DataFrame, a=("lng", "lat"), b=("lng2", "lat2"), alias: str = "dist_m") -> DataFrame:
    return df.withColumn(alias, haversine_m(*a, *b))


def with_planar_km(df: DataFrame, a=("lng", "lat"), b=("lng2", "lat2"), alias: str = "km") -> DataFrame:
    return df.withColumn(alias, planar_km(*a, *b))


def with_tile(df: DataFrame, z: int) -> DataFrame:
    return df.withColumns({"z": F.lit(z), "x": tile_x("lng", F.lit(z)), "y": tile_y("lat", F.lit(z)),
                           "xf": tile_xf("lng", F.lit(z)), "yf": tile_yf("lat", F.lit(z))})


def with_tile_bbox(df: DataFrame) -> DataFrame:
    return df.withColumns({"w": tile_lng("x", "z"), "s": tile_lat(F.col("y") + 1, "z"),
                           "e": tile_lng(F.col("x") + 1, "z"), "n": tile_lat("y", "z")})


def with_ground_resolution(df: DataFrame) -> DataFrame:
    return df.withColumn("m_per_px", ground_resolution("lat", "z"))


def explode_tiles(boxes: DataFrame, z0, z1) -> DataFrame:
    """One row per tile that covers each w/s/e/n box at zooms z0..z1 (z, x, y)."""
    edge = 1e-9
    rows = boxes.withColumn("z", F.explode(F.sequence(col(z0), col(z1))))
    x0, x1 = tile_x("w", "z"), F.floor(tile_xf("e", "z") - edge).cast("int")
    y0, y1 = tile_y("n", "z"), F.floor(tile_yf("s", "z") - edge).cast("int")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("x", F.explode(F.when(x1 >= x0, F.sequence(x0, x1)).otherwise(none)))
    return rows.withColumn("y", F.explode(F.when(y1 >= y0, F.sequence(y0, y1)).otherwise(none)))


def bbox_join(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that overlap strictly; columns of `b` carry the prefix b_."""
    right = b.select([F.col(c).alias(f"b_{c}") for c in b.columns])
    left = box_cells(a, "w", "s", "e", "n", size)
    right = box_cells(right, "b_w", "b_s", "b_e", "b_n", size)
    # a pair meets in several cells: keep it in the cell of its intersection's lower-left corner
    first_x = F.col("_cx") == F.floor(F.greatest("w", "b_w") / size)
    first_y = F.col("_cy") == F.floor(F.greatest("s", "b_s") / size)
    hit = ((F.col("w") < F.col("b_e")) & (F.col("e") > F.col("b_w"))
           & (F.col("s") < F.col("b_n")) & (F.col("n") > F.col("b_s")))
    return left.join(right.hint("merge"), ["_cx", "_cy"]).where(hit & first_x & first_y).drop("_cx", "_cy")


def with_utm(df: DataFrame, epsg="epsg") -> DataFrame:
    e, n = utm("lng", "lat", epsg)
    return df.withColumns({"easting": e, "northing": n})


def with_epsg_from_mgrs(df: DataFrame, grid: str = "grid") -> DataFrame:
    return df.withColumn("epsg", epsg_from_mgrs(grid))


def _crosses(lng, lat, x1, y1, x2, y2) -> Column:
    """A ray to the east of the point crosses the edge."""
    return ((col(y1) > col(lat)) != (col(y2) > col(lat))) & (
        col(lng) < col(x1) + (col(lat) - col(y1)) * (col(x2) - col(x1)) / (col(y2) - col(y1)))


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges (x1,y1)-(x2,y2) of closed rings given as poly_id, ring, seq, lng, lat with gap-free seq."""
    keys = ["poly_id", "ring"]
    nxt = with_neighbour(rings, keys, "seq", {"lng": "x2", "lat": "y2"}, offset=1)
    first = rings.where(F.col("seq") == 0).select(*keys, F.col("lng").alias("fx"), F.col("lat").alias("fy"))
    return nxt.join(first, keys).select(
        *keys, F.col("lng").alias("x1"), F.col("lat").alias("y1"),
        F.coalesce("x2", "fx").alias("x2"), F.coalesce("y2", "fy").alias("y2"))


def points_in_polygons(points: DataFrame, key: str, rings: DataFrame, size: float = 0.1) -> DataFrame:
    """(key, poly_id) for points inside a polygon: odd crossings of ring 0 and of no hole.

    Candidates meet on bbox cells; edges then join by polygon and latitude band,
    so a point only meets the edges at its own latitude.
    """
    boxes = rings.where("ring = 0").groupBy("poly_id").agg(
        F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"))
    cand = (box_cells(boxes, "w", "s", "e", "n", size)
            .join(points.select(key, "lng", "lat", F.floor(F.col("lng") / size).alias("_cx"),
                                F.floor(F.col("lat") / size).alias("_cy")).hint("merge"), ["_cx", "_cy"])
            .where(F.col("lng").between(F.col("w"), F.col("e")) & F.col("lat").between(F.col("s"), F.col("n")))
            .select(key, "lng", "lat", "poly_id", F.floor(F.col("lat") / size).alias("_band")))
    edges = ring_edges(rings)
    lo, hi = F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)
    edges = edges.withColumn("_band", F.explode(F.sequence(lo, hi)))
    odd = (cand.join(edges.hint("merge"), ["poly_id", "_band"])
           .where(_crosses("lng", "lat", "x1", "y1", "x2", "y2"))
           .groupBy(key, "poly_id", "ring").agg((F.count(F.lit(1)) % 2).alias("_odd")))
    return (odd.groupBy(key, "poly_id")
            .agg(F.max(F.when(F.col("ring") == 0, F.col("_odd"))).alias("_in"),
                 F.max(F.when(F.col("ring") > 0, F.col("_odd"))).alias("_hole"))
            .where((F.col("_in") == 1) & (F.coalesce("_hole", F.lit(0)) == 0)).select(key, "poly_id"))


def covered_cells(rings: DataFrame, size: float) -> DataFrame:
    """Distinct cells (_cx, _cy) that lie wholly inside a polygon: no edge of it touches them and their centre is inside."""
    boxes = rings.where("ring = 0").groupBy("poly_id").agg(
        F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"))
    edges = ring_edges(rings)
    ends = [F.col(a).alias(b) for a, b in (("x1", "ax"), ("y1", "ay"), ("x2", "bx"), ("y2", "by"))]
    rim = segment_cells(edges.select("poly_id", *ends), size).select("poly_id", "_cx", "_cy")
    inner = box_cells(boxes, "w", "s", "e", "n", size).select("poly_id", "_cx", "_cy").join(rim.hint("merge"), ["poly_id", "_cx", "_cy"], "left_anti")
    inner = inner.select("poly_id", "_cx", "_cy", ((F.col("_cx") + 0.5) * size).alias("lng"), ((F.col("_cy") + 0.5) * size).alias("lat"))
    lo, hi = F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)
    bands = edges.withColumn("_cy", F.explode(F.sequence(lo, hi)))
    odd = (inner.join(bands.hint("merge"), ["poly_id", "_cy"]).where(_crosses("lng", "lat", "x1", "y1", "x2", "y2"))
           .groupBy("poly_id", "_cx", "_cy", "ring").agg((F.count(F.lit(1)) % 2).alias("_odd")))
    sides = odd.groupBy("poly_id", "_cx", "_cy").agg(F.max(F.when(F.col("ring") == 0, F.col("_odd"))).alias("_in"), F.max(F.when(F.col("ring") > 0, F.col("_odd"))).alias("_hole"))
    return sides.where((F.col("_in") == 1) & (F.coalesce("_hole", F.lit(0)) == 0)).select("_cx", "_cy").distinct()


def in_country(lng="lng", lat="lat") -> Column:
    """Crossing parity over the fixed outline, as one expression."""
    total = F.lit(0)
    for (x1, y1), (x2, y2) in zip(COUNTRY_OUTLINE, COUNTRY_OUTLINE[1:]):
        if y1 != y2:
            total = total + _crosses(lng, lat, F.lit(x1), F.lit(y1), F.lit(x2), F.lit(y2)).cast("int")
    return total % 2 == 1


def filter_country(df: DataFrame) -> DataFrame:
    return df.where(in_country())


def filter_bbox_touches_country(boxes: DataFrame, margin: float = 0.08) -> DataFrame:
    """Keeps boxes of which any of 5x5 samples (padded by `margin`) is inside."""
    k = F.array(*[F.lit(i / 4) for i in range(5)])

    def inside(fx, fy):
        lng = F.col("w") - margin + (F.col("e") - F.col("w") + 2 * margin) * fx
        lat = F.col("s") - margin + (F.col("n") - F.col("s") + 2 * margin) * fy
        return in_country(lng, lat)

    return boxes.where(F.exists(k, lambda fx: F.exists(k, lambda fy: inside(fx, fy))))


def line_segments(vertices: DataFrame, line: str, seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive vertex pairs: line, seq (of the start), ax, ay, bx, by."""
    rows = with_neighbour(vertices, [line], seq, {"lng": "bx", "lat": "by"}, offset=1)
    return rows.where(F.col("bx").isNotNull()).select(
        line, seq, F.col("lng").alias("ax"), F.col("lat").alias("ay"), "bx", "by", *keep)


def line_length(vertices: DataFrame, line: str) -> DataFrame:
    seg = line_segments(vertices, line)
    return seg.groupBy(line).agg(F.sum(haversine_m("ax", "ay", "bx", "by")).alias("length_m"))


def line_bbox(vertices: DataFrame, line: str) -> DataFrame:
    return vertices.groupBy(line).agg(F.min("lng").alias("w"), F.min("lat").alias("s"),
                                      F.max("lng").alias("e"), F.max("lat").alias("n"))


def line_midpoint(vertices: DataFrame, line: str) -> DataFrame:
    n = vertices.groupBy(line).agg(F.floor(F.count(F.lit(1)) / 2).cast("int").alias("seq"))
    return vertices.join(n, [line, "seq"]).select(line, F.col("lng").alias("mid_lng"), F.col("lat").alias("mid_lat"))


def densify_lines(vertices: DataFrame, line: str, step_m: float) -> DataFrame:
    """Samples about every `step_m` metres: start of each piece, plus the last vertex."""
    seg = line_segments(vertices, line)
    n = F.greatest(F.lit(1), F.ceil(haversine_m("ax", "ay", "bx", "by") / step_m)).cast("int")
    last = vertices.groupBy(line).agg(F.max("seq").alias("seq"))
    tail = vertices.join(last, [line, "seq"]).select(line, "seq", F.lit(0).alias("part"), "lng", "lat")
    body = (seg.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select(line, "seq", "part",
                    (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("part") / F.col("n")).alias("lng"),
                    (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("part") / F.col("n")).alias("lat")))
    return body.unionByName(tail)


def snap_scan_boxes(views: DataFrame, max_span: float = 0.08) -> DataFrame:
    """View boxes reduced to square scan boxes on a 0.005 degree grid, distinct."""
    cx, cy = (F.col("w") + F.col("e")) / 2, (F.col("s") + F.col("n")) / 2
    half = F.least(F.lit(max_span), F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))) / 2

    def q(v):
        return round_half_up(v * 200) / 200

    return views.select(q(cx - half).alias("w"), q(cy - half).alias("s"), q(cx + half).alias("e"),
                        q(cy + half).alias("n")).distinct()


def sample_grid_bilinear(points: DataFrame, key: str, pixels: DataFrame, value: str, outside: str = "zero",
                         size: tuple[int, int] | None = None) -> DataFrame:
    """Bilinear value at fractional pixel positions fx, fy (pixel centres at integers).

    outside='zero': any missing neighbour gives 0. outside='clamp': the position is
    clamped to `size` first. Four equi-join rows per point, one partial sum.
    """
    fx, fy = F.col("fx"), F.col("fy")
    if outside == "clamp":
        w, h = size
        fx, fy = clamp(fx, 0.0, w - 1.001), clamp(fy, 0.0, h - 1.001)
    p = points.select(key, fx.alias("fx"), fy.alias("fy"))
    ix, iy = F.floor("fx").cast("int"), F.floor("fy").cast("int")
    ax, ay = F.col("fx") - ix, F.col("fy") - iy
    corners = F.array(*[F.struct((ix + dx).alias("ix"), (iy + dy).alias("iy"),
                                 ((ax if dx else 1 - ax) * (ay if dy else 1 - ay)).alias("wt"))
                        for dx in (0, 1) for dy in (0, 1)])
    rows = p.select(key, F.explode(corners).alias("c")).select(key, "c.*")
    got = (rows.join(pixels.select("ix", "iy", F.col(value).alias("_v")), ["ix", "iy"], "left")
           .groupBy(key).agg(F.sum(F.col("wt") * F.col("_v")).alias("_s"), F.count("_v").alias("_n")))
    return got.select(key, F.when(F.col("_n") == 4, F.col("_s")).otherwise(0.0).alias("value"))


def sample_grid_nearest(points: DataFrame, pixels: DataFrame, value: str) -> DataFrame:
    """Value of the pixel that contains fx, fy; 0 where there is none."""
    rows = points.withColumn("ix", F.floor("fx").cast("int")).withColumn("iy", F.floor("fy").cast("int"))
    return (rows.join(pixels.select("ix", "iy", F.col(value).alias("_v")), ["ix", "iy"], "left")
            .withColumn("value", F.coalesce("_v", F.lit(0.0))).drop("_v", "ix", "iy"))


def dem_zoom(boxes: DataFrame, zoom: int, max_tiles: int | None = None, floor: int = 8) -> DataFrame:
    """Sampling zoom per box: `zoom`, or with `max_tiles` the finest level up to it with at most so many tiles, not below `floor`."""
    if max_tiles is None:
        return boxes.withColumn("dem_zoom", F.lit(zoom))
    edge = 1e-9

    def tiles(z):
        nx = F.floor(tile_xf("e", z) - edge) - F.floor(tile_xf("w", z)) + 1
        ny = F.floor(tile_yf("s", z) - edge) - F.floor(tile_yf("n", z)) + 1
        return nx * ny

    pick = F.lit(floor)
    for z in range(floor + 1, zoom + 1):
        pick = F.when(tiles(F.lit(z)) <= max_tiles, F.lit(z)).otherwise(pick)
    return boxes.withColumn("dem_zoom", pick)


def elevation_lookup(points: DataFrame, key: str, dem: DataFrame, zooms: list[int], size: int = 256) -> DataFrame:
    """Bilinear elevation from the finest zoom that has the point's tile, else coarser, else null.

    `dem` rows are pixels (z, tx, ty, ix, iy, ele). One explode over zooms and
    corners, one equi-join, one aggregation.
    """
    corners = F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (0, 1) for y in (0, 1)])
    rows = (points.select(key, "lng", "lat")
            .withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
            .withColumns({"xf": tile_xf("lng", "z"), "yf": tile_yf("lat", "z")})
            .withColumns({"tx": F.floor("xf").cast("int"), "ty": F.floor("yf").cast("int")})
            .withColumns({"px": clamp((F.col("xf") - F.col("tx")) * size - 0.5, 0.0, size - 1.001),
                          "py": clamp((F.col("yf") - F.col("ty")) * size - 0.5, 0.0, size - 1.001)})
            .withColumn("c", F.explode(corners)))
    ax, ay = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    rows = rows.select(
        key, "z", "tx", "ty", (F.floor("px") + F.col("c.dx")).cast("int").alias("ix"), (F.floor("py") + F.col("c.dy")).cast("int").alias("iy"),
        (F.when(F.col("c.dx") == 1, ax).otherwise(1 - ax) * F.when(F.col("c.dy") == 1, ay).otherwise(1 - ay)).alias("wt"))
    per_zoom = (rows.join(dem.hint("merge"), ["z", "tx", "ty", "ix", "iy"])
                .groupBy(key, "z").agg(F.sum(F.col("wt") * F.col("ele")).alias("ele"), F.count("ele").alias("n"))
                .where("n = 4"))
    best = per_zoom.groupBy(key).agg(F.max_by("ele", "z").alias("ele"))
    return points.join(best.hint("merge"), key, "left")


def fill_elevation_gaps(path: DataFrame, keys: list[str], seq: str = "seq", ele: str = "ele") -> DataFrame:
    """Last known height carried forward, first known height carried backward, in fixed-length pieces."""
    rows = path.withColumn("_b", F.floor(F.col(seq) / CHUNK))
    known = F.when(F.col(ele).isNotNull(), F.struct(F.col(seq).alias("s"), F.col(ele).alias("v")))
    ends = rows.groupBy(*keys, "_b").agg(F.max(known).alias("_last"), F.min(known).alias("_first"))
    wb = W.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*keys, "_b",
                       F.max("_last").over(wb.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
                       F.min("_first").over(W.partitionBy(*keys)).alias("_head"))
    w = W.partitionBy(*keys, "_b").orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(ends.hint("merge"), [*keys, "_b"])
            .withColumn(f"{ele}_filled", F.coalesce(F.last(ele, True).over(w), F.col("_carry.v"), F.col("_head.v")))
            .drop("_b", "_carry", "_head"))


def simplify_lines(vertices: DataFrame, line: str, tol: float, x: str = "lng", y: str = "lat",
                   metric: str = "line", max_rounds: int = 64) -> DataFrame:
    """Douglas-Peucker over all lines at once: the kept vertices.

    Every round splits each open stretch at its farthest vertex. metric='line' is
    the distance to the infinite chord, metric='segment' to the clamped segment.
    """
    ends = vertices.groupBy(line).agg(
        F.min(F.struct("seq", x, y)).alias("_a"), F.max(F.struct("seq", x, y)).alias("_b"))
    pts = vertices.select(line, "seq", F.col(x).alias("_x"), F.col(y).alias("_y")).join(ends, line)
    edge = (F.col("seq") == F.col("_a.seq")) | (F.col("seq") == F.col("_b.seq"))
    kept = cut(pts.where(edge).select(line, "seq"))
    state = cut(pts.where(~edge).select(
        line, "seq", "_x", "_y", F.col("_a.seq").alias("a"), F.col(f"_a.{x}").alias("ax"), F.col(f"_a.{y}").alias("ay"),
        F.col("_b.seq").alias("b"), F.col(f"_b.{x}").alias("bx"), F.col(f"_b.{y}").alias("by")))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    l2 = dx * dx + dy * dy
    if metric == "line":
        norm = F.when(l2 > 0, F.sqrt(l2)).otherwise(1.0)
        d = F.abs(dy * F.col("_x") - dx * F.col("_y") + F.col("bx") * F.col("ay") - F.col("by") * F.col("ax")) / norm
    else:
        t = F.when(l2 > 0, clamp(((F.col("_x") - F.col("ax")) * dx + (F.col("_y") - F.col("ay")) * dy) / l2, 0.0, 1.0)).otherwise(0.0)
        d = F.hypot(F.col("_x") - F.col("ax") - t * dx, F.col("_y") - F.col("ay") - t * dy)
    picked = [kept]
    for _ in range(max_rounds):
        far = (state.withColumn("_d", d).groupBy(line, "a")
               .agg(F.max(F.struct(F.col("_d").alias("d"), (-F.col("seq")).alias("ns"), F.col("_x").alias("x"),
                                   F.col("_y").alias("y"))).alias("f"))
               .where(F.col("f.d") > tol)
               .select(line, "a", (-F.col("f.ns")).alias("fs"), F.col("f.x").alias("fx"), F.col("f.y").alias("fy")))
        far = cut(far)
        if far.isEmpty():
            break
        picked.append(far.select(line, F.col("fs").alias("seq")))
        left = F.col("seq") < F.col("fs")
        state = cut(state.join(far, [line, "a"]).where(F.col("seq") != F.col("fs")).select(
            line, "seq", "_x", "_y",
            F.when(left, F.col("a")).otherwise(F.col("fs")).alias("a"),
            F.when(left, F.col("ax")).otherwise(F.col("fx")).alias("ax"),
            F.when(left, F.col("ay")).otherwise(F.col("fy")).alias("ay"),
            F.when(left, F.col("fs")).otherwise(F.col("b")).alias("b"),
            F.when(left, F.col("fx")).otherwise(F.col("bx")).alias("bx"),
            F.when(left, F.col("fy")).otherwise(F.col("by")).alias("by")))
    else:
        raise RuntimeError("simplification did not settle")
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return vertices.join(out, [line, "seq"], "left_semi")


def cumulative_distance(vertices: DataFrame, line: str) -> DataFrame:
    """Vertices with metres from the first vertex (cum_m)."""
    rows = with_neighbour(vertices, [line], "seq", {"lng": "_px", "lat": "_py"}, offset=-1)
    rows = rows.withColumn("step_m", F.coalesce(haversine_m("_px", "_py", "lng", "lat"), F.lit(0.0))).drop("_px", "_py")
    return running_sums(rows, [line], ["seq"], {"step_m": "cum_m"}, F.floor(F.col("seq") / CHUNK))
