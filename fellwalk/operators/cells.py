"""Spatial joins through integer cell keys.

Both sides get a cell key, so Spark runs an equi-join (adaptive execution splits
skewed cells) and the exact predicate runs as a residual. No bare theta joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellwalk.functions.geo import col, haversine_m, segment_projection

METRES_PER_DEGREE = 111320.0
_SLACK = 1.002  # the sphere used for exact distances has 111195 m per degree


def cell_of(c, size: float) -> Column:
    return F.floor(col(c) / size).cast("long")


def box_cells(df: DataFrame, w, s, e, n, size: float) -> DataFrame:
    """One row per cell that the box touches, columns _cx and _cy."""
    xs = F.sequence(cell_of(w, size), cell_of(e, size))
    ys = F.sequence(cell_of(s, size), cell_of(n, size))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def reach_cells(df: DataFrame, lng: str, lat: str, radius_m: float, size: float) -> DataFrame:
    """One row per cell that a disc of `radius_m` around the point may touch, at any latitude."""
    dy = radius_m * _SLACK / 111195.0
    dx = F.lit(dy) / F.cos(F.radians(F.least(F.abs(col(lat)) + dy, F.lit(89.0))))
    return box_cells(df, col(lng) - dx, col(lat) - dy, col(lng) + dx, col(lat) + dy, size)


def own_cell(df: DataFrame, lng: str, lat: str, size: float) -> DataFrame:
    return df.withColumn("_cx", cell_of(lng, size)).withColumn("_cy", cell_of(lat, size))


def nearest_points(points: DataFrame, key: str, targets: DataFrame, target_id: str, max_m: float,
                   steps: tuple[float, ...] = (0.125, 1.0)) -> DataFrame:
    """Nearest target strictly within `max_m` per point: key, target_id, dist_m.

    Points and targets carry lng/lat. Targets at one position collapse to the
    smallest id first. A short search radius runs first and only points it
    leaves open search the full radius, so pairs stay local in dense places.
    """
    uniq = targets.groupBy(F.col("lng").alias("_tx"), F.col("lat").alias("_ty")).agg(
        F.min(target_id).alias("_tid"))
    state = points.select(F.col(key), "lng", "lat").withColumn(
        "_best", F.lit(None).cast(f"struct<d:double,id:{dict(targets.dtypes)[target_id]}>"))
    for share in steps:
        r = max_m * share
        size = r / METRES_PER_DEGREE
        open_ = state.where(F.col("_best").isNull())
        pairs = (reach_cells(open_, "lng", "lat", r, size)
                 .join(own_cell(uniq, "_tx", "_ty", size).hint("merge"), ["_cx", "_cy"])
                 .withColumn("_d", haversine_m("lng", "lat", "_tx", "_ty"))
                 .where(F.col("_d") < r))
        hit = pairs.groupBy(key).agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_tid").alias("id"))).alias("_hit"))
        state = state.join(hit.hint("merge"), key, "left").select(
            key, "lng", "lat", F.coalesce("_best", "_hit").alias("_best"))
    return state.where(F.col("_best").isNotNull()).select(
        key, F.col("_best.id").alias(target_id), F.col("_best.d").alias("dist_m"))


def segment_cells(segments: DataFrame, size: float) -> DataFrame:
    """Segments ax, ay, bx, by with one row per cell they may touch.

    Long segments are cut into pieces no longer than a cell first, so the number
    of rows grows with the length and not with the area of the bounding box.
    """
    span = F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")))
    n = F.greatest(F.lit(1), F.ceil(span / size)).cast("int")
    rows = segments.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a, b, k):
        return F.col(a) + (F.col(b) - F.col(a)) * k / F.col("_n")

    x0, x1 = at("ax", "bx", F.col("_i")), at("ax", "bx", F.col("_i") + 1)
    y0, y1 = at("ay", "by", F.col("_i")), at("ay", "by", F.col("_i") + 1)
    eps = size * 1e-6
    out = box_cells(rows, F.least(x0, x1) - eps, F.least(y0, y1) - eps, F.greatest(x0, x1) + eps, F.greatest(y0, y1) + eps, size)
    return out.drop("_n", "_i").distinct()


def nearest_segments(points: DataFrame, key: str, segments: DataFrame, seg_cols: list[str], max_m: float,
                     ky: float = 110540.0, kx: float = 111320.0) -> DataFrame:
    """Closest segment within `max_m` per point, planar metric around the point's latitude.

    Points carry lng/lat; segments ax, ay, bx, by and `seg_cols` (also the tie
    order, at micrometre precision). Every pair is reduced by a partial minimum before it is shuffled.
    """
    size = max(max_m, 25.0) / METRES_PER_DEGREE
    seg = segment_cells(segments.select("ax", "ay", "bx", "by", *seg_cols), size)
    pts = reach_cells(points.select(key, "lng", "lat"), "lng", "lat", max_m * 1.01, size)
    m_x = F.cos(F.radians("lat")) * kx
    t, d = segment_projection(F.lit(0.0), F.lit(0.0), (F.col("ax") - F.col("lng")) * m_x, (F.col("ay") - F.col("lat")) * ky,
                              (F.col("bx") - F.col("lng")) * m_x, (F.col("by") - F.col("lat")) * ky)
    pairs = pts.join(seg.hint("merge"), ["_cx", "_cy"]).withColumn("_d", d).where(F.col("_d") <= max_m)
    best = pairs.withColumn("_t", t).groupBy(key).agg(F.min(F.struct(
        F.round("_d", 6).alias("d"), *[F.col(c) for c in seg_cols], F.col("_t").alias("t"),
        (F.col("ax") + F.col("_t") * (F.col("bx") - F.col("ax"))).alias("sx"),
        (F.col("ay") + F.col("_t") * (F.col("by") - F.col("ay"))).alias("sy"))).alias("_m"))
    return best.select(key, *[F.col(f"_m.{c}").alias(c) for c in seg_cols], F.col("_m.t").alias("t"),
                       F.col("_m.d").alias("dist_m"), F.col("_m.sx").alias("snap_lng"), F.col("_m.sy").alias("snap_lat"))


def _near_pairs(x: np.ndarray, y: np.ndarray, ends: np.ndarray, max_m: float, ky: float, kx: float) -> Iterator[tuple[int, np.ndarray]]:
    """Per point the segments (columns of `ends`) within max_m that may be its nearest, two micrometres of slack kept.

    Points are halved down to single ones. A box of points with half diagonal h keeps the segments at most 2h farther
    from its middle than the nearest one: every point in the box has that one nearer than any other segment.
    """
    m = np.cos(np.radians(y)) * kx
    todo = [(np.arange(len(x)), ends, np.arange(ends.shape[1]))]
    while todo:
        own, (ax, ay, bx, by), ids = todo.pop()
        (w, e), (s, n) = ((v[own].min(), v[own].max()) for v in (x, y))
        one = len(own) == 1
        cx, cy = (w, s) if one else ((w + e) / 2, (s + n) / 2)
        mx = m[own].max()
        skew = 0.0 if one else mx / m[own].min() - 1  # a point's metric against the box's
        h = math.hypot((e - w) * mx, (n - s) * ky) / 2
        px, py, dx, dy = (ax - cx) * mx, (ay - cy) * ky, (bx - ax) * mx, (by - ay) * ky
        t = np.clip(-(px * dx + py * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0.0, 1.0)
        d = np.hypot(px + t * dx, py + t * dy)
        keep = np.flatnonzero(d <= min(d.min() + 2 * h, max_m + h) * (1 + 4 * skew) + 2e-6)
        if not len(keep):
            continue
        if one:
            yield own[0], ids[keep]
            continue
        left = (ax[keep], ay[keep], bx[keep], by[keep]), ids[keep]
        along = x if (e - w) * mx >= (n - s) * ky else y
        own = own[np.argsort(along[own], kind="stable")]
        todo += [(half, *left) for half in np.array_split(own, 2)]


def nearest_segments_dense(points: DataFrame, key: str, segments: DataFrame, seg_cols: list[str], max_m: float,
                           ky: float = 110540.0, kx: float = 111320.0, size: float = 50.0 / METRES_PER_DEGREE) -> DataFrame:
    """(key, *seg_cols) as `nearest_segments` gives it, where so many segments lie within max_m that pairs cannot be listed.

    Equal positions are searched once. A segment goes to the cells of points that it may reach, and inside a cell
    bounds leave out what is not nearest; the few pairs left are measured as in `nearest_segments`.
    """
    places = points.select("lng", "lat").distinct()
    own = own_cell(places, "lng", "lat", size)
    box = own.agg(F.min("lng").alias("_w"), F.max("lng").alias("_e"), F.min("lat").alias("_s"), F.max("lat").alias("_n"))
    dy = max_m * 1.01 / ky
    dx = F.lit(dy * ky / kx) / F.cos(F.radians(F.least(F.greatest(F.abs("_s"), F.abs("_n")) + dy, F.lit(89.0))))
    box = box.select(F.col("_w") - dx, F.col("_s") - dy, F.col("_e") + dx, F.col("_n") + dy, dx).first()
    if box[0] is None:
        return points.select(key, *[F.lit(None).cast(t).alias(c) for c, t in segments.select(*seg_cols).dtypes]).where(F.lit(False))
    w, s, e, n, dx = box
    # columns of cells that a segment reaches, then in each the rows between its heights there
    lo, hi = F.least("ax", "bx") - dx, F.greatest("ax", "bx") + dx
    rows = segments.select("ax", "ay", "bx", "by", *seg_cols).where((lo <= e) & (hi >= w) & (F.least("ay", "by") <= n) & (F.greatest("ay", "by") >= s))
    rows = rows.withColumn("_cx", F.explode(F.sequence(cell_of(F.greatest(lo, F.lit(w)), size), cell_of(F.least(hi, F.lit(e)), size))))

    def height(x):
        t = F.when(F.col("ax") == F.col("bx"), F.lit(None)).otherwise((x - F.col("ax")) / (F.col("bx") - F.col("ax")))
        return F.col("ay") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (F.col("by") - F.col("ay"))

    sides = [F.coalesce(height(F.col("_cx") * size - dx), F.col("ay")), F.coalesce(height((F.col("_cx") + 1) * size + dx), F.col("by"))]
    flat = F.col("ax") == F.col("bx")
    low = F.greatest(F.when(flat, F.least("ay", "by")).otherwise(F.least(*sides)) - dy, F.lit(s))
    high = F.least(F.when(flat, F.greatest("ay", "by")).otherwise(F.greatest(*sides)) + dy, F.lit(n))
    rows = rows.withColumns({"_lo": cell_of(low, size), "_hi": cell_of(high, size)}).where("_lo <= _hi")
    rows = rows.withColumn("_cy", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    rows = rows.join(own.select("_cx", "_cy").distinct().hint("merge"), ["_cx", "_cy"], "left_semi")
    kept = [f.name for f in rows.schema if f.name not in ("_cx", "_cy")]

    def pairs(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        hits = list(_near_pairs(p["lng"].to_numpy(), p["lat"].to_numpy(), q[["ax", "ay", "bx", "by"]].to_numpy().T.copy(), max_m, ky, kx)) if len(p) and len(q) else []
        at = np.repeat([i for i, _ in hits], [len(k) for _, k in hits]).astype(int)
        out = q[kept].iloc[np.concatenate([k for _, k in hits]) if hits else []].reset_index(drop=True)
        return pd.concat([p[["lng", "lat"]].iloc[at].reset_index(drop=True), out], axis=1)

    schema = "lng double, lat double, " + ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept)
    near = own.groupBy("_cx", "_cy").cogroup(rows.groupBy("_cx", "_cy")).applyInPandas(pairs, schema)
    m_x = F.cos(F.radians("lat")) * kx
    _, d = segment_projection(F.lit(0.0), F.lit(0.0), (F.col("ax") - F.col("lng")) * m_x, (F.col("ay") - F.col("lat")) * ky,
                              (F.col("bx") - F.col("lng")) * m_x, (F.col("by") - F.col("lat")) * ky)
    best = near.withColumn("_d", d).where(F.col("_d") <= max_m).groupBy("lng", "lat").agg(
        F.min(F.struct(F.round("_d", 6).alias("d"), *[F.col(c) for c in seg_cols])).alias("_m"))
    best = best.select("lng", "lat", *[F.col(f"_m.{c}").alias(c) for c in seg_cols])
    return points.select(key, "lng", "lat").join(best.hint("merge"), ["lng", "lat"]).select(key, *seg_cols)


def offsets(df: DataFrame, pairs: list[tuple[int, int]], cx: str = "cx", cy: str = "cy") -> DataFrame:
    """Each cell copied to its offset positions; columns _dx, _dy tell the offset used."""
    arr = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs])
    out = df.withColumn("_off", F.explode(arr))
    return (out.withColumn(cx, (F.col(cx) + F.col("_off.x")).cast("int"))
            .withColumn(cy, (F.col(cy) + F.col("_off.y")).cast("int"))
            .withColumn("_dx", F.col("_off.x")).withColumn("_dy", F.col("_off.y")).drop("_off"))


def square(r: int) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-r, r + 1) for x in range(-r, r + 1)]


def ring8() -> list[tuple[int, int]]:
    return [p for p in square(1) if p != (0, 0)]


def degrees_for(metres: float) -> float:
    return metres / METRES_PER_DEGREE


def cos_deg(lat: float) -> float:
    return math.cos(math.radians(lat))
