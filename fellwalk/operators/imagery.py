"""Scene ranking, compositing, pyramids and training tiles on pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions.geo import clamp, col, round_half_up, tile_lat, tile_lng, utm
from fellwalk.operators.cells import box_cells, offsets, square
from fellwalk.operators.spatial import bbox_join, in_country

# Score weights, masked classes, tone curve, vegetation ramp.
NODATA_WEIGHT, AGE_WEIGHT, SCENES_PER_GRID = 0.3, 0.08, 4
CLOUD_CLASSES = [1, 3, 8, 9, 10]
LOOK = {"black": 0.02, "white": 0.82, "gamma": 0.85, "saturation": 1.2}
NDVI_STOPS = [(-0.2, 70, 80, 110), (0.0, 150, 130, 100), (0.2, 215, 200, 120), (0.4, 160, 205, 90), (0.6, 70, 160, 60), (0.9, 10, 80, 30)]
WATER_KINDS = ["river", "stream", "canal", "drain", "ditch", "tidal_channel", "brook"]


def scene_score(scenes: DataFrame, now) -> DataFrame:
    """Lower is better: cloud, then swath gaps, then age in days.

    The terms are worked out in the order of the SQL twin, as scores that differ in the last bit decide ranks.
    """
    age_ms = F.unix_millis(col(now).cast("timestamp")) - F.unix_millis(F.col("acquired_at").cast("timestamp"))
    return scenes.withColumn("score", F.col("cloud") + NODATA_WEIGHT * F.col("nodata") + AGE_WEIGHT * age_ms / 86400000)


def best_scenes_per_grid(scenes: DataFrame, n: int = SCENES_PER_GRID) -> DataFrame:
    """The n best scenes of every grid square with their rank; Spark limits each group before the shuffle."""
    w = W.partitionBy("grid").orderBy("score", "id")
    return scenes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def paint_order(tiles: DataFrame, ranked: DataFrame, size: float = 0.5) -> DataFrame:
    """Scenes of each tile in paint order. tiles(tile columns, w, s, e, n), ranked scenes with w, s, e, n."""
    keys = [c for c in tiles.columns if c not in "wsen"]
    hit = bbox_join(tiles, ranked.select("id", "rank", "score", "w", "s", "e", "n"), size)
    w = W.partitionBy(*keys).orderBy("b_rank", "b_score", "b_id")
    return hit.select(*keys, F.col("b_id").alias("scene_id"), F.row_number().over(w).alias("paint"))


def imagery_dates(views: DataFrame, ranked: DataFrame, first: int | None = None) -> DataFrame:
    """Newest and oldest acquisition among the scenes painted in each view; `first` keeps a display to the first few."""
    o = paint_order(views, ranked)
    o = (o.where(F.col("paint") <= first) if first else o).join(ranked.select(F.col("id").alias("scene_id"), "acquired_at"), "scene_id")
    return o.groupBy("view_id").agg(F.max("acquired_at").alias("newest"), F.min("acquired_at").alias("oldest"))


def _covering(boxes: DataFrame, scenes: DataFrame, size: float = 0.5) -> DataFrame:
    """Box and extent pairs where the extent fully covers the box; the box meets extents at its corner's cell.

    Scenes of one grid square share their extent, so callers reduce the scenes of an extent first.
    """
    s = box_cells(scenes.select([F.col(c).alias(f"s_{c}") for c in scenes.columns]), "s_w", "s_s", "s_e", "s_n", size)
    b = boxes.withColumns({"_cx": F.floor(F.col("w") / size), "_cy": F.floor(F.col("s") / size)})
    return b.join(s, ["_cx", "_cy"]).where("s_w <= w and s_s <= s and s_e >= e and s_n >= n").drop("_cx", "_cy")


def clearest_summer_scene(boxes: DataFrame, scenes: DataFrame, max_nodata: float = 5.0) -> DataFrame:
    """Per box the clearest full scene, June to September first, then the newest. boxes(box_id, w, s, e, n)."""
    order = F.struct((~F.month("acquired_at").between(6, 9)).alias("off"), "cloud", (-F.unix_timestamp(F.col("acquired_at").cast("timestamp"))).alias("age"), "id")
    best = scenes.where(F.col("nodata") < max_nodata).groupBy("w", "s", "e", "n").agg(F.min(order).alias("best"))
    return _covering(boxes, best).groupBy("box_id").agg(F.min("s_best").alias("o")).select("box_id", F.col("o.id").alias("scene_id"))


def seasonal_scenes(boxes: DataFrame, scenes: DataFrame, n: int) -> DataFrame:
    """Up to n covering scenes from different months: the newest year's clearest of each month, clearest months first."""
    order = F.struct((-F.year("acquired_at")).alias("y"), "cloud", "id")
    best = scenes.groupBy("w", "s", "e", "n", F.month("acquired_at").alias("month")).agg(F.min(order).alias("best"))
    per = _covering(boxes, best).groupBy("box_id", F.col("s_month").alias("month")).agg(F.min("s_best").alias("b"))
    w = W.partitionBy("box_id").orderBy("b.y", "b.cloud", "b.id")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("box_id", "month", F.col("b.id").alias("scene_id"), "rank")


def tile_pixels(tiles: DataFrame, epsg: int, size: int = 256) -> DataFrame:
    """UTM position of every pixel centre of tiles(z, x, y)."""
    p = tiles.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    p = p.withColumns({"lng": tile_lng(F.col("x") + (F.col("px") + 0.5) / size, "z"), "lat": tile_lat(F.col("y") + (F.col("py") + 0.5) / size, "z")})
    e, n = utm("lng", "lat", F.lit(epsg))
    return p.select("z", "x", "y", "px", "py", e.alias("easting"), n.alias("northing"))


def choose_level(levels: DataFrame, target: str = "target_res") -> DataFrame:
    """Per scene and target the coarsest level at most 1 % coarser than needed, else level 0. levels(scene_id, level, res, target_res)."""
    ok = F.when(F.col("res") <= F.col(target) * 1.01, F.struct("res", "level"))
    best = levels.groupBy("scene_id", target).agg(F.max(ok).alias("b"))
    return best.select("scene_id", target, F.coalesce("b.level", F.lit(0)).alias("level"))


def window_for(df: DataFrame) -> DataFrame:
    """Pixel window x0, y0, x1, y1 with one pixel margin; disjoint rows are dropped. Needs origin_x/y, res, width, height and ext w, s, e, n in metres."""
    out = df.withColumns({
        "x0": F.greatest(F.lit(0), F.floor((F.col("w") - F.col("origin_x")) / F.col("res")) - 1), "x1": F.least("width", F.ceil((F.col("e") - F.col("origin_x")) / F.col("res")) + 1),
        "y0": F.greatest(F.lit(0), F.floor((F.col("origin_y") - F.col("n")) / F.col("res")) - 1), "y1": F.least("height", F.ceil((F.col("origin_y") - F.col("s")) / F.col("res")) + 1)})
    return out.where("x1 > x0 and y1 > y0")


def cloud_mask(pixels: DataFrame, scl: DataFrame) -> DataFrame:
    """Pixels whose class (mask pixels of twice the size) is not cloud, shadow or defect; outside the mask is clear."""
    p = pixels.withColumns({"_mx": F.floor(F.col("ix") / 2), "_my": F.floor(F.col("iy") / 2)})
    m = scl.select("scene_id", F.col("ix").alias("_mx"), F.col("iy").alias("_my"), "cls")
    return p.join(m, ["scene_id", "_mx", "_my"], "left").where(~F.coalesce(F.col("cls").isin(*CLOUD_CLASSES), F.lit(False))).drop("_mx", "_my", "cls")


def sample_scene(points: DataFrame, key: list[str], pixels: DataFrame, bands: list[str], nodata_max: float = 0.0) -> DataFrame:
    """Bilinear where all four neighbours hold data, else the nearest pixel, else no row.

    points(key, scene_id, sx, sy); pixels(scene_id, ix, iy, bands). A pixel is data when any band exceeds nodata_max.
    """
    valid = pixels.where(F.greatest(*bands) > nodata_max if len(bands) > 1 else F.col(bands[0]) > nodata_max)
    ix, iy = F.floor("sx").cast("int"), F.floor("sy").cast("int")
    ax, ay = F.col("sx") - ix, F.col("sy") - iy
    nx, ny = round_half_up("sx").cast("int"), round_half_up("sy").cast("int")
    corners = [F.struct((ix + i).alias("ix"), (iy + j).alias("iy"), ((ax if i else 1 - ax) * (ay if j else 1 - ay)).alias("w"),
                        ((ix + i == nx) & (iy + j == ny)).alias("near")) for i in (0, 1) for j in (0, 1)]
    rows = points.select(*key, "scene_id", F.explode(F.array(*corners)).alias("c")).select(*key, "scene_id", "c.*")
    g = rows.join(valid.select("scene_id", "ix", "iy", *bands), ["scene_id", "ix", "iy"]).groupBy(*key, "scene_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col("w") * F.col(b)).alias(f"_b_{b}") for b in bands], *[F.max(F.when(F.col("near"), F.col(b))).alias(f"_n_{b}") for b in bands])
    out = g.select(*key, "scene_id", *[F.when(F.col("_n") == 4, F.col(f"_b_{b}")).otherwise(F.col(f"_n_{b}")).alias(b) for b in bands])
    return out.where(F.col(bands[0]).isNotNull())


def composite_tiles(samples: DataFrame, pixel: list[str], bands: list[str]) -> DataFrame:
    """First valid sample per pixel in paint order (partial minimum, no window)."""
    best = samples.groupBy(*pixel).agg(F.min_by(F.struct(*bands), F.struct("paint", "scene_id")).alias("v"))
    return best.select(*pixel, "v.*")


def tone(v) -> Column:
    t = clamp((round_half_up(v) / 255 - LOOK["black"]) / (LOOK["white"] - LOOK["black"]), 0.0, 1.0)
    return round_half_up(255 * F.pow(t, F.lit(LOOK["gamma"])))


def true_color(px: DataFrame) -> DataFrame:
    """Toned and saturated r, g, b bytes from 0..255 inputs."""
    r, g, b = (tone(c) for c in ("r", "g", "b"))
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    out = {n: F.bround(clamp(luma + (c - luma) * LOOK["saturation"], 0, 255), 0).cast("int") for n, c in (("r", r), ("g", g), ("b", b))}
    return px.withColumns(out)


def ndvi(px: DataFrame) -> DataFrame:
    """Vegetation index, its 0..255 step and ramp colour from red and near-infrared digital numbers."""
    red, nir = F.greatest(F.lit(0.0), F.col("red") * 1e-4 - 0.1), F.greatest(F.lit(0.0), F.col("nir") * 1e-4 - 0.1)
    out = px.withColumn("ndvi", F.when(red + nir > 0, (nir - red) / (nir + red)).otherwise(0.0))
    out = out.withColumn("step", clamp(round_half_up((F.col("ndvi") + 0.2) / 1.1 * 255), 0, 255).cast("int"))
    v = -0.2 + F.col("step") / 255 * 1.1
    for k, name in enumerate("rgb", 1):
        c = None
        for a, b in zip(NDVI_STOPS, NDVI_STOPS[1:]):
            val = a[k] + (b[k] - a[k]) * clamp((v - a[0]) / (b[0] - a[0]), 0.0, 1.0)
            c = F.when(v <= b[0], val) if c is None else c.when(v <= b[0], val)
        out = out.withColumn(name, F.floor(c.otherwise(float(NDVI_STOPS[-1][k]))).cast("int"))
    return out


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of a text's code units as a long."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda h, c: ((h.bitwiseXOR(F.ascii(c).cast("bigint"))) * 16777619).bitwiseAND(4294967295)
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), step)


def scene_signature(order: DataFrame, keys: list[str]) -> DataFrame:
    """Base-36 hash of the ordered scene ids of each tile (a tile is painted by a handful of scenes)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paint", "scene_id"))), lambda s: s["scene_id"]), ",")
    return order.groupBy(*keys).agg(F.lower(F.conv(fnv1a(ids).cast("string"), 10, 36)).alias("signature"))


def stale_tiles(current: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles that are new or whose scenes changed."""
    old = manifest.select(*keys, F.col("signature").alias("_old"))
    return current.join(old, keys, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("signature"))).drop("_old")


def updated_manifest(current: DataFrame, manifest: DataFrame, rendered: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """New manifest: rendered tiles take the current signature, failed or empty ones leave it."""
    keep = manifest.join(rendered.unionByName(failed).distinct(), keys, "left_anti")
    return keep.unionByName(current.join(rendered, keys, "left_semi").join(failed, keys, "left_anti").select(keep.columns))


def dirty_ancestors(tiles: DataFrame, z0: int = 6) -> DataFrame:
    """Distinct parents of every tile(z, x, y) down to z0."""
    p = tiles.where(F.col("z") > z0).withColumn("pz", F.explode(F.sequence(F.lit(z0), F.col("z") - 1)))
    d = F.col("z") - F.col("pz")
    return p.select(F.col("pz").alias("z"), F.call_function("shiftright", "x", d).alias("x"), F.call_function("shiftright", "y", d).alias("y")).distinct()


def downsample_pyramid(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Parent pixels of absolute pixels(z, px, py, bands, a): alpha-weighted mean of the four children, missing ones clear."""
    g = pixels.groupBy((F.col("z") - 1).alias("z"), F.floor(F.col("px") / 2).alias("px"), F.floor(F.col("py") / 2).alias("py")).agg(
        *[(F.sum(F.col(b) * F.col("a")) / F.nullif(F.sum("a"), F.lit(0))).alias(b) for b in bands], (F.sum("a") / 4).alias("a"))
    return g


def sampling_regions(lattice: DataFrame, step: float, jitter: float, seed: int, validation: DataFrame, min_dist: float) -> DataFrame:
    """Jittered lattice points(gx, gy) inside the country and at least min_dist degrees from every validation point."""
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "gx", "gy"), F.lit(1 << 30)) / float(1 << 30) - 0.5
    p = lattice.select("gx", "gy", (F.col("gx") * step + u(1) * jitter).alias("lng"), (F.col("gy") * step + u(2) * jitter).alias("lat")).where(in_country())
    v = box_cells(validation.select(F.col("lng").alias("vx"), F.col("lat").alias("vy")), F.col("vx") - min_dist, F.col("vy") - min_dist, F.col("vx") + min_dist, F.col("vy") + min_dist, min_dist)
    q = p.withColumns({"_cx": F.floor(F.col("lng") / min_dist), "_cy": F.floor(F.col("lat") / min_dist)})
    close = q.join(v, ["_cx", "_cy"]).where((F.abs(F.col("lng") - F.col("vx")) < min_dist) & (F.abs(F.col("lat") - F.col("vy")) < min_dist)).select("gx", "gy").distinct()
    return p.join(close, ["gx", "gy"], "left_anti")


def burn_lines(segments: DataFrame, radius_px: float) -> DataFrame:
    """Pixels (tile, ix, iy) within radius of line pieces ax, ay, bx, by given in pixel units."""
    n = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) * 2)).cast("int")
    s = segments.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n")).cast("int")
    thin = s.select("tile", at("ax", "bx").alias("cx"), at("ay", "by").alias("cy")).distinct()
    r = math.ceil(radius_px)
    disc = [(x, y) for x, y in square(r) if x * x + y * y <= radius_px * radius_px + 0.25]
    return offsets(thin, disc).select("tile", F.col("cx").alias("ix"), F.col("cy").alias("iy")).distinct()


def label_pixels(pixels: DataFrame, segments: DataFrame, scl: DataFrame, bands: list[str], radius_px: float = 0.75) -> DataFrame:
    """Pixels with label (trail, no tunnels) and valid (clear class and all bands > 0); classes have twice the pixel size."""
    burnt = burn_lines(segments.where(~F.coalesce(F.col("tunnel"), F.lit(False))), radius_px).withColumn("_l", F.lit(1))
    p = pixels.withColumns({"_mx": F.floor(F.col("ix") / 2).cast("int"), "_my": F.floor(F.col("iy") / 2).cast("int")})
    p = p.join(scl.select("tile", F.col("ix").alias("_mx"), F.col("iy").alias("_my"), "cls"), ["tile", "_mx", "_my"], "left").join(burnt, ["tile", "ix", "iy"], "left")
    clear = ~F.coalesce(F.col("cls").isin(*CLOUD_CLASSES), F.lit(False))
    full = F.least(*bands) > 0 if len(bands) > 1 else F.col(bands[0]) > 0
    return p.select(*pixels.columns, F.coalesce("_l", F.lit(0)).alias("label"), (clear & full).alias("valid"))


def water_pixels(labels: DataFrame, waterways: DataFrame, radius_px: float = 1.0) -> DataFrame:
    """Adds water (no culverts) and reports overlap through the label column kept beside it."""
    w = waterways.where(F.col("kind").isin(*WATER_KINDS) & ~F.coalesce(F.col("culvert"), F.lit(False)))
    return labels.join(burn_lines(w, radius_px).withColumn("_w", F.lit(1)), ["tile", "ix", "iy"], "left").withColumn("water", F.coalesce("_w", F.lit(0))).drop("_w")


def training_tile_filter(labels: DataFrame, validation: list[str], min_side: int = 96, min_density: float = 0.009) -> DataFrame:
    """Tiles large and dense enough, with the split they belong to."""
    t = labels.groupBy("tile").agg(F.max("ix").alias("mx"), F.max("iy").alias("my"), F.avg(F.col("label").cast("double")).alias("density"))
    t = t.where((F.col("mx") + 1 >= min_side) & (F.col("my") + 1 >= min_side) & (F.col("density") >= min_density))
    return t.select("tile", "density", F.when(F.col("tile").isin(*validation), "validation").otherwise("train").alias("split"))


PIX = ["tile", "ix", "iy"]


def threshold_sweep(pred: DataFrame, label: DataFrame, water: DataFrame, thresholds: list[float], tol: int = 2) -> DataFrame:
    """Precision, recall, F1 and stream confusion per threshold, with +-tol pixel tolerance, and the best F1 flag.

    pred(tile, ix, iy, prob); label and water hold set pixels only.
    """
    p = pred.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where(F.col("prob") >= F.col("t")).select("t", *PIX)
    grow = lambda df, keys: offsets(df.withColumnsRenamed({"ix": "cx", "iy": "cy"}), square(tol)).select(*keys, F.col("cx").alias("ix"), F.col("cy").alias("iy")).distinct()
    near_label = grow(label.select(*PIX), ["tile"]).withColumn("_l", F.lit(1))
    near_pred = grow(p, ["t", "tile"]).withColumn("_p", F.lit(1))
    a = p.join(near_label, PIX, "left").join(water.select(*PIX).distinct().withColumn("_w", F.lit(1)), PIX, "left").groupBy("t").agg(
        F.count(F.lit(1)).alias("predicted"), F.count("_l").alias("hit"), F.count(F.when(F.col("_l").isNull(), F.col("_w"))).alias("stream"))
    lt = label.select(*PIX).withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    b = lt.join(near_pred, ["t", *PIX], "left").groupBy("t").agg(F.count(F.lit(1)).alias("labels"), F.count("_p").alias("found"))
    m = b.join(a, "t", "left").na.fill(0, ["predicted", "hit", "stream"])
    m = m.withColumns({"precision": F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0), "recall": F.col("found") / F.col("labels"),
                       "confusion": F.when(F.col("predicted") > 0, F.col("stream") / F.col("predicted")).otherwise(0.0)})
    pr = F.col("precision") + F.col("recall")
    m = m.withColumn("f1", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr).otherwise(0.0))
    top = m.agg(F.max(F.struct("f1", (-F.col("t")).alias("nt"))).alias("b")).select(F.col("b.nt").alias("nt")).scalar()
    return m.select("t", "precision", "recall", "f1", "confusion", (F.col("t") == -top).alias("best"))


def detector_eval(pred: DataFrame, label: DataFrame, water: DataFrame, threshold: float) -> DataFrame:
    return threshold_sweep(pred, label, water, [threshold]).drop("best")
