"""Trail network jobs: route membership, classification, overlays, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions import trails as R
from fellwalk.functions.geo import haversine_m, tile_x, tile_y
from fellwalk.operators import spatial as S

COLOR_NAMES = {v: k for k, v in R.MARK_COLORS.items()}


def parse_markings(relations: DataFrame) -> DataFrame:
    """Adds color and shape (null when the relation has no known colour) from symbol and colour."""
    color = R.marking_color(F.col("symbol"), F.col("colour"))
    return relations.withColumn("color", color).withColumn(
        "shape", F.when(F.col("color").isNotNull(), R.marking_shape(F.col("symbol"))))


def route_membership(members: DataFrame, relations: DataFrame) -> DataFrame:
    """way_id and its routes (id, name, color, shape) in relation order."""
    rel = parse_markings(relations).select(
        "rel_id", F.coalesce("name", "ref").alias("route_name"), "color", "shape")
    rows = members.select("rel_id", "way_id").distinct().join(rel, "rel_id")
    routes = F.array_sort(F.collect_list(F.struct(
        F.col("rel_id").alias("id"), F.col("route_name").alias("name"), "color", "shape")))
    return rows.groupBy("way_id").agg(routes.alias("routes"))


def classify_trails(ways: DataFrame, membership: DataFrame) -> DataFrame:
    """ways(way_id, tags) with kind, hidden score, difficulty, surface, grade, mtb, access, traffic, routes."""
    df = ways.join(membership, "way_id", "left").withColumn(
        "routes", F.coalesce("routes", F.array().cast(dict(membership.dtypes)["routes"])))
    in_route = F.size("routes") > 0
    road = R.tag("highway").isin(*R.ROAD_HIGHWAYS)
    df = df.withColumn("hidden_score", F.when(road, 0.0).otherwise(R.hidden_score(in_route)))
    return df.withColumns({
        "kind": R.trail_kind(in_route, F.col("hidden_score")), "difficulty": R.sac_level(),
        "surface_class": R.surface_class(), "track_grade": R.track_grade(), "mtb_scale": R.mtb_scale(),
        "access_foot": R.access("foot"), "access_bike": R.access("bike"), "access_moto": R.access("moto"),
        "car_traffic": R.car_traffic(), "name": R.tag("name"), "highway": R.tag("highway"),
        "source": F.lit("osm"), "confidence": F.lit(1.0)})


def classify_pois(nodes: DataFrame) -> DataFrame:
    return (nodes.withColumn("kind", R.poi_kind()).where(F.col("kind").isNotNull())
            .withColumns({"name": R.tag("name"), "ele": R.poi_elevation()}))


def upsert_elements(rows: DataFrame, key: str, load_order: str) -> DataFrame:
    """One row per id: the latest load wins (partial aggregation, no window)."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(load_order)).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def junctions(vertices: DataFrame) -> DataFrame:
    """Nodes used more than once over all ways."""
    return vertices.groupBy("node_id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


def tile_boxes(vertices: DataFrame, z: int = 11) -> DataFrame:
    """First and last tile (x0, x1, y0, y1) touched by the bbox of each way, both ends included."""
    zz = F.lit(z)
    return S.line_bbox(vertices, "way_id").select("way_id", tile_x("w", zz).alias("x0"), tile_x("e", zz).alias("x1"), tile_y("n", zz).alias("y0"), tile_y("s", zz).alias("y1"))


def _tiles(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))


def assign_cells(vertices: DataFrame, z: int = 11) -> DataFrame:
    """Every tile touched by the bbox of each way."""
    return _tiles(tile_boxes(vertices, z)).select("way_id", F.lit(z).alias("z"), "x", "y")


def overlay_alignment(vertices: DataFrame, aligned: DataFrame, enabled: bool = True) -> DataFrame:
    """Takes aligned coordinates for ways whose vertex count is unchanged; aligned(way_id, seq, lng, lat, shift_m)."""
    if not enabled:
        return vertices.withColumn("aligned_m", F.lit(None).cast("double"))
    n_old = vertices.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))
    n_new = aligned.groupBy("way_id").agg(F.count(F.lit(1)).alias("n"), F.max("shift_m").alias("aligned_m"))
    ok = n_old.join(n_new, ["way_id", "n"]).select("way_id", "aligned_m")
    new = aligned.join(ok, "way_id").select("way_id", "seq", F.col("lng").alias("_x"), F.col("lat").alias("_y"), "aligned_m")
    out = vertices.join(new, ["way_id", "seq"], "left")
    return out.withColumns({"lng": F.coalesce("_x", "lng"), "lat": F.coalesce("_y", "lat")}).drop("_x", "_y")


def union_detected(trails: DataFrame, detected: DataFrame, source: str) -> DataFrame:
    """Replaces all trails of `source` by the detected ones."""
    return trails.where(F.col("source") != source).unionByName(detected, allowMissingColumns=True)


def trails_in_view(trails: DataFrame, cells: DataFrame, views: DataFrame, kinds: list[str], max_cells: int | None = None,
                   z: int = 11) -> DataFrame:
    """view_id, way_id of the visible kinds. With `max_cells`, a display rule, views over more cells show nothing."""
    small = S.explode_tiles(views, F.lit(z), F.lit(z)).select("view_id", "x", "y")
    if max_cells is not None:
        n = small.groupBy("view_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_cells).select("view_id")
        small = small.join(n, "view_id")
    shown = trails.where(F.col("kind").isin(*kinds)).select("way_id", "kind")
    return small.join(cells.select("way_id", "x", "y"), ["x", "y"]).join(shown, "way_id").select(
        "view_id", "way_id", "kind").distinct()


def trails_per_view(trails: DataFrame, boxes: DataFrame, views: DataFrame, kinds: list[str], max_cells: int | None = None, z: int = 11) -> DataFrame:
    """view_id, kind, trails: the number of pairs of `trails_in_view`, without listing them. boxes as of `tile_boxes`.

    A view and a way both cover a rectangle of tiles. Views over the same tiles show the same ways, and ways of one kind
    over the same tiles are shown together, so only the distinct rectangles meet and the counts go back to the views.
    """
    own = S.explode_tiles(views, F.lit(z), F.lit(z)).groupBy("view_id").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    if max_cells is not None:
        own = own.where((F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1) <= max_cells)
    own = own.select("view_id", F.struct("x0", "x1", "y0", "y1").alias("view"))
    shown = trails.where(F.col("kind").isin(*kinds)).select("way_id", "kind").distinct()
    box = ["x0", "x1", "y0", "y1"]
    ways = _tiles(boxes.join(shown.hint("merge"), "way_id").groupBy("kind", *box).agg(F.count(F.lit(1)).alias("n")))
    seen = _tiles(own.select("view").distinct().select("view", "view.*")).select("view", "x", "y")
    pairs = seen.join(ways.hint("merge"), ["x", "y"]).select("view", "kind", *box, "n").distinct()
    counts = pairs.groupBy("view", "kind").agg(F.sum("n").alias("trails"))
    return own.join(counts, "view").select("view_id", "kind", "trails")


def first_marking() -> Column:
    return F.get(F.filter("routes", lambda r: r["color"].isNotNull()), F.lit(0))


def segment_info(trails: DataFrame) -> DataFrame:
    """Label of a trail: own or first route name, and a marking such as "red stripe"."""
    m = first_marking()
    color = R.choose(m["color"], COLOR_NAMES)
    shape = F.when(m["shape"] == "other", "mark").otherwise(m["shape"])
    return trails.withColumns({"label": F.coalesce(F.col("name"), F.get("routes", F.lit(0))["name"]),
                               "marking": F.when(color.isNotNull(), F.concat_ws(" ", color, shape))})


def leg_name(marking: Column, label: Column, kind: Column) -> Column:
    return F.coalesce(F.when(marking.isNotNull(), F.concat(F.lit("the "), marking, F.lit(" trail"))), label,
                      R.choose(kind, R.KIND_NAME, "the trail"))


def trail_length_by_cell(trails: DataFrame, vertices: DataFrame, z: int = 11) -> DataFrame:
    """Ways, metres and share of every trail kind per cell (cell of the way's first vertex)."""
    seg = S.line_segments(vertices, "way_id", keep=("node_id",))
    zz = F.lit(z)
    per_way = seg.groupBy("way_id").agg(
        F.sum(haversine_m("ax", "ay", "bx", "by")).alias("length_m"),
        F.min(F.struct("seq", F.col("ax").alias("lng"), F.col("ay").alias("lat"))).alias("f"))
    rows = per_way.join(trails.select("way_id", "kind", F.size("routes").alias("n_routes")), "way_id").select(
        tile_x("f.lng", zz).alias("x"), tile_y("f.lat", zz).alias("y"), "kind", "length_m", "n_routes")
    agg = rows.groupBy("x", "y", "kind").agg(F.count(F.lit(1)).alias("ways"), F.sum("length_m").alias("length_m"),
                                             F.sum("n_routes").alias("memberships"))
    total = F.sum("length_m").over(W.partitionBy("x", "y"))
    return agg.withColumn("share", F.when(total > 0, F.col("length_m") / total).otherwise(0.0))
