"""GeoJSON sinks for trails and points of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellwalk.functions.geo import round_half_up
from fellwalk.functions.trails import choose, tag

# Line colour per trail kind.
KIND_COLORS = {"marked": "#d7263d", "path": "#f3e6c4", "track": "#d9a55b", "road": "#e8e8e8", "hidden": "#ff5fc8", "detected": "#35e0ff"}


def mark_id(m: Column) -> Column:
    return F.coalesce(F.concat(F.lit("mark-"), F.lower(F.replace(m["color"], F.lit("#"), F.lit(""))), F.lit("-"), m["shape"]), F.lit(""))


def trail_properties(trails: DataFrame) -> DataFrame:
    """The properties a map needs for every trail, one column each."""
    first = F.get("routes", F.lit(0))
    marked = F.filter("routes", lambda r: r["color"].isNotNull())
    empty = F.lit("")
    return trails.select(
        F.col("way_id").alias("wayId"), "kind", F.coalesce(tag("footway").isin("sidewalk", "crossing").cast("int"), F.lit(0)).alias("sidewalk"),
        F.coalesce("name", first["name"], empty).alias("name"), F.col("hidden_score").alias("hidden"), "difficulty",
        F.coalesce(first["color"], choose(F.col("kind"), KIND_COLORS)).alias("color"),
        F.coalesce(F.when(first["color"].isNotNull(), first["shape"]), empty).alias("shape"),
        mark_id(F.get(marked, F.lit(0))).alias("mark1"), mark_id(F.get(marked, F.lit(1))).alias("mark2"),
        F.array_join(F.filter(F.transform("routes", lambda r: r["name"]), lambda n: F.coalesce(n, empty) != ""), " · ").alias("routes"),
        F.col("surface_class").alias("surface"), F.col("track_grade").alias("grade"), F.col("mtb_scale").alias("mtb"),
        F.col("access_foot").alias("foot"), F.col("access_bike").alias("bike"), F.col("access_moto").alias("moto"), "source", "confidence",
        F.coalesce(tag("detected:usage"), empty).alias("usage"), F.coalesce(round_half_up("aligned_m"), F.lit(0)).alias("aligned"),
        F.coalesce(tag("detected:sources"), F.col("source")).alias("sources"))


def trail_features(trails: DataFrame, geometry: DataFrame) -> DataFrame:
    """Feature documents; geometry(way_id, coords) holds one bounded vertex array per way."""
    props = trail_properties(trails)
    names = [c for c in props.columns]
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("wayId").alias("id"),
                             F.struct(F.lit("LineString").alias("type"), F.col("coords").alias("coordinates")).alias("geometry"),
                             F.struct(*names).alias("properties")))
    return props.join(geometry.withColumnRenamed("way_id", "wayId"), "wayId").select("wayId", doc.alias("value"))


def write_trails_geojson(trails: DataFrame, geometry: DataFrame, out: str) -> None:
    trail_features(trails, geometry).select("value").write.mode("overwrite").text(out)


def poi_label() -> Column:
    ele = F.when(F.col("ele") != 0, F.concat(round_half_up("ele").cast("string"), F.lit(" m")))
    return F.concat_ws(" ", F.nullif("name", F.lit("")), ele)


def poi_features(pois: DataFrame) -> DataFrame:
    doc = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id"),
                             F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"),
                             F.struct("id", "kind", F.coalesce("name", F.lit("")).alias("name"), F.col("label")).alias("properties")))
    return pois.withColumn("label", poi_label()).withColumn("value", doc)


def write_pois_geojson(pois: DataFrame, out: str) -> None:
    poi_features(pois).select("value").write.mode("overwrite").text(out)
