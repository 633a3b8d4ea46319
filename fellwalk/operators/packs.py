"""Tile package planning and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellwalk.operators.fixpoint import cut
from fellwalk.operators.spatial import bbox_join, explode_tiles, filter_bbox_touches_country, with_tile_bbox


# Kilobytes per tile of each layer, size limit of ad-hoc areas.
TILE_KB = {"imagery": 26, "terrain": 70, "labels": 28, "hires": 30, "cells": 90}
AREA_MAX_TILES = 4000
CLIP_MARGIN = 0.02


def pack_tiles(packs: DataFrame) -> DataFrame:
    """One row per pack, layer and tile. packs(pack_id, kind, w, s, e, n, layers array<struct<layer,z0,z1>>); country packs are clipped."""
    layers = F.concat("layers", F.array(F.struct(F.lit("cells").alias("layer"), F.lit(11).alias("z0"), F.lit(11).alias("z1"))))
    p = packs.withColumn("l", F.explode(layers)).select("pack_id", "kind", "l.layer", "l.z0", "l.z1", "w", "s", "e", "n")
    t = explode_tiles(p, F.col("z0"), F.col("z1")).select("pack_id", "kind", "layer", "z", "x", "y")
    whole = t.where("kind <> 'country'")
    # materialised, as Spark would move the outline test before the distinct and so to every pack's copy of a tile
    tiles = cut(t.where("kind = 'country'").select("z", "x", "y").distinct())
    inside = cut(filter_bbox_touches_country(with_tile_bbox(tiles), CLIP_MARGIN).select("z", "x", "y"))
    return whole.unionByName(t.where("kind = 'country'").join(inside, ["z", "x", "y"], "left_semi").select(whole.columns))


def plan_packs(tiles: DataFrame, static_max_zoom: int) -> DataFrame:
    """Tiles, rendered tiles and size estimate per pack."""
    kb = F.lit(0)
    for layer, size in TILE_KB.items():
        kb = F.when(F.col("layer") == layer, size).otherwise(kb)
    return tiles.groupBy("pack_id", "kind").agg(
        F.count(F.lit(1)).alias("tiles"), F.sum(F.when((F.col("layer") == "imagery") & (F.col("z") > static_max_zoom), 1).otherwise(0)).alias("rendered"),
        (F.sum(kb) / 1024).alias("estimate_mb"))


def oversized(plans: DataFrame) -> DataFrame:
    return plans.where((F.col("kind") == "area") & (F.col("tiles") > AREA_MAX_TILES))


def missing_tiles(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    return plan.join(inventory, ["layer", "z", "x", "y"], "left_anti")


def removable_tiles(removed: DataFrame, remaining: DataFrame, inventory: DataFrame, size: float = 0.25) -> DataFrame:
    """Stored tiles(z, x, y) that a removed pack covers and no remaining pack does; packs(pack_id, max_zoom, w, s, e, n)."""
    t = with_tile_bbox(inventory.select("z", "x", "y").distinct())

    def covered(packs):
        return bbox_join(t, packs.select("pack_id", "max_zoom", "w", "s", "e", "n"), size).where(F.col("z") <= F.col("b_max_zoom"))

    gone = covered(removed).select(F.col("b_pack_id").alias("pack_id"), "z", "x", "y")
    return gone.join(covered(remaining).select("z", "x", "y").distinct(), ["z", "x", "y"], "left_anti")


def tiles_from_urls(urls: DataFrame) -> DataFrame:
    """z, x, y of tile addresses that end in /z/x/y.ext and are in range."""
    path = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    p = r"/(\d+)/(\d+)/(\d+)\.\w+$"
    out = urls.withColumns({c: F.regexp_extract(path, p, i).try_cast("bigint") for i, c in enumerate("zxy", 1)})
    lim = F.pow(F.lit(2.0), F.col("z"))
    return out.where((F.col("z") <= 22) & (F.col("x") < lim) & (F.col("y") < lim))


def pack_shards(packs: DataFrame) -> DataFrame:
    """Degree shards every pack needs."""
    f = lambda c: F.floor(c).cast("int")
    return (packs.withColumn("shard_x", F.explode(F.sequence(f("w"), f("e")))).withColumn("shard_y", F.explode(F.sequence(f("s"), f("n"))))
            .select("pack_id", "shard_x", "shard_y"))


def trail_report(trails: DataFrame, lengths: DataFrame) -> DataFrame:
    """Ways and metres by kind, surface and foot access with subtotals ('all')."""
    t = trails.join(lengths, "way_id", "left")
    r = t.rollup("kind", "surface_class", "access_foot").agg(F.count(F.lit(1)).alias("ways"), F.coalesce(F.sum("length_m"), F.lit(0.0)).alias("length_m"),
                                                             F.grouping_id().alias("level"))
    return r.na.fill("all", ["kind", "surface_class", "access_foot"])
