"""Typed access to the input tables and the geodata views derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from fellwalk.operators.ordered import running_sums

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

# The same views as SQL text, used by the SQL twins of the queries.
VIEW_SQL = {
    "v_nodes": """
SELECT p_partkey AS node_id,
       2.5e1 + ((p_partkey * 7919) % 20000) / 1e6 AS lng,
       4.5e1 + ((p_partkey * 104729) % 15000) / 1e6 AS lat,
       CAST(600 + (p_partkey * 37) % 1500 AS DOUBLE) AS ele
FROM part""",
    "v_way_vertices": """
SELECT l_orderkey AS way_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) - 1 AS seq,
       l_partkey AS node_id
FROM lineitem""",
    "v_way_tags": """
SELECT o_orderkey AS way_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'path' WHEN 1 THEN 'track' WHEN 2 THEN 'residential'
            WHEN 3 THEN 'footway' WHEN 4 THEN 'unclassified' ELSE 'cycleway' END AS highway,
       CASE o_custkey % 5 WHEN 0 THEN 'asphalt' WHEN 1 THEN 'gravel' WHEN 2 THEN 'ground' WHEN 3 THEN 'rock' END AS surface,
       CASE WHEN o_orderkey % 6 = 1 THEN concat('grade', substr(o_orderpriority, 1, 1)) END AS tracktype,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'hiking' WHEN '2' THEN 'mountain_hiking' WHEN '3' THEN 'alpine_hiking' END AS sac_scale,
       CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'bad' END AS trail_visibility,
       CASE WHEN o_custkey % 3 = 0 THEN concat('Way ', CAST(o_orderkey AS STRING)) END AS name
FROM orders""",
    "v_way_tags_more": """
SELECT o_orderkey AS way_id,
       CASE o_custkey % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'permissive' WHEN 2 THEN 'strange' END AS access,
       CASE o_orderkey % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'designated' END AS bicycle,
       CASE o_orderkey % 13 WHEN 0 THEN 'forestry' WHEN 1 THEN 'destination' WHEN 2 THEN 'yes' END AS motor_vehicle,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 9 AS STRING) END AS mtb_scale,
       CASE WHEN o_orderkey % 17 = 0 THEN 'yes' END AS informal,
       CASE o_custkey % 6 WHEN 0 THEN '2.5 m' WHEN 1 THEN '4' END AS width,
       CASE o_orderkey % 19 WHEN 0 THEN 'driveway' WHEN 1 THEN 'alley' END AS service
FROM orders""",
    "v_relations": """
SELECT c_custkey AS rel_id, CASE WHEN c_custkey % 3 = 0 THEN concat('Route ', CAST(c_custkey AS STRING)) END AS name,
       CASE WHEN c_custkey % 5 <> 0 THEN concat('R', CAST(c_custkey AS STRING)) END AS ref,
       CASE c_custkey % 10 WHEN 0 THEN 'red:white:red_stripe' WHEN 1 THEN 'blue:white:blue_cross' WHEN 2 THEN 'yellow:white:yellow_triangle'
            WHEN 3 THEN 'green:white:green_dot' WHEN 4 THEN 'red' WHEN 5 THEN 'black:white:black_bar' WHEN 6 THEN 'orange:white:orange_backslash'
            WHEN 7 THEN 'pink:white:pink_stripe' END AS symbol,
       CASE c_custkey % 4 WHEN 0 THEN '#a1b2c3' WHEN 1 THEN 'Brown' END AS colour
FROM customer""",
    "v_route_members": """
SELECT o_custkey AS rel_id, o_orderkey AS way_id FROM orders""",
    "v_trace_points": """
SELECT user_id AS trace_id, seq, 2.5e1 + x / 1e5 AS lng, 4.5e1 + y / 1e5 AS lat, seq * 5 AS t_s, accuracy
FROM (SELECT user_id, event_id, ts, 5 + event_id % 60 AS accuracy,
             CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq,
             CAST(sum((event_id * 7919) % 41 - 15) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS x,
             CAST(sum((event_id * 104729) % 31 - 12) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y
      FROM events) t""",
    "v_score_cells": """
SELECT CAST(event_id % 100 AS INT) AS cx, CAST(floor(event_id / 1e2) AS INT) AS cy, value / 5e2 AS score FROM events""",
    "v_density_cells": """
SELECT CAST(p_partkey % 50 AS INT) AS cx, CAST(floor(p_partkey / 5e1) AS INT) AS cy, (p_size * 5) % 256 AS q FROM part""",
    "v_scenes": """
SELECT concat('S', CAST(o_orderkey AS STRING)) AS id, concat('G', CAST(o_custkey % 50 AS STRING)) AS grid,
       CAST(floor(o_totalprice) AS BIGINT) % 100 / 1e0 AS cloud, o_orderkey % 40 / 1e0 AS nodata, o_orderdate AS acquired_at
FROM orders""",
    "v_places": """
SELECT concat('p', CAST(p_partkey AS STRING)) AS id, concat(p_name, ' ', CAST(p_partkey % 97 AS STRING)) AS name,
       CAST(p_partkey % 36 AS INT) AS cat, 2.5e1 + ((p_partkey * 7919) % 300000) / 1e5 AS lng,
       4.4e1 + ((p_partkey * 104729) % 300000) / 1e5 AS lat, CAST(p_size AS INT) AS imp
FROM part""",
}


class Data:
    """Lazy DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def _view(self, name: str, table: str) -> DataFrame:
        return self.spark.sql(VIEW_SQL[name].replace(f"FROM {table}", "FROM {src}"), src=self.table(table))

    @cached_property
    def nodes(self) -> DataFrame:
        return self._view("v_nodes", "part")

    @cached_property
    def way_vertices(self) -> DataFrame:
        src = self.table("lineitem").select(
            F.col("l_orderkey").alias("way_id"), "l_linenumber", F.col("l_partkey").alias("node_id"), "l_suppkey",
            F.lit(1).alias("one"))
        # a way of any length is numbered in pieces of one line number and 256 neighbouring part keys
        bucket = F.col("l_linenumber").cast("long") * (1 << 40) + F.floor(F.col("node_id") / 256)
        rows = running_sums(src, ["way_id"], ["l_linenumber", "node_id", "l_suppkey"], {"one": "n"}, bucket)
        return rows.select("way_id", (F.col("n") - 1).cast("int").alias("seq"), "node_id")

    @cached_property
    def way_tags(self) -> DataFrame:
        return self._view("v_way_tags", "orders")

    @cached_property
    def ways(self) -> DataFrame:
        """way_id and tags map."""
        cols = {c: c for c in ("highway", "surface", "tracktype", "sac_scale", "trail_visibility", "name", "access", "bicycle",
                               "motor_vehicle", "informal", "width", "service")} | {"mtb_scale": "mtb:scale"}
        t = self.way_tags.join(self._view("v_way_tags_more", "orders"), "way_id")
        entries = F.array(*[F.struct(F.lit(tag).alias("key"), F.col(c).alias("value")) for c, tag in cols.items()])
        return t.select("way_id", F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull())).alias("tags"))

    @cached_property
    def relations(self) -> DataFrame:
        return self._view("v_relations", "customer")

    @cached_property
    def route_members(self) -> DataFrame:
        return self._view("v_route_members", "orders")

    @cached_property
    def trace_points(self) -> DataFrame:
        e = F.col("event_id")
        src = self.table("events").select(
            F.col("user_id").alias("trace_id"), "event_id", "ts", (5 + e % 60).alias("accuracy"), F.lit(1).alias("one"),
            ((e * 7919) % 41 - 15).alias("sx"), ((e * 104729) % 31 - 12).alias("sy"))
        rows = running_sums(src, ["trace_id"], ["ts", "event_id"], {"one": "seq", "sx": "x", "sy": "y"},
                            F.unix_date(F.col("ts").cast("date")))
        return rows.select("trace_id", F.col("seq").cast("int").alias("seq"), (25.0 + F.col("x") / 1e5).alias("lng"),
                           (45.0 + F.col("y") / 1e5).alias("lat"), (F.col("seq") * 5).cast("int").alias("t_s"), "accuracy")

    @cached_property
    def score_cells(self) -> DataFrame:
        return self._view("v_score_cells", "events")

    @cached_property
    def density_cells(self) -> DataFrame:
        return self._view("v_density_cells", "part")

    @cached_property
    def scenes(self) -> DataFrame:
        return self._view("v_scenes", "orders")

    @cached_property
    def places(self) -> DataFrame:
        return self._view("v_places", "part")

    @cached_property
    def way_points(self) -> DataFrame:
        """Way vertices with coordinates."""
        return self.way_vertices.join(self.nodes, "node_id")
