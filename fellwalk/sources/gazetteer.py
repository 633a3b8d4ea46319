"""Gazetteer tables: core entries, degree shards, counts per category."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellwalk.functions.geo import round_half_up


def encode_entries(entries: DataFrame) -> DataFrame:
    """Coordinates as 1e-5 degree integers plus the degree shard they belong to."""
    return (entries.withColumns({"x": round_half_up(F.col("lng") * 1e5).cast("int"), "y": round_half_up(F.col("lat") * 1e5).cast("int"),
                                 "shard_x": F.floor("lng").cast("int"), "shard_y": F.floor("lat").cast("int")}).drop("lng", "lat"))


def write_gazetteer(entries: DataFrame, streets: DataFrame, routes: DataFrame, out: str) -> None:
    encode_entries(entries).write.mode("overwrite").parquet(f"{out}/core")
    for name, df in (("streets", streets), ("routes", routes)):
        (encode_entries(df).repartition("shard_x", "shard_y").write.mode("overwrite").partitionBy("shard_x", "shard_y").parquet(f"{out}/{name}"))
    entries.groupBy("cat").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/meta")


def read_gazetteer(spark: SparkSession, path: str, part: str = "core") -> DataFrame:
    df = spark.read.parquet(f"{path}/{part}")
    if part == "meta":
        return df
    return df.withColumns({"lng": F.col("x") / 1e5, "lat": F.col("y") / 1e5}).drop("x", "y")
