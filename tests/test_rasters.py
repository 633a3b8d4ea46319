"""Rasters: exact distances."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fellwalk.operators import density


@pytest.mark.parametrize("share,seed", [(0.02, 1), (0.3, 2), (0.0, 3), (1.0, 4)])
def test_distance_to_mask(spark, share, seed):
    """Unequal cell sizes, columns without a mask cell, an empty mask, a full one."""
    rng = random.Random(seed)
    cells = [(x, y, rng.random() < share and x % 5 != 2) for x in range(23) for y in range(17)]
    df = spark.createDataFrame(cells, "cx int, cy int, m boolean").repartition(5)
    mask = [(x, y) for x, y, m in cells if m]
    want = {(x, y): min((math.hypot((x - a) * 0.7, (y - b) * 1.3) for a, b in mask), default=None) for x, y, _ in cells}
    got = {(r.cx, r.cy): r.dist_km for r in density.distance_to_mask(df, F.col("m"), 0.7, 1.3).collect()}
    assert got.keys() == want.keys() and all((got[k] is None) == (d is None) and (d is None or abs(got[k] - d) < 1e-9) for k, d in want.items())
    capped = {(r.cx, r.cy): r.dist_km for r in density.distance_to_mask(df, F.col("m"), 0.7, 1.3, 2.0).collect()}
    assert all(abs(capped[k] - min(2.0, 2.0 if d is None else d)) < 1e-9 for k, d in want.items())


def test_long_rows_need_linear_work(spark):
    df = spark.range(200_000).select(F.col("id").cast("int").alias("cx"), F.lit(0).alias("cy"), (F.col("id") == 0).alias("m"))
    assert density.distance_to_mask(df, F.col("m"), 0.5, 0.5).agg(F.sum("dist_km")).first()[0] == pytest.approx(0.5 * 199_999 * 200_000 / 2)


def test_byte_grid_round_trip(spark, tmp_path):
    """451,200 cells, read by several tasks; tiles without a value are not written; a wrong size is an error."""
    from fellwalk.sources import grids

    path = tmp_path / "one.bin"
    raw = bytes((x * 31 + x // 960) % 256 for x in range(960 * 470))
    path.write_bytes(raw)
    cells = grids.read_byte_grid(spark, str(path), 960, 470, split=100_000)
    assert cells.rdd.getNumPartitions() == 5
    got = cells.select(F.col("cy") * 960 + F.col("cx"), "q").collect()
    assert len(got) == len(raw) and all(raw[i] == q for i, q in got)
    assert {(r.cx, r.cy, r.q) for r in grids.decode_byte_grid(spark.createDataFrame([("a", bytearray(b"\x01\xff\x00\x07"))], "path string, content binary"), 2, 2).collect()} == {(0, 0, 1), (1, 0, 255), (0, 1, 0), (1, 1, 7)}
    tiles = spark.createDataFrame([(24, 45, 0, 1, 9), (24, 45, 2, 2, 255), (25, 45, 1, 1, 0), (-1, -3, 2, 0, 1)], "tile_lon int, tile_lat int, ix int, iy int, q int").repartition(3)
    grids.write_byte_grid(tiles, str(tmp_path / "tiles"), 3)
    assert sorted(f.name for f in (tmp_path / "tiles").iterdir() if f.suffix != ".crc") == ["-1_-3.bin", "24_45.bin"]
    assert (tmp_path / "tiles" / "24_45.bin").read_bytes() == bytes([0, 0, 0, 9, 0, 0, 0, 0, 255])
    back = grids.read_byte_grid(spark, str(tmp_path / "tiles"), 3, 3).where("q > 0").collect()
    assert {(r.path.rsplit("/", 1)[1], r.cx, r.cy, r.q) for r in back} == {("24_45.bin", 0, 1, 9), ("24_45.bin", 2, 2, 255), ("-1_-3.bin", 2, 0, 1)}
    with pytest.raises(Exception, match="size mismatch"):
        grids.read_byte_grid(spark, str(path), 960, 471).count()
