"""Byte rasters, DEM pixels and tile manifests."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fellwalk.functions.geo import col


CELLS = "path string, cx int, cy int, q int"
#: Cells that one task reads.
SPLIT = 1 << 20


def cell_batch(path: str, raw: bytes, width: int, first: int = 0) -> pa.RecordBatch:
    """Cells of consecutive bytes; `first` is the number of the first one in its raster."""
    i = np.arange(first, first + len(raw), dtype=np.int64)
    names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(raw), np.int32)), pa.array([path], pa.string())).cast(pa.string())
    return pa.record_batch([names, pa.array((i % width).astype(np.int32)), pa.array((i // width).astype(np.int32)), pa.array(np.frombuffer(raw, np.uint8).astype(np.int32))], names=["path", "cx", "cy", "q"])


def decode_byte_grid(files: DataFrame, width: int, height: int) -> DataFrame:
    """Cells (path, cx, cy, q) of byte rasters given as path, content; a wrong size is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(raw) != width * height:
                    raise ValueError(f"byte grid size mismatch: {path}")
                for at in range(0, len(raw), SPLIT):
                    yield cell_batch(path, raw[at:at + SPLIT], width, at)
    return files.select(F.col("path").cast("string"), "content").mapInArrow(run, CELLS)


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size


class ByteGridReader(DataSourceReader):
    """Plans byte ranges of the rasters in a folder (or of one file) and reads each range on its own."""

    def __init__(self, options: dict):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.split = int(options.get("split", SPLIT))

    def partitions(self) -> list[ByteRange]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else sorted((f for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".bin")), key=lambda f: f.path)
        for f in files:
            if f.size != self.width * self.height:
                raise ValueError(f"byte grid size mismatch: {f.path} has {f.size} bytes")
        return [ByteRange(f.path, at, min(self.split, f.size - at)) for f in files for at in range(0, f.size, self.split)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(part.path) as source:
            yield cell_batch(part.path, source.read_at(part.size, part.start), self.width, part.start)


class ByteGridSource(DataSource):
    """`spark.read.format("byte_grid")` with the options width, height and split (cells in a task)."""

    @classmethod
    def name(cls) -> str:
        return "byte_grid"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> ByteGridReader:
        return ByteGridReader(self.options)


def as_url(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def read_byte_grid(spark: SparkSession, path: str, width: int, height: int, split: int = SPLIT) -> DataFrame:
    """Cells (path, cx, cy, q) of the raster file, or of all `.bin` files of the folder, at `path`; every file has one byte a cell."""
    spark.dataSource.register(ByteGridSource)
    return spark.read.format("byte_grid").options(width=width, height=height, split=split).load(as_url(path))


def fine_tiles(cells: DataFrame, west: float, north: float, res: float, per: int) -> DataFrame:
    """Cells with their degree tile and position in it; tiles without any value are left out."""
    tx, ty = F.floor(west + F.col("cx") * res + 1e-9), F.ceil(north - F.col("cy") * res - 1e-9) - 1
    rows = cells.select(tx.cast("int").alias("tile_lon"), ty.cast("int").alias("tile_lat"),
                        F.floor((west + F.col("cx") * res - tx) / res + 0.5).cast("int").alias("ix"),
                        F.floor((ty + 1 - (north - F.col("cy") * res)) / res + 0.5).cast("int").alias("iy"), "q")
    used = rows.where("q > 0").select("tile_lon", "tile_lat").distinct()
    return rows.where((F.col("ix") < per) & (F.col("iy") < per)).join(used, ["tile_lon", "tile_lat"], "left_semi")


def write_byte_grid(cells: DataFrame, out: str, per: int) -> None:
    """One `lon_lat.bin` of per x per bytes for each degree tile with a value in it; cells(tile_lon, tile_lat, ix, iy, q), other cells are 0.

    A task holds one tile. Files are written under a temporary name and moved, so a repeated task leaves the same file.
    """
    url = as_url(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(url)
        fs.create_dir(root, recursive=True)
        at, tile = None, np.zeros((per, per), np.uint8)

        def done() -> pa.RecordBatch:
            name = f"{at[0]}_{at[1]}.bin"
            if tile.any():
                temp = f"{root}/{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temp, compression=None) as f:
                    f.write(tile.tobytes())
                fs.move(temp, f"{root}/{name}")
            return pa.record_batch([pa.array([name] if tile.any() else [], pa.string())], names=["tile"])

        for b in batches:
            lon, lat, ix, iy, q = (c.to_numpy() for c in b.columns)
            edge = np.flatnonzero(np.r_[True, (lon[1:] != lon[:-1]) | (lat[1:] != lat[:-1]), True]) if len(lon) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if at != (lon[lo], lat[lo]):
                    if at is not None:
                        yield done()
                    at, tile = (lon[lo], lat[lo]), np.zeros((per, per), np.uint8)
                tile[iy[lo:hi], ix[lo:hi]] = q[lo:hi]
        if at is not None:
            yield done()
    rows = cells.select(*[F.col(c).cast("int") for c in ("tile_lon", "tile_lat", "ix", "iy", "q")])
    rows.repartition("tile_lon", "tile_lat").sortWithinPartitions("tile_lon", "tile_lat").mapInArrow(run, "tile string").write.format("noop").mode("overwrite").save()


def terrarium_elevation(r, g, b) -> Column:
    return col(r) * 256 + col(g) + col(b) / 256 - 32768


def decode_dem_pixels(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("ele", terrarium_elevation("r", "g", "b"))


def write_tile_manifest(manifest: DataFrame, version: str, out: str) -> None:
    manifest.select("z", "x", "y", "signature", F.lit(version).alias("version")).write.mode("overwrite").parquet(out)


def read_tile_manifest(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Tile signatures; entries of another renderer version count as absent."""
    return spark.read.parquet(path).where(F.col("version") == version).drop("version")
