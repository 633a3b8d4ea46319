"""Shared helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks of the word pattern [^\x20\x09-\x0D]+; bytes.split() and bytes.strip() use the same six.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stands in for a null doc_id where ids are compared: such rows count as the last.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST_ID))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [v or b"" for v in col.cast(pa.binary() if pa.types.is_string(col.type) else pa.large_binary()).to_pylist()]


def blocks(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to `limit` at most, or single longer rows."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, which whoever submits the job sizes to the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Holds the columns that a stage only carries along.
CARRIED = "carried columns"


def set_apart(*own: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For stages that return the columns of their input: all but `own` travel in one struct, so that no name of theirs can meet one of the stage's."""
    def around(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(stage)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
            rest = [c for c in docs.columns if c not in own]
            if not rest:
                return stage(docs, *args, **more)
            out = stage(docs.select(*[c for c in docs.columns if c in own], F.struct(*[quoted(c) for c in rest]).alias(CARRIED)), *args, **more)
            return out.select(*[F.col(c) if c in own else F.col(f"`{CARRIED}`").getField(c).alias(c) for c in docs.columns])
        return run
    return around
