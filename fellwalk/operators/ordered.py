"""Order-dependent helpers that split long groups.

A trace, route or way can hold a large share of all rows. Neighbour lookups and
prefix sums therefore work on fixed-length chunks of a group: each chunk is its
own partitioning key and only chunk totals meet per group.

Spark takes the size of a pruned scan for that of everything derived from it, also after an explode. Joins with a
side that grows with the input therefore ask for a merge join, so that no such side is collected for a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.operators.fixpoint import cut

CHUNK = 4096


def with_neighbour(df: DataFrame, keys: list[str], seq: str, cols: dict[str, str], offset: int = -1,
                   chunk: int = CHUNK) -> DataFrame:
    """Adds the previous (offset -1) or next (offset +1) row's columns; seq must be gap-free per key."""
    own = F.floor(F.col(seq) / chunk).cast("long")
    pos = F.col(seq) % chunk
    edge = (pos == chunk - 1) if offset < 0 else (pos == 0)
    other = own + 1 if offset < 0 else own - 1
    rows = df.withColumn("_chunk", F.explode(F.when(edge, F.array(own, other)).otherwise(F.array(own))))
    w = W.partitionBy(*keys, "_chunk").orderBy(seq)
    picked = [(F.lag(c) if offset < 0 else F.lead(c)).over(w).alias(alias) for c, alias in cols.items()]
    out = rows.select("*", *picked)
    return out.where(F.col("_chunk") == own).drop("_chunk")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], bucket,
                 reverse: bool = False) -> DataFrame:
    """Inclusive running sums along `order`, split by a monotone `bucket` of the order columns."""
    rows = df.withColumn("_b", bucket)
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_t_{a}") for c, a in sums.items()])
    wb = W.partitionBy(*keys).orderBy(F.col("_b").desc() if reverse else F.col("_b"))
    before = wb.rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", *[
        F.coalesce(F.sum(f"_t_{a}").over(before), F.lit(0)).alias(f"_o_{a}") for a in sums.values()])
    inner = [F.col(o).desc() if reverse else F.col(o) for o in order]
    w = W.partitionBy(*keys, "_b").orderBy(*inner).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(offsets.hint("merge"), [*keys, "_b"])
    return out.select(*df.columns, *[
        (F.col(f"_o_{a}") + F.sum(c).over(w)).alias(a) for c, a in sums.items()])


def running_distance(df: DataFrame, keys: list[str], seq: str, value: str, alias: str,
                     reverse: bool = False) -> DataFrame:
    return running_sums(df, keys, [seq], {value: alias}, F.floor(F.col(seq) / CHUNK).cast("long"), reverse)


def spread_key(df: DataFrame, parts: int = 16):
    """A deterministic salt for replicated-side joins."""
    return F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")


def ranked_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums along `order`, for groups of any size.

    Rows are dealt by ranges of (keys, order), so that no task gets a whole group; each range is summed on its own
    after the totals of the ranges before it. Columns of `order` should tell a group's rows apart: equal rows share a range.
    """
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    return running_sums(dealt, keys, order, sums, F.col("_range")).drop("_range")
