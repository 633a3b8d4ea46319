"""Best-fit packing into bins of several permitted capacities.

Lengths are counted per row and cut into pieces of the largest capacity at most, so nothing is
dropped. Rows are dealt by a hash into groups of about `GROUP` rows; each group is packed alone, longest
piece first: into the open bin with the least room that holds it, else into a new bin. The size of a
new bin is that of least cost per token it can get: its contents, plus what the pieces still waiting
could fill of its room. At the end each bin shrinks to the smallest capacity that holds its contents.

Edge cases: null and blank texts have no tokens and get one empty piece in a bin of their group; a
null doc_id is carried as it is; repeated rows are packed each; an empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellwalk.llm.common import text_bytes
from fellwalk.operators.fixpoint import cut

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a bin besides its tokens, in tokens.
BIN_COST = 32
GROUP = 8192
SCHEMA = "doc_id long, piece int, n_tokens int, bin_id long, slot int, offset int, capacity int, used int"


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST) -> tuple[list[int], list[int]]:
    """(bin of each piece, final capacity of each bin); no piece is longer than the largest capacity."""
    sizes = sorted(capacities)
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    rising = np.sort(np.array(lengths, np.int64))
    total = np.r_[0, np.cumsum(rising)]
    shorter = {c: np.searchsorted(rising, np.arange(c + 1), side="right") for c in sizes[-1:]}[sizes[-1]]
    bin_of = [0] * len(lengths)
    used: list[int] = []
    room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for done, i in enumerate(order):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at < len(rooms):
            left = rooms[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
        else:
            waiting = len(lengths) - done - 1
            best = None
            for c in sizes:
                if c >= n:
                    fill = n + min(c - n, int(total[min(waiting, shorter[c - n])]))
                    cost = (c + bin_cost) / max(fill, 1)
                    if best is None or cost < best[0]:
                        best = (cost, c)
            b, left = len(used), best[1]
            used.append(0)
        bin_of[i] = b
        used[b] += n
        if left > n:
            if left - n not in room:
                room[left - n] = []
                insort(rooms, left - n)
            room[left - n].append(b)
    return bin_of, [sizes[bisect_left(sizes, u)] for u in used]


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens): blank-separated words of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([len(t.split()) for t in text_bytes(b)], pa.int64())], names=["doc_id", "n_tokens"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def best_fit(items: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: float = BIN_COST, group: int = GROUP) -> DataFrame:
    """One row per piece of items(doc_id, n_tokens): its bin, slot, offset in the bin, final capacity and fill of the bin."""
    top = max(capacities)
    rows = cut(items.select("doc_id", "n_tokens").withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, -(-rows.count() // group))

    def run(table: pa.Table) -> pa.Table:
        g, doc, n, row = (table.column(c).to_pylist() for c in ("g", "doc_id", "n_tokens", "row"))
        pieces = [(d, k, min(top, m - k * top)) for _, m, d in sorted(zip(row, n, doc), key=lambda x: x[0]) for k in range(max(1, -(-m // top)))]
        bin_of, capacity = pack([p[2] for p in pieces], tuple(capacities), bin_cost)
        slots, fill, out = [0] * len(capacity), [0] * len(capacity), []
        for (d, k, m), b in zip(pieces, bin_of):
            out.append((d, k, m, (g[0] << 32) + b, slots[b], fill[b], capacity[b]))
            slots[b] += 1
            fill[b] += m
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = ["doc_id", "piece", "n_tokens", "bin_id", "slot", "offset", "capacity"]
        return pa.table([*(pa.array(c, k) for c, k in zip(cols, kinds)), pa.array([fill[b] for b in bin_of], pa.int32())], names=[*names, "used"])
    return rows.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("g").applyInArrow(run, SCHEMA)


def packed(docs: DataFrame, **kw) -> DataFrame:
    return best_fit(lengths(docs), **kw)
