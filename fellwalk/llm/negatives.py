"""Hard negatives by bounds along a spanning tree of anchors.

A row's score for an anchor is the inner product of their whole-number vectors. Moving from one anchor to
another changes a row's score by no more than the distance between the anchors times the row's norm. The
anchors of a block are therefore joined by a minimum spanning tree. Every row is scored at the root; at
each further anchor its score lies within the parent's score, plus or minus edge distance times norm, and
it is scored again only if that interval meets what the anchor still looks for: for positives, the scores
from the worst of the best so far upwards; for negatives, the windows below the positives, from the worst
kept negative of each upwards. Bounds only ever leave out rows that cannot be in the result, so it is
exact. Where bounds do not narrow (vectors at random in many dimensions), nearly all rows are scored.

Anchors are worked on in blocks of a bounded number and size, which are sent to all tasks; the rows are
read where they lie and never shuffled, a task holds one batch of them and sends on its best few for each
anchor. The work is the number of anchors times that of rows; each block is two passes over the table.
Its result is written to the shared folder before the next block begins.

Edge cases: rows with a null label, a null vector, a null or non-finite component (also after scaling)
take no part; a missing component counts as zero, so vectors may differ in length; a null id is never an
anchor and comes last among ties; anchors that are equal in id, label and vector count once, other rows
as often as they come; rows with an anchor's id are neither its positives nor its negatives; a score
beyond a long is computed exactly and returned as the nearest long; an anchor without positives or a
positive without negatives gives no row; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fellwalk.llm.common import LAST_ID, order_id
from fellwalk.operators.fixpoint import cut
from fellwalk.plans.scratch import scratch

#: Anchors of a block, and components of all of them.
ANCHORS, COMPONENTS = 1024, 1 << 23
#: Bounds (rows times anchors) that a task holds at a time.
BOUNDS = 1 << 22
EXACT = float(1 << 52)
LONG = (1 << 63) - 1
FOUND = "node int, slot int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """(anchor, parent, distance) of a minimum spanning tree, parents first; the first is the root, without a parent."""
    n = len(vectors)
    order, near, parent, left = [(0, -1, 0.0)], np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    at, left[0] = 0, False
    with np.errstate(over="ignore", invalid="ignore"):
        for _ in range(n - 1):
            d = np.linalg.norm(vectors - vectors[at], axis=1)
            closer = left & ~(d >= near)
            near[closer], parent[closer] = d[closer], at
            open_ = np.flatnonzero(left)
            at = int(open_[np.argmin(np.nan_to_num(near[open_], nan=np.inf))])
            left[at] = False
            order.append((at, int(parent[at]), float(np.linalg.norm(vectors[at] - vectors[parent[at]]) * (1 + 1e-9))))
    return order


@dataclass
class Block:
    """Anchors and, for the second pass, their positives as (id, score) and the windows below them."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    tree: list[tuple[int, int, float]]
    positives: list[list[tuple[int, int]]] = field(default_factory=list)
    windows: list[list[tuple[int, int]]] = field(default_factory=list)


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Scaled whole-number vectors, cut or filled up with zeros to `width` components."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    if len(size) and (size == width).all():
        return np.floor(scale * values[ends[0]:ends[-1]].reshape(len(size), width))
    out = np.zeros((len(size), width))
    for i, (a, n) in enumerate(zip(ends.tolist(), np.minimum(size, width).tolist())):
        out[i, :n] = values[a:a + n]
    return np.floor(scale * out)


def exact_scores(rows: np.ndarray, anchor: np.ndarray) -> list[int]:
    whole = [int(x) for x in anchor]
    return [sum(int(x) * y for x, y in zip(r, whole)) for r in rows]


def first_few(scores: np.ndarray, ids: np.ndarray, keep: int) -> list[tuple[int, int]]:
    """(-score, id) of the first `keep` rows, higher scores first, then smaller ids."""
    if scores.dtype == object:
        return sorted((-int(s), int(i)) for s, i in zip(scores, ids))[:keep]
    if len(scores) > 4 * keep:
        enough = scores >= np.partition(scores, len(scores) - keep)[len(scores) - keep]
        scores, ids = scores[enough], ids[enough]
    order = np.lexsort((ids, -scores))[:keep]
    return [(-int(scores[i]), int(ids[i])) for i in order]


def visit(block: Block, rows: np.ndarray, may: Callable[[int, np.ndarray, np.ndarray], np.ndarray], take: Callable[[int, np.ndarray, np.ndarray], None], big: np.ndarray) -> int:
    """Calls take(anchor, row numbers, scores) for every row whose bounds `may` accept; returns how many scores were computed."""
    norms = np.linalg.norm(rows, axis=1) * (1 + 1e-9)
    low, high = np.empty((len(block.ids), len(rows))), np.empty((len(block.ids), len(rows)))
    scored = 0
    for node, parent, far in block.tree:
        if parent < 0:
            low[node], high[node] = -np.inf, np.inf
            wanted = np.arange(len(rows))
        else:
            with np.errstate(invalid="ignore"):
                slack = far * norms + 1
                low[node], high[node] = low[parent] - slack, high[parent] + slack
            wanted = np.flatnonzero(may(node, low[node], high[node]) & ~big)
        if not len(wanted):
            continue
        anchor = block.vectors[node]
        scores = (rows @ anchor)[wanted] if 2 * len(wanted) > len(rows) else rows[wanted] @ anchor
        low[node, wanted] = high[node, wanted] = scores
        scored += len(wanted)
        if parent < 0:
            low[node, big], high[node, big] = -np.inf, np.inf
            wanted = np.flatnonzero(may(node, low[node], high[node]) & ~big)
            scores = low[node, wanted]
        take(node, wanted, scores)
    return scored


def nearest(block: Block, keep: int) -> tuple[Callable, list]:
    """The rules of the first pass: the first `keep` rows of each anchor's own label."""
    best: list[list[list[tuple[int, int]]]] = [[[]] for _ in block.ids]

    def rules(ids: np.ndarray, labels: np.ndarray):
        def may(node, low, high):
            fit = (labels == block.labels[node]) & (ids != block.ids[node])
            held = best[node][0]
            return fit & ~(high < -held[-1][0]) if len(held) == keep else fit

        def take(node, at, scores):
            best[node][0] = sorted(best[node][0] + first_few(scores, ids[at], keep))[:keep]
        return may, take
    return rules, best


def below(block: Block, keep: int) -> tuple[Callable, list]:
    """The rules of the second pass: the first `keep` rows of other labels in each window."""
    best: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in block.windows]

    def floor_of(node: int, slot: int, low: int) -> int:
        held = best[node][slot]
        return max(low, -held[-1][0]) if len(held) == keep else low

    def rules(ids: np.ndarray, labels: np.ndarray):
        def may(node, low, high):
            spans = [(floor_of(node, j, a), b) for j, (a, b) in enumerate(block.windows[node]) if a <= b]
            meet = np.zeros(len(ids), bool)
            for a, b in set(spans):
                meet |= ~((high < a) | (low > b))
            return meet & (labels != block.labels[node]) & (ids != block.ids[node])

        def take(node, at, scores):
            for j, (a, b) in enumerate(block.windows[node]):
                if a <= b:
                    fit = (scores >= floor_of(node, j, a)) & (scores <= b)
                    if fit.any():
                        best[node][j] = sorted(best[node][j] + first_few(scores[fit], ids[at[fit]], keep))[:keep]
        return may, take
    return rules, best


def scan(block: Block, batches: Iterator[pa.RecordBatch], rules: Callable, scale: int) -> int:
    """Runs one pass over batches of (id, label, vector); returns how many scores were computed."""
    most = float(np.linalg.norm(block.vectors, axis=1).max()) * (1 + 1e-9)
    step, scored = max(64, BOUNDS // len(block.ids)), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
            rows = matrix(part.column(2), block.vectors.shape[1], scale)
            may, take = rules(ids, labels)
            with np.errstate(over="ignore"):
                big = ~(np.linalg.norm(rows, axis=1) * most < EXACT)
            scored += visit(block, np.where(big[:, None], 0, rows), may, take, big)
            if big.any():  # beyond exact floating point: whole numbers, without bounds
                at = np.flatnonzero(big)
                unbounded = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
                for node in range(len(block.ids)):
                    own = at[may(node, *unbounded)[at]]
                    take(node, own, np.array(exact_scores(rows[own], block.vectors[node]), object))
    return scored


def one_pass(rows: DataFrame, block: Block, rule: Callable, keep: int, scale: int) -> DataFrame:
    """(node, slot, id, score, place) of the first `keep` rows that `rule` finds for each slot of each anchor."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        rules, best = rule(own, keep)
        scan(own, batches, rules, scale)
        out = [(n, j, i, max(-LONG, min(LONG, -s))) for n, slots in enumerate(best) for j, held in enumerate(slots) for s, i in held]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["node", "slot", "id", "score"])
    order = Window.partitionBy("node", "slot").orderBy(F.desc("score"), "id")
    found = rows.mapInArrow(run, FOUND)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def taking_part(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, label, v) of the rows that have a label and a whole vector."""
    v = F.col("embedding").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < F.lit(float("inf"))))
    return vectors.where(F.col("label").isNotNull() & v.isNotNull() & whole).select(order_id("vec_id").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first `positives` rows of its label, the first `negatives` rows of other
    labels whose scores are `low` to `high` hundredths of the positive's. vectors(vec_id, label, embedding)."""
    spark = vectors.sparkSession
    rows = taking_part(vectors, scale)
    anchors = cut(taking_part(vectors.where(is_anchor & F.col("vec_id").isNotNull()), scale).dropDuplicates(["id", "label", "v"]).withColumn("h", F.xxhash64("id", "label", "v")))
    count, width = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        return spark.createDataFrame([], RESULT)
    folder = scratch(spark, "negatives")
    size = max(1, min(ANCHORS, COMPONENTS // max(1, width)))
    parts = -(-count // size)
    for b in range(parts):
        held = anchors.where(F.pmod("h", F.lit(parts)) == b).orderBy("id", "label", "h").collect()  # a block, about `size` rows
        if not held:
            continue
        own = matrix(pa.array([r["v"] for r in held], pa.list_(pa.float64())), max(1, max(len(r["v"]) for r in held)), scale)
        block = Block(np.array([r["id"] for r in held]), np.array([r["label"] for r in held]), own, spanning_tree(own))
        block.positives = [[] for _ in held]
        for r in sorted(one_pass(rows, block, nearest, positives, scale).collect(), key=lambda r: r["place"]):
            block.positives[r["node"]].append((r["id"], r["score"]))
        block.windows = [[(-(-low * s // 100), high * s // 100) for _, s in p] for p in block.positives]
        known = spark.createDataFrame([(n, j, int(block.ids[n]), i, s) for n, p in enumerate(block.positives) for j, (i, s) in enumerate(p)], "node int, slot int, anchor_id long, positive_id long, positive_score long")
        found = one_pass(rows, block, below, negatives, scale).join(known, ["node", "slot"])
        none = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
        found.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "place": "rank"}).select(
            "anchor_id", none("positive_id"), "rank", none("negative_id"), "positive_score", "negative_score").write.mode("append").parquet(folder)
    return spark.read.schema(RESULT).parquet(folder)


def digest(vectors: DataFrame) -> DataFrame:
    """Hard negatives of every fiftieth vector, where the label of every seventh is moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)
