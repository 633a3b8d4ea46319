"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits in two segments of 32. Two fingerprints that differ in `3` bits or fewer
differ in at most one bit of some segment, so each fingerprint enters its two segment tables, probes
the Hamming ball of radius one around each segment, and every match is verified on all 64 bits.
Only bits that are 0 are flipped: of two segments that differ in one bit, one has the 0.

Equal fingerprints are collapsed before the search. A bucket returns one edge for each member at
most (towards the smallest member it is linked with), never its pairs.

Edge cases: null and blank texts have fingerprint zero and are linked like any other; a null doc_id
counts as the last id, and a component of such rows only has a null component_id; repeated rows get
equal results; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellwalk.llm.common import LAST_ID, blocks, order_id, partitions, text_bytes
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.graphs import connected_components

BITS = 3
ONES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, width: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of `width` words, words lower-cased in A-Z and joined by one blank."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[width - 1:])]


def majority(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints of lists of hashes laid end to end, n of each: a bit is 1 if it is set in more than half of a list."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(flat.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, np.r_[0, np.cumsum(n[full])[:-1]], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * counts > n[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints_of(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in more than half of the text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi in blocks([len(t) for t in texts], 1 << 20):
        hashes = [shingle_hashes(t, width, seed) for t in texts[lo:hi]]
        out[lo:hi] = majority(np.array([x for h in hashes for x in h], dtype="<u8"), np.array([len(h) for h in hashes]))
    return out


def with_fingerprint(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of each row; doc_id null becomes the last id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(fingerprints_of(text_bytes(b), width, seed).view(np.int64))], names=["doc_id", "fp"])
    return docs.select(order_id().alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def probes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: the two table rows and the probes of each fingerprint."""
    keys, owners = [], []
    for t in (0, 1):
        half = (fp >> np.uint64(32 * t)) & np.uint64(0xFFFFFFFF)
        tag = np.uint64(t << 32)
        keys.append(half | tag)
        owners.append(fp)
        for bit in ONES[:32]:
            zero = (half & bit) == 0
            keys.append(half[zero] | bit | tag)
            owners.append(fp[zero])
    return np.concatenate(keys), np.concatenate(owners)


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the classes of a[i] and b[i]; a label is the smallest index of its class."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            new = label[label]
            if (new == label).all():
                break
            label = new


def bucket_labels(x: np.ndarray, bits: int = BITS, small: int = 1024, rows: int = 1 << 23) -> np.ndarray:
    """For distinct fingerprints, the index of the smallest one that is reachable over links inside the bucket.

    Up to `small` members all are compared. More go in two exact steps: members that share a value
    one bit away differ in two bits or fewer and are joined by sorting those values (in slices of
    about `rows`); then the members outside the largest class are compared with all, in blocks.
    """
    n = len(x)
    label = np.arange(n)
    if n > small and bits >= 2:
        slices = -(-65 * n // rows)
        flips = np.r_[np.uint64(0), ONES]
        for s in range(slices):
            values, members = [], []
            for f in flips:
                v = x ^ f
                own = np.flatnonzero((v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(slices) == s) if slices > 1 else np.arange(n)
                values.append(v[own])
                members.append(own)
            v, m = np.concatenate(values), np.concatenate(members)
            order = np.argsort(v, kind="stable")
            v, m = v[order], m[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            label = union(label, m[same], m[same + 1])
        rest = np.flatnonzero(label != np.bincount(label).argmax())
    else:
        rest = np.arange(n)
    step = max(1, (1 << 22) // n)
    for lo in range(0, len(rest), step):
        i, j = np.nonzero(np.bitwise_count(x[rest[lo:lo + step], None] ^ x[None, :]) <= bits)
        label = union(label, rest[lo + i], j)
    return label


def bucket_edges(key: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all buckets; `key` is sorted."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    a, b = [], []
    two = ends - starts == 2
    x, y = fp[starts[two]], fp[starts[two] + 1]
    near = np.bitwise_count(x ^ y) <= bits
    a.append(np.maximum(x, y)[near])
    b.append(np.minimum(x, y)[near])
    for s, e in zip(starts[~two], ends[~two]):
        if e - s > 2:
            x = np.unique(fp[s:e])
            label = bucket_labels(x, bits)
            moved = np.flatnonzero(label != np.arange(len(x)))
            a.append(x[moved])
            b.append(x[label[moved]])
    return np.concatenate(a), np.concatenate(b)


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): edges that connect the same fingerprints as all links do. fps(fp) are distinct."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments and balls of radius one serve up to 3 bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = probes(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], names=["key", "fp"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def done(key, fp):
            a, b = bucket_edges(key, fp.view(np.uint64), bits)
            both = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0)
            return pa.record_batch([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for b in batches:
            held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]))
            size += b.num_rows
            if size >= 1 << 19:
                rows = np.concatenate(held, axis=1)
                last = np.searchsorted(rows[0], rows[0, -1])  # the last bucket may go on
                if last:
                    yield done(rows[0, :last], rows[1, :last])
                    rows = rows[:, last:]
                held, size = [rows], 0 if last else -rows.shape[1]
        if held and (rows := np.concatenate(held, axis=1)).shape[1]:
            yield done(rows[0], rows[1])

    rows = fps.select("fp").mapInArrow(emit, "key long, fp long")
    return rows.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key").mapInArrow(match, "a long, b long")


def near_groups(docs: DataFrame, width: int = 3, seed: int = 42, bits: int = BITS) -> DataFrame:
    """(doc_id, fp, component_id) of each row: the smallest doc_id that links lead to."""
    rows = cut(with_fingerprint(docs, width, seed))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = cut(near_links(distinct, bits).distinct())
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    labels = connected_components(ends, edges).withColumnRenamed("id", "fp")
    known = distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    firsts = known.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = known.join(firsts, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    real = lambda c: F.nullif(F.col(c), F.lit(LAST_ID)).alias(c)
    return near_groups(docs, **kw).select(real("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real("component_id"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` that stay when one document of each component is kept: that with the smallest doc_id.

    Of rows that share this doc_id one stays (the smallest text hash).
    """
    ids = near_groups(docs, **kw).where("doc_id = component_id").select(F.col("component_id").alias("_id")).distinct()
    kept = docs.withColumn("_id", order_id()).join(ids, "_id", "left_semi")
    repeated = cut(docs.groupBy(order_id().alias("_id")).agg(F.count("*").alias("_n"), F.min(F.xxhash64("text")).alias("_h")).where("_n > 1"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(repeated, "_id", "left").where(F.col("_n").isNull() | (F.xxhash64("text") == F.col("_h")))
    return once.dropDuplicates(["_id"]).select(docs.columns)
