"""The query parser's network: embeddings of hashed features, shared by a role head per word and a category head per query.

A word is the mean of its features' embeddings, a query the mean of its words. Training runs by parts: in every epoch each
part of the queries starts from the common model and takes minibatches with Adagrad; a row that it changed goes into the
next common model with the number of its changes as weight. The model is bounded by its buckets, and a part holds one
batch of queries at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, DIM = 16384, 16
EPOCHS, RATE, CAT_WEIGHT, BATCH = 6, 0.25, 0.6, 256  # fixed values
#: Queries of a part, and most parts: every part gives up to one model an epoch.
PART, PARTS = 8192, 64


@dataclass
class QueryNet:
    """int8 embeddings (times `scale`) and the heads' rows of weights with the bias last."""

    embedding: np.ndarray
    scale: float
    role_head: np.ndarray
    cat_head: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        """embedding(bucket, v), as `model_parse` reads it."""
        return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(self.embedding)], "bucket int, v array<double>")

    def head(self) -> Column:
        arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
        parts = {"role_w": F.array(*[arr(r[:-1]) for r in self.role_head]), "role_b": arr(self.role_head[:, -1]),
                 "cat_w": F.array(*[arr(r[:-1]) for r in self.cat_head]), "cat_b": arr(self.cat_head[:, -1])}
        return F.struct(*[c.alias(k) for k, c in parts.items()])


@dataclass
class Packed:
    """A batch of queries, flat: feature buckets, features per word, words per query, role per word, category per query."""

    buckets: np.ndarray
    n_features: np.ndarray
    n_words: np.ndarray
    roles: np.ndarray
    cats: np.ndarray


def packed(b: pa.RecordBatch) -> Packed:
    """From columns (features array<array<int>>, roles array<int>, cat int)."""
    words = b.column(0).flatten()
    return Packed(words.flatten().to_numpy(), pc.list_value_length(words).to_numpy(), pc.list_value_length(b.column(0)).to_numpy(),
                  b.column(1).flatten().to_numpy(), b.column(2).to_numpy())


def _starts(n: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(n)[:-1]]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(model: np.ndarray, x: Packed, buckets: int, roles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of words and queries, probabilities of roles and categories. model: embeddings, role head, category head."""
    d = model.shape[1] - 1
    word = np.add.reduceat(model[x.buckets, :d], _starts(x.n_features)) / x.n_features[:, None].astype(np.float32)
    query = np.add.reduceat(word, _starts(x.n_words)) / x.n_words[:, None].astype(np.float32)
    r, c = model[buckets:buckets + roles], model[buckets + roles:]
    return word, query, _softmax(word @ r[:, :d].T + r[:, d]), _softmax(query @ c[:, :d].T + c[:, d])


def gradient(model: np.ndarray, x: Packed, weights: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their gradients) of the weighted cross entropies of roles and categories over a batch."""
    d, roles = model.shape[1] - 1, len(weights)
    word, query, pr, pc_ = forward(model, x, buckets, roles)
    pr[np.arange(len(pr)), x.roles] -= 1
    pc_[np.arange(len(pc_)), x.cats] -= 1
    dr, dc = pr * weights[x.roles][:, None], pc_ * np.float32(CAT_WEIGHT)
    heads = np.concatenate([np.c_[dr.T @ word, dr.sum(0)], np.c_[dc.T @ query, dc.sum(0)]])
    dw = dr @ model[buckets:buckets + roles, :d]
    dw += np.repeat((dc @ model[buckets + roles:, :d]) / x.n_words[:, None], x.n_words, axis=0)
    dw /= x.n_features[:, None]
    order = np.argsort(x.buckets, kind="stable")
    owner = np.repeat(np.arange(len(dw)), x.n_features)[order]
    rows, at = np.unique(x.buckets[order], return_index=True)
    own = np.add.reduceat(dw[owner], at)
    return np.r_[rows, np.arange(buckets, len(model))], np.concatenate([np.c_[own, np.zeros(len(own))], heads]).astype(np.float32)


def _train(model: np.ndarray, squares: np.ndarray, weights: np.ndarray, buckets: int, epoch: int, epochs: int):
    """One epoch over the queries of a part: (row, part, changes, parameters and sums of squares) of the rows it changed."""
    rate = np.float32(RATE * (1 - epoch / epochs * 0.7))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own, sums, changes = model.copy(), squares.copy(), np.zeros(len(model), np.int64)
        rng = np.random.default_rng([epoch, part])
        for b in batches:
            order = rng.permutation(b.num_rows)
            for i in range(0, b.num_rows, BATCH):
                rows, g = gradient(own, packed(b.take(pa.array(order[i:i + BATCH]))), weights, buckets)
                sums[rows] += g * g
                own[rows] -= rate * g / np.sqrt(sums[rows])
                changes[rows] += 1
        rows = np.flatnonzero(changes)
        v = np.c_[own[rows], sums[rows]].astype(np.float32)
        for i in range(0, len(rows), 4096):
            one = v[i:i + 4096]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(one) + 1, dtype=np.int32) * v.shape[1]), pa.array(one.ravel()))
            yield pa.record_batch([pa.array(rows[i:i + 4096].astype(np.int32)), pa.array(np.full(len(one), part, np.int32)), pa.array(changes[rows[i:i + 4096]]), lists], names=["row", "part", "n", "v"])
    return run


def fit(examples: DataFrame, weights: list[float], cats: int, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS) -> QueryNet:
    """examples(features array<array<int>>, roles array<int>, cat int) in parts that stay the same from epoch to epoch; weights per role."""
    rng = np.random.default_rng(1)
    w = np.array(weights, np.float32)
    size = buckets + len(w) + cats
    model = (rng.standard_normal((size, dim + 1)) * 0.1).astype(np.float32)
    model[:, dim] = 0
    squares = np.full_like(model, 1e-6)
    for epoch in range(epochs):
        rows = examples.select("features", "roles", "cat").mapInArrow(_train(model, squares, w, buckets, epoch, epochs), "row int, part int, n long, v array<float>")
        # in order of the parts, so that the sums do not depend on which task ends first
        parts = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("part", "n", "v"))).alias("p"))
        zero = F.array_repeat(F.lit(0.0), 2 * (dim + 1))
        total = F.aggregate("p", zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x * p["n"]))
        count = F.aggregate("p", F.lit(0).cast("long"), lambda acc, p: acc + p["n"])
        for r in parts.select("row", F.transform(total, lambda x: x / count).alias("v")).toLocalIterator():
            model[r["row"]], squares[r["row"]] = r["v"][:dim + 1], r["v"][dim + 1:]
    emb = model[:buckets, :dim]
    scale = float(np.abs(emb).max() / 127)
    return QueryNet(np.clip(np.round(emb / scale), -127, 127).astype(np.int8), scale, model[buckets:buckets + len(w)], model[buckets + len(w):])


def evaluate(net: QueryNet, examples: DataFrame) -> DataFrame:
    """words, role_accuracy, name_recall, queries, category_accuracy of the net over examples."""
    buckets, roles = len(net.embedding), len(net.role_head)
    emb = net.embedding.astype(np.float32) * np.float32(net.scale)
    model = np.concatenate([np.c_[emb, np.zeros(buckets, np.float32)], net.role_head, net.cat_head]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BATCH):
                x = packed(b.slice(i, BATCH))
                _, _, pr, pc_ = forward(model, x, buckets, roles)
                hit, name = pr.argmax(1) == x.roles, x.roles == 0
                sums = len(hit), hit.sum(), name.sum(), (hit & name).sum(), len(x.cats), (pc_.argmax(1) == x.cats).sum()
                yield pa.record_batch([pa.array([int(s)]) for s in sums], names=list("abcdef"))
    s = examples.select("features", "roles", "cat").mapInArrow(run, ", ".join(f"{c} long" for c in "abcdef"))
    n = {c: F.coalesce(F.sum(c), F.lit(0)) for c in "abcdef"}
    share = lambda a, b: n[a] / F.nullif(n[b], F.lit(0))
    return s.agg(n["a"].alias("words"), share("b", "a").alias("role_accuracy"), share("d", "c").alias("name_recall"), n["e"].alias("queries"), share("f", "e").alias("category_accuracy"))
