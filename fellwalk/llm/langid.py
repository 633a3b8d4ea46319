"""Language identification by error-correcting output codes.

Every language gets a codeword; for each bit a binary n-gram classifier tells the languages with a 1
from those with a 0. The classifiers are naive Bayes over hashed byte 2-, 3- and 4-grams, whose counts
per language Spark adds up over all training texts. A second pass over the training texts measures how
often each bit is right for each language; these figures weight the losses when the nearest codeword
is chosen. A prediction whose two nearest codewords are close is flagged as ambiguous.

Up to 7 languages the code is exhaustive (each way to split them once); for more it has random
columns, drawn from a fixed seed, until rows are far apart. The model is bounded by
`MAX_LANGUAGES` x `DIM` counts, whatever the input, and is sent to the tasks.

Edge cases: null texts and texts without a letter are `und` with score 0; a text without known n-grams
has no margin and takes the prior's choice; a table without training rows gives `und` everywhere; rows
with null doc_id belong to the training part (their remainder is taken as 1); repeated rows count
each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellwalk.llm.common import blocks, text_bytes

DIM = 1 << 14
ORDERS = (2, 3, 4)
MAX_LANGUAGES = 512
#: Margins closer than this share of the best one's lead are ambiguous.
CLOSE = 0.1
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 and -1
    weights: np.ndarray  # DIM x bits, log odds
    bias: np.ndarray  # bits
    trust: np.ndarray  # languages x bits, rows add up to 1


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5, F.lit(1)) == 0


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1 for n languages; no column is constant."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 7:
        cols = [[1, *(1 if b >> i & 1 else -1 for i in range(n - 1))] for b in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        apart = ((bits - code @ code.T) / 2 + np.eye(n) * bits).min()
        if apart > far:
            best, far = code, apart
    return best


def counts(texts: list[bytes], dim: int = DIM) -> np.ndarray:
    """Hashed n-gram counts, one row a text; no n-gram crosses texts."""
    size = np.array([len(t) for t in texts])
    t = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), size)
    out = np.zeros(len(texts) * dim, np.int64)
    gram = t
    for n in range(2, max(ORDERS) + 1):
        if len(t) < n:
            break
        gram = gram[:len(t) - n + 1] << np.uint32(8) | t[n - 1:]
        if n in ORDERS:
            h = (gram ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1) >> np.uint32(18)
            inside = owner[:len(h)] == owner[n - 1:]
            out += np.bincount((owner[:len(h)] * dim + h % np.uint32(dim))[inside], minlength=len(out))
    return out.reshape(len(texts), dim)


def counted(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, counts) for blocks of texts; lower case, 64 texts at once."""
    texts = [t.decode("utf-8", "replace").lower().encode() for t in texts]
    for lo, hi in blocks([len(t) + (1 << 14) for t in texts], 1 << 20):
        yield lo, hi, counts(texts[lo:hi])


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows(lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lo, hi, c in counted(text_bytes(b)):
                for lang in set(langs[lo:hi]):
                    part = c[langs[lo:hi] == lang].sum(0)
                    total[lang] = total[lang] + part if lang in total else part
        for lang, c in total.items():
            some = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(c[some])], names=["lang", "gram", "n"])
    return rows.select("lang", "text").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def margins(model: Model, c: np.ndarray) -> np.ndarray:
    """texts x bits: mean log odds of the n-grams, scaled to about -1..1."""
    n = np.maximum(c.sum(1, keepdims=True), 1)
    return np.tanh((c @ model.weights) / n * np.minimum(n, 64) ** 0.5 + model.bias / n)


def decode(model: Model, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, ambiguous) by the exponential loss of each codeword, its bits weighted by trust."""
    loss = np.einsum("lb,tlb->tl", model.trust, np.exp(-model.code[None] * margin[:, None]))
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    score = 1 / share.sum(1)
    if loss.shape[1] == 1:
        return best, score, np.zeros(len(best), bool)
    low, second = np.take_along_axis(loss, order[:, :2], 1).T
    return best, score, second - low < CLOSE * np.maximum(1 - low, 1e-9)


def train(rows: DataFrame, alpha: float = 0.5) -> Model | None:
    """A model from rows(text, lang); rows with null lang are left out."""
    rows = rows.where("lang IS NOT NULL").select("lang", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if len(langs := [r["lang"] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return None
    langs = sorted(langs)
    table = gram_counts(rows).toArrow()
    c = np.zeros((len(langs), DIM))
    at = {x: i for i, x in enumerate(langs)}
    c[[at[x] for x in table.column("lang").to_pylist()], table.column("gram").to_numpy()] = table.column("n").to_numpy()
    code = codewords(len(langs))
    share = (c + alpha) / (c + alpha).sum(1, keepdims=True)  # each language counts alike within a side
    weights = np.zeros((DIM, code.shape[1]))
    for b in range(code.shape[1]):
        one, zero = code[:, b] > 0, code[:, b] < 0
        if one.any() and zero.any():
            weights[:, b] = np.log(share[one].mean(0)) - np.log(share[zero].mean(0))
    model = Model(langs, code, weights, np.zeros(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, seen = np.zeros(code.shape), np.zeros(len(langs), np.int64)
        for b in batches:
            own = np.array([at[x] for x in b.column(0).to_pylist()], int)
            for lo, hi, part in counted(text_bytes(b)):
                right = (margins(model, part) * code[own[lo:hi]] > 0).astype(float)
                np.add.at(good, own[lo:hi], right)
                np.add.at(seen, own[lo:hi], 1)
        i, j = np.nonzero(np.ones(code.shape))
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(good[i, j]), pa.array(seen[i])], names=["l", "b", "good", "seen"])
    sums = rows.mapInArrow(run, "l int, b int, good double, seen long").groupBy("l", "b").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).toArrow()
    trust = np.zeros(code.shape)
    trust[sums.column("l").to_numpy(), sums.column("b").to_numpy()] = sums.column("good").to_numpy() / np.maximum(sums.column("seen").to_numpy(), 1)
    trust = np.maximum(trust, 1e-3)
    model.trust = trust / trust.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every whole text; only the text is used."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b)
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if model is not None:
                for lo, hi, c in counted(texts):
                    best, s, u = decode(model, margins(model, c))
                    for i in range(lo, hi):
                        if LETTER.search(texts[i].decode("utf-8", "replace")):
                            lang[i], score[i], unsure[i] = model.languages[best[i - lo]], s[i - lo], u[i - lo]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lang), pa.array(score), pa.array(unsure)], names=[x.split()[0] for x in schema.split(", ")])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("h"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs.where(~held_out())))
