"""Hard negatives against all scores."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from check import normal
from fellwalk.llm import negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, v int, id string, node int, score int, h int"


def brute(rows, keep=5, few=3, low=50, high=95):
    """rows: (vec_id, vector, label); ids are different."""
    use = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        use.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    last = lambda i: (i is None, i or 0)
    out = []
    for i, label, v in use:
        if i is None or i % 50:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, m == label) for j, m, w in use if j != i]
        for p, j, _ in sorted((s for s in scores if s[2]), key=lambda s: (-s[0], last(s[1])))[:keep]:
            fit = [s for s in scores if not s[2] and low * p <= 100 * s[0] <= high * p]
            for k, (n, q, _) in enumerate(sorted(fit, key=lambda s: (-s[0], last(s[1])))[:few]):
                out.append((i, j, k + 1, q, p, n))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, m, 1, "x", 2, 3, 4) for i, v, m in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in negatives.digest(df).collect()), key=key)


def clustered(seed, n, dim, labels, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(i * 5, (centres[i % 6] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize("seed,dim,labels,spread", [(1, 3, 2, 0.1), (2, 16, 10, 0.5), (3, 2, 3, 0.02)])
def test_equals_all_scores(spark, monkeypatch, seed, dim, labels, spread):
    monkeypatch.setattr(negatives, "ANCHORS", 9)  # several blocks
    rows = clustered(seed, 400, dim, labels, spread)
    assert mined(spark, rows) == sorted(brute(rows), key=key) != []


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = clustered(4, 120, 3, 3, 0.1)
    rows += [(1, None, 1), (2, [0.5, None, 1.0], 1), (3, [float("nan"), 1.0, 1.0], 0), (4, [1.0, float("inf"), 0.0], 0), (6, [1.0, 1.0, 1.0], None), (50_000, [1.0, 2.0], 1), (50_050, [], 2), (7_001, [1.0, 2.0, 3.0, 4.0], 1),
             (None, [1.0, 1.0, 1.0], 1), (11, [0.0, 0.0, 0.0], 1), (100_050, [0.0] * 3, 0)]
    tie = [rng.random() for _ in range(3)]
    rows += [(700 * k + 33, tie, k % 3) for k in range(60)]
    assert mined(spark, rows) == sorted(brute(rows), key=key)
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_scores_beyond_floating_point(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([0, 10, 21, 22]) for _ in range(3)], i % 3) for i in range(1, 200)]
    rows += [(i, [rng.uniform(0.5, 1) * 2.0 ** 22 for _ in range(3)], i % 2) for i in range(200, 420)]
    assert mined(spark, rows) == sorted(brute(rows), key=key) != []


def test_equal_rows_count_each(spark):
    rows = [(50, [1.0], 1), (50, [1.0], 1), (3, [1.0], 1), (3, [1.0], 1), (4, [0.9], 2), (4, [0.9], 2), (5, [0.2], 2)]
    assert [r[:4] for r in mined(spark, rows)] == [(50, 3, 1, 4)] * 2 + [(50, 3, 2, 4)] * 2


def test_bounds_leave_rows_out():
    """In clusters most rows are never scored."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 16)) * 8
    at = rng.integers(8, size=4000)
    rows = np.floor(256 * (centres[at] + 0.02 * rng.normal(size=(4000, 16))))
    labels = at % 4
    a = rows[::50]
    block = negatives.Block(np.arange(4000)[::50], labels[::50], a, negatives.spanning_tree(a))
    assert sorted(n for n, _, _ in block.tree) == list(range(80)) and all(p in {m for m, _, _ in block.tree[:k]} for k, (_, p, _) in enumerate(block.tree) if k)
    batch = pa.record_batch([pa.array(np.arange(4000)), pa.array(labels), pa.array(list(rows / 256))], names=["id", "label", "v"])
    rules, best = negatives.nearest(block, 5)
    scored = negatives.scan(block, iter([batch]), rules, 256)
    assert scored < 0.4 * 80 * 4000
    for k, held in enumerate(best):
        s = rows @ a[k]
        ok = (labels == labels[50 * k]) & (np.arange(4000) != 50 * k)
        assert held[0] == sorted((-int(s[i]), int(i)) for i in np.flatnonzero(ok))[:5]


def test_on_embeddings(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    got = entry.queries()["op11_spanning_tree_negatives"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(list(zip(d.vec_id.tolist(), d.embedding.map(lambda v: v.tolist()), d.label.tolist()))), key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert normal(got.toPandas()) == normal(con.sql(entry.oracle_sql()["op11_spanning_tree_negatives"]).df())
