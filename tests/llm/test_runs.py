"""Periodic runs against their definition."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from fellwalk.llm import runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, n_words int, collapsed string, start int"


def brute(words, least=6, powers=4):
    """Every stretch with its smallest period, tried one period after another."""
    n, out = len(words), []
    for q in range(1, n // powers + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, powers * q) and not any(s <= i and i + (j - i + q) <= s + m and q % p == 0 for s, m, p in out):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {k for s, m, p in found for k in range(s + p, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    line = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc, len(found), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("letters,seed", [(1, 0), (2, 1), (2, 2), (3, 3), (40, 4)])
def test_random_words(letters, seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < rng.randint(0, 160):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            words += (unit * rng.randint(1, 9))[:rng.randint(1, 60)]
        assert [tuple(r) for r in runs.periodic_runs(np.array(words, np.int64)).tolist()] == brute(words)


def test_nested_and_long_periods():
    unit = [0, 0, 0, 0, 0, 0, 0, 1] * 1 + list(range(2, 300))
    words = np.array(unit * 5, np.int64)
    got = [tuple(r) for r in runs.periodic_runs(words).tolist()]
    assert (0, len(words), len(unit)) in got and sum(p == 1 for _, _, p in got) == 5
    same = np.zeros(100_000, np.int64)
    assert runs.periodic_runs(same).tolist() == [[0, 100_000, 1]]
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 3000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert not len(runs.periodic_runs(np.array(fibonacci[1])))  # no fourth powers


def test_wide_names():
    """Names too wide for one packed key are sorted by columns."""
    a, b, i = np.array([1 << 40, 5, 1 << 40, 1 << 40, 5]), np.array([1 << 30, 2, 1 << 30, 1 << 30, 2]), np.array([9, 1, 4, 7, 3])
    name, place = runs.by_name(a, b, i)
    assert name.tolist() == [0, 0, 0] and place.tolist() == [4, 7, 9]


def test_odd_rows(spark):
    rng = random.Random(7)
    texts = [None, "", " \t\n ", "one", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "x\x0by\x0cx\ry x y x y x y", "é ü " * 50, "a b " * 7,
             " ".join(rng.choice("abc") for _ in range(400)), "z " * 40_000, ("p q r " * 9 + "s t ") * 12]
    rows = [(i * 7 - 3, t) for i, t in enumerate(texts)] + [(4, "a " * 9), (4, "a " * 9), (None, "b c " * 9), (None, None)]
    rows += [(i, " ".join(rng.choice("ab") for _ in range(90))) for i in range(100, 180)]
    df = spark.createDataFrame([(i, t, "r", 1, "c", 2) for i, t in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in runs.digest(df).collect()]
    quick = [(i, t) for i, t in rows if t is None or len(t) < 5000]
    want = [expected(i, t) for i, t in quick]
    long = [r for r in got if r[0] == 12 * 7 - 3]
    assert len(got) == len(rows) and sorted((r for r in got if r[0] != 12 * 7 - 3), key=key) == sorted(want, key=key)
    assert long[0][1:6] == (1, 0, 40_000, 1, 40_000_000)
    assert runs.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_on_documents(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()}
    short = [(i, t) for i, t in zip(d.doc_id.tolist(), d.text) if len(t) < 6000]
    assert len(got) == len(d) and len(short) > 100
    for i, t in short:
        assert got[i] == expected(i, t)
    assert sum(r[1] > 0 for r in got.values()) > 10
