"""Single-process tests of the methods against brute force."""

import random

import numpy as np
import pytest
import sentencepiece
import xxhash

from fellwalk.llm import langid, packing, quality, simhash, spm, suffix


def brute_removed(texts, width):
    """texts: (id, bytes) rows; the marked bytes of each."""
    first = {}
    for i, t in texts:
        for p in range(len(t) - width + 1):
            s = t[p:p + width]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in texts:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if first[t[p:p + width]] < i:
                hit[p:p + width] = True
        out.append(hit)
    return out


@pytest.mark.parametrize("letters", [1, 2, 3, 200])
def test_two_stage_is_the_suffix_array(letters):
    rng = random.Random(letters)
    for _ in range(100):
        t = bytes(rng.randint(0, letters) for _ in range(rng.randint(1, 80)))
        a = np.frombuffer(t, np.uint8)
        sa = suffix.two_stage(a, 1000)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix.common_prefixes(a, sa, 20)
        for i in range(1, len(t)):
            x, y = t[sa[i - 1]:], t[sa[i]:]
            n = next((k for k in range(min(len(x), len(y), 20)) if x[k] != y[k]), min(len(x), len(y), 20))
            assert lcp[i] == n


def test_runs_cover_every_string_once():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab \n\xc3") for _ in range(rng.choice([0, 10, 49, 50, 51, 300]))) for _ in range(60)]
    own, start, n, anchor = suffix.runs(texts)
    seen = sorted((o, s + k) for o, s, m in zip(own.tolist(), start.tolist(), n.tolist()) for k in range(m))
    assert seen == [(i, p) for i, t in enumerate(texts) for p in range(max(0, len(t) - 49))]
    by_string = {}
    for o, s, m, a in zip(own.tolist(), start.tolist(), n.tolist(), anchor.tolist()):
        for k in range(m):
            assert by_string.setdefault(texts[o][s + k:s + k + 50], a) == a


def test_exchanged_anchors_take_few_bytes():
    """A block of anchors takes under six bytes a row with its documents in 600 buckets, as at 6 GB."""
    rng = np.random.default_rng(5)
    h = np.sort(suffix.short(rng.integers(0, 1 << 63, 1 << 18, dtype=np.uint64)))
    doc = rng.integers(0, 1000, len(h))
    size = 0
    for to, own in suffix.dealt(suffix.range_of(h, 600)):
        body = suffix.packed(h[own].view(np.int64), doc[own])
        size += len(body)
        assert (suffix.unpacked(body, 2) == np.stack([h[own].view(np.int64), doc[own]])).all()
    assert size < 6 * len(h)


def test_passages_travel_once(spark):
    """The texts are exchanged once, compressed, for both joins, whatever other columns they have."""
    text = "the same passage of more than fifty bytes is in both of these documents, word for word. "
    docs = spark.createDataFrame([(i, f"{i} {text * 30} {i * 7919}", "web", i) for i in range(40)], "doc_id long, text string, source string, n long")
    for out in (suffix.digest(docs), suffix.rewritten(docs)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "_z" in plan and "ReusedExchange" in plan
        assert sum("hashpartitioning(_doc" in line and not "Reused" in line for line in plan.split("\n")) <= 5


def test_bucket_labels_equal_single_linkage(monkeypatch):
    rng = random.Random(2)
    for n, small in ((30, 1024), (300, 1024), (300, 8), (300, 8)):
        seeds = [rng.getrandbits(64) for _ in range(8)]
        x = np.unique(np.array([rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(n)], np.uint64))
        got = simhash.bucket_labels(x.copy(), small=small, rows=4096)
        near = np.bitwise_count(x[:, None] ^ x[None]) <= 3
        want = np.arange(len(x))
        while True:
            new = np.where(near, want[None], len(x)).min(1)
            if (new == want).all():
                break
            want = new
        assert got.tolist() == want.tolist()


def test_probes_meet_exactly_the_near_pairs():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    x = np.unique(np.array([b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(5)], np.uint64))
    key, fp = simhash.probes(x)
    order = np.argsort(key, kind="stable")
    a, b = simhash.bucket_edges(key[order], fp[order])
    label = {int(v): int(v) for v in x}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v
    for p, q in zip(a.tolist(), b.tolist()):
        assert (p ^ q).bit_count() <= 64
        label[max(root(p), root(q))] = min(root(p), root(q))
    for i in range(len(x)):
        for j in range(i):
            if (int(x[i]) ^ int(x[j])).bit_count() <= 3:
                assert root(int(x[i])) == root(int(x[j]))
    groups = {}
    for v in x.tolist():
        groups.setdefault(root(v), []).append(v)
    for g in groups.values():  # every group hangs together by links
        seen, todo = {g[0]}, [g[0]]
        while todo:
            v = todo.pop()
            for w in g:
                if w not in seen and (v ^ w).bit_count() <= 3:
                    seen.add(w)
                    todo.append(w)
        assert len(seen) == len(g)


def test_fingerprint_by_hand():
    text = "The cat sat ON the mat".encode()
    words = [b"the", b"cat", b"sat", b"on", b"the", b"mat"]
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > 4)
    got = simhash.fingerprints_of([text, b"", b" \t", b"one TWO"])
    assert got.tolist() == [want, 0, 0, xxhash.xxh64_intdigest(b"one two", 42)]


def test_measures_by_hand():
    text = "a b c a b c d\n\nx #$\nx #$\n \nx #$ "
    words = text.split()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    assert quality.measure(text.encode()) == (len(words), sum(map(len, words)), 6, 1, len(hit))
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc") .encode() for _ in range(rng.randint(0, 12))]
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        assert quality.repeat_words(words) == len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)})
    assert quality.measure("é é".encode()) == (1, 3, 0, 0, 0)


def test_beta_prior():
    assert quality.beta_prior(0, None, None, None, None) == (0.0, 1.0)
    rng = np.random.default_rng(0)
    rates = rng.beta(8, 24, 3000)
    n = rng.integers(20, 200, 3000)
    f = rng.binomial(n, rates)
    mean, strength = quality.beta_prior(3000, int(n.sum()), float((n * n).sum()), int(f.sum()), float((f * f / n).sum()))
    assert abs(mean - 0.25) < 0.01 and abs(strength - 32) < 5


def test_packing_holds_and_shrinks():
    rng = random.Random(4)
    for _ in range(30):
        n = [rng.choice([0, 1, 5, 60, 300, 511, 512, 513, 2000, 4096]) for _ in range(rng.randint(1, 80))]
        bins, capacity = packing.pack(n)
        fill = [0] * len(capacity)
        for m, b in zip(n, bins):
            fill[b] += m
        assert sum(fill) == sum(n)
        for f, c in zip(fill, capacity):
            assert f <= c == min(x for x in packing.CAPACITIES if x >= f)
        assert sum(capacity) <= 2 * sum(n) + 512
    assert packing.pack([]) == ([], [])
    assert packing.pack([100])[1] == [512]


def test_pieces_equal_the_library():
    t, lib = spm.load(spm.MODEL), sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    rng = random.Random(6)
    texts = ["", " ", "  a  b\nthe <s> ﬁ ① 梦", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "\t\t x", "naïve 😀", "    four", "a" * 3000]
    texts += ["".join(rng.choice("abcdefgh 東京éèß0123.,") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for x in texts:
        ids = t.encode(x).tolist()
        assert ids == lib.encode(x)
        assert t.decode(ids) == x == spm.decode_ids(t, np.array(ids, np.int32))


def message(*fields):
    """A protocol-buffer message of (number, value) fields."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])
    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += varint(k << 3) + varint(v)
        elif isinstance(v, float):
            out += varint(k << 3 | 5) + np.float32(v).tobytes()
        else:
            out += varint(k << 3 | 2) + varint(len(v)) + v
    return out


def test_unigram_path_is_the_cheapest():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -2.5, 1), ("ba", -6.0, 1), ("▁ab", -7.0, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += message((2, message((3, 1))), (3, message((3, 1), (4, 1), (5, 1))))
    t = spm.Transducer(data)

    def best(word):
        if not word:
            return 0.0
        return min((best(word[len(p):]) - s for p, s, k in pieces if k == 1 and word.startswith(p)), default=float("inf"))
    for x in ("ab", "abba", "bbab ab", "aabbab"):
        cost = -sum(t.pieces[i][1] for i in t.encode(x).tolist())
        assert abs(cost - sum(best(w) for w in spm.WORD.findall(t.normalise(x)))) < 1e-6
        assert t.decode(t.encode(x).tolist()) == x
    assert t.decode(t.encode("a?b").tolist()) == "a ⁇ b"


def test_codewords():
    for n in (1, 2, 4, 7, 30):
        c = langid.codewords(n)
        assert c.shape[0] == n and len({tuple(r) for r in c}) == n
        if n > 1:
            assert (np.abs(c.sum(0)) < n).all()


def test_gram_counts_stay_in_their_text():
    a, b = b"abcd", b"xyz"
    assert (langid.counts([a, b]) == np.concatenate([langid.counts([a]), langid.counts([b])])).all()
    assert langid.counts([a]).sum() == 3 + 2 + 1 and langid.counts([b"", b"q"]).sum() == 0
