"""Token-id files against the tokenizers library."""

import io
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from fellwalk.llm import tokenids

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids string, tie int, shard int, start int, n_tokens int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    return open(PATH, encoding="utf-8").read()


def expected(rows):
    """Rows are in order."""
    t, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


HARD = ["", " ", "  ", "a  b", "a   b", "a\n  b", "a\n\n b ", "don't we'll 'sx x's 'S's", "cafés naïveλ λabc abcλ abc² x×y", "你好世界" * 200,
        "a<|endoftext|>b  <|endoftext|> c", "x\x1cy \x1f z\x85w\xa0v　u", "12ab34 ab12,;:!?(a) \"q\"", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "éà ô", "A" * 5000, "\t\tx\t\ty \t z\t"]


def test_pieces_equal_whole_texts(model):
    rng = random.Random(3)
    marks = ["a", "bé", " ", " ", "\n", "'", "s", "12", ".", "λ", "́", "\xa0", "　", "<|endoftext|>", "\x1d", "²", "Z", "-"]
    texts = HARD + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    enc = tokenids.Encoder(model)
    assert enc.by_piece and enc.width == 2
    t = Tokenizer.from_str(model)
    want = [np.array(e.ids, "<u2").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    enc.old, enc.young = enc.young, {}
    assert enc.encode(texts[::-1]) == want[::-1]


def test_other_tokenizers_are_encoded_whole():
    model = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    enc = tokenids.Encoder(model)
    assert not enc.by_piece
    assert np.frombuffer(enc.encode(["Hello, world"])[0], enc.kind).tolist() == Tokenizer.from_str(model).encode("Hello, world", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_file_round_trip(kind, width):
    rng = np.random.default_rng(1)
    docs = [(d, rng.integers(0, 1 << (8 * width - 1), n).astype(f"<u{width}")) for d, n in [(5, 0), (7, 3), (None, 100), (9, 17), (9, 1), (10, 64), (11, 5)]]
    out = io.BytesIO()
    assert tokenids.write_file(out, ((d, i.tobytes()) for d, i in docs), width, kind, 16) == [len(i) for _, i in docs]
    shard = tokenids.Shard(pa.BufferReader(out.getvalue()))
    for a in range(len(docs) + 1):
        for b in range(a, len(docs) + 1):
            got = list(shard.ids(a, b)) if a < b else []
            assert [(d, i.tolist()) for d, _, i in got] == [(d, i.tolist()) for d, i in docs[a:b]]
            assert all(at == sum(len(i) for _, i in docs[:a + k]) for k, (_, at, _) in enumerate(got))
    with pytest.raises(ValueError):
        tokenids.Shard(pa.BufferReader(out.getvalue()[:-3]))


def test_odd_rows(spark, tmp_path, model):
    rows = [(i * 3 - 9, t) for i, t in enumerate(HARD)] + [(None, None), (None, None), (1 << 62, "far"), (-(1 << 63), "first")]
    df = spark.createDataFrame([(d, t, "i", 1, 2, 3, 4) for d, t in rows], SCHEMA).repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    folder = f"file://{tmp_path}/a"
    got = [tuple(r) for r in tokenids.digest(spark, df, folder, PATH).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(order)
    segments = tokenids.write_shards(df, f"file://{tmp_path}/b", model, "bit")
    texts = {r["start"]: r["ids"] for r in tokenids.read_ids(segments, f"file://{tmp_path}/b").collect()}
    assert {a: zlib.crc32(np.array(i, "<u4").tobytes()) for a, i in texts.items()} == {r[1]: r[3] for r in got}
    empty = spark.createDataFrame([], SCHEMA)
    assert tokenids.digest(spark, empty, f"file://{tmp_path}/c", PATH).count() == 0


def test_hot_id_is_dealt_to_several_shards(spark, tmp_path, model):
    rows = [(7, f"text {k}") for k in range(300)] + [(k, "x") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    segments = tokenids.write_shards(df, f"file://{tmp_path}", model)
    got = sorted(tokenids.read_ids(segments, f"file://{tmp_path}").collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in rows)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert sorted(tuple(r["ids"]) for r in got if r["doc_id"] == 7) == sorted((*i.ids, 0) for i in Tokenizer.from_str(model).encode_batch([t for d, t in rows if d == 7]))
    assert segments.where("stop - first > 150").isEmpty()


def test_on_documents(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = sorted(map(tuple, entry.queries()["op12_token_id_planes"](spark, SF).collect()), key=lambda r: r[1])
    assert got == expected(list(zip(d.doc_id.tolist(), d.text)))
