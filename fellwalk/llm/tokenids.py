"""Token-id files: ids of documents in bit or byte planes, each plane compressed, with a chunk index.

Texts are encoded where they are read; only packed ids are shuffled. Documents are dealt to shards by
ranges of doc_id, whose bounds are quantiles of that column alone. An id that holds the rows of several
ranges is dealt on by a hash of the text, so no shard takes a hot id whole. A task sorts its shard (Spark
spills) and writes it as one file, chunk by chunk; the first id number of every document follows from the
totals of the shards.

File: magic; chunks of CHUNK ids (the last is shorter), each transposed to planes (one for each byte or
bit of the id width), every plane a zstandard frame; then two Arrow streams, the documents (doc_id,
n_tokens) and the chunk index (offset, n_ids, length of every plane, checksum of the ids); then a trailer
with the kind of planes, the width and the lengths. A reader takes any range of documents and inflates
only the chunks that hold it. Files are written under a temporary name and moved, so a repeated task
leaves the same file.

Encoding equals the tokenizers library's on the whole text. For byte-level tokenizers that split by the
usual pattern, a text is cut at places where that pattern always cuts (before a blank that precedes a
word, between a word and what follows it), every different piece is encoded once by the library, and the
last pieces are remembered. Texts with the string of an added token, and all texts for other tokenizers,
are encoded whole.

Edge cases: a null or empty text has the end id only; a null doc_id comes last; rows with equal doc_id
are ordered by a hash of the text; equal rows are kept apart; an empty table writes no shard and reads
back empty; other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fellwalk.llm.common import blocks, order_id, partitions
from fellwalk.llm.warc import _stored as stored
from fellwalk.llm.warc import file_system

CHUNK, LEVEL, END = 1 << 16, 3, 0
MAGIC, TRAILER = b"IDPLANES", "<BBIQQ"
KINDS = ("bit", "byte")
#: What \s stands for in the split pattern of byte-level tokenizers.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Words of Latin letters that no other letter can follow, any other stretch without white space, and white space.
PIECE = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?![^\x00-\x7f])| ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
KEPT, LONGEST = 1 << 18, 64
#: Ids in the part of a shard that one task reads back.
SEGMENT = 1 << 22
WRITTEN = "shard long, first long, stop long, n_ids long"


class Encoder:
    """Ids of whole texts as packed little-endian integers."""

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.width = id_width(model)
        self.kind = np.dtype(f"<u{self.width}")
        spec = json.loads(model)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") \
            and not spec.get("truncation") and not spec.get("padding")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self.whole(texts)
        cut = [None if any(a in t for a in self.added) else PIECE.findall(t) for t in texts]
        need = set().union(*(c for c in cut if c)) - self.young.keys()
        known = need & self.old.keys()
        new = list(need - known)
        ids = {p: self.old[p] for p in known} | dict(zip(new, self.whole(new)))
        long = {p: v for p, v in ids.items() if len(p) > LONGEST}
        self.young.update((p, v) for p, v in ids.items() if len(p) <= LONGEST)
        look = {**self.young, **long} if long else self.young
        out = [self.whole([t])[0] if c is None else b"".join(map(look.__getitem__, c)) for t, c in zip(texts, cut)]
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        return out


_encoders: dict[int, Encoder] = {}


def encoder(model: str) -> Encoder:
    """The worker's encoder of a model, with the pieces of earlier tasks."""
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def id_width(model: str) -> int:
    spec = json.loads(model)
    vocab = spec["model"]["vocab"]
    largest = max([END, *(vocab.values() if isinstance(vocab, dict) else [len(vocab)]), *(t["id"] for t in spec.get("added_tokens", []))])
    return 2 if largest < 1 << 16 else 4


def encoded(docs: DataFrame, model: str, end: int = END) -> DataFrame:
    """(doc_id, tie, ids) of each row: packed ids with the end id, and a hash of the text that orders rows of one doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        last = np.array([end], enc.kind).tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in blocks([len(t) for t in texts], 1 << 20):
                part = batch.slice(lo, hi - lo)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([b + last for b in enc.encode(texts[lo:hi])], pa.binary())], names=["doc_id", "tie", "ids"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, "doc_id long, tie long, ids binary")


def shard_of(doc_id: Column, tie: Column, bounds: list[int]) -> Column:
    """The number of a row's range; rows of an id that fills several ranges are dealt to these by `tie`, in its order."""
    held = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    low, high = F.size(F.filter(held, lambda b: b < doc_id)), F.size(F.filter(held, lambda b: b <= doc_id))
    share = (F.shiftright(tie, 1) + F.lit(1 << 62)) / F.lit(float(1 << 63))
    return F.least(low + F.floor(share * (high - low + 1)).cast("int"), high)


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """(planes, bytes): the ids' bytes or bits, one row for each place."""
    rows = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    return np.ascontiguousarray(rows.T) if kind == "byte" else np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1)


def from_planes(planes: np.ndarray, kind: str, n: int) -> np.ndarray:
    width = len(planes) if kind == "byte" else len(planes) // 8
    rows = planes.T if kind == "byte" else np.packbits(np.unpackbits(planes, axis=1, count=n).T, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(f"<u{width}").ravel()


def write_file(out, documents: Iterator[tuple[int | None, bytes]], width: int, kind: str = "byte", chunk: int = CHUNK) -> list[int]:
    """Writes one shard; the number of ids of every document."""
    pack, held, at, doc_ids, sizes, index = zstandard.ZstdCompressor(LEVEL), bytearray(), len(MAGIC), [], [], []
    out.write(MAGIC)

    def emit(raw: bytes) -> None:
        nonlocal at
        planes = [pack.compress(p.tobytes()) for p in to_planes(np.frombuffer(raw, f"<u{width}"), kind)]
        index.append((at, len(raw) // width, [len(p) for p in planes], zlib.crc32(raw)))
        for p in planes:
            at += out.write(p)

    for doc, ids in documents:
        doc_ids.append(doc)
        sizes.append(len(ids) // width)
        held += ids
        full = len(held) // (chunk * width) * (chunk * width)
        for i in range(0, full, chunk * width):
            emit(bytes(held[i:i + chunk * width]))
        del held[:full]
    if held:
        emit(bytes(held))
    docs = pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
    chunks = pa.table({k: pa.array(v, t) for (k, t), v in zip((("offset", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.list_(pa.int64())), ("crc32", pa.int64())), zip(*index) if index else [[]] * 4)})
    tails = []
    for t in (docs, chunks):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        tails.append(pack.compress(sink.getvalue().to_pybytes()))
    for t in tails:
        out.write(t)
    out.write(struct.pack(TRAILER, KINDS.index(kind), width, chunk, *map(len, tails)) + MAGIC)
    return sizes


class Shard:
    """Reads ranges of documents from an open file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n = struct.calcsize(TRAILER)
        tail = source.read_at(n + len(MAGIC), size - n - len(MAGIC))
        if tail[n:] != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a whole token-id file")
        kind, self.width, self.chunk, docs, chunks = struct.unpack(TRAILER, tail[:n])
        self.kind = KINDS[kind]
        self.unpack = zstandard.ZstdDecompressor()
        at = size - n - len(MAGIC)
        table = lambda start, length: pa.ipc.open_stream(self.unpack.decompress(source.read_at(length, start))).read_all()
        docs, chunks = table(at - chunks - docs, docs), table(at - chunks, chunks)
        self.doc_ids, self.index = docs.column("doc_id").to_pylist(), chunks.to_pylist()
        self.start = np.cumsum([0, *docs.column("n_tokens").to_pylist()])

    def chunk_ids(self, k: int) -> np.ndarray:
        c = self.index[k]
        raw, at, planes = self.source.read_at(sum(c["planes"]), c["offset"]), 0, []
        for n in c["planes"]:
            planes.append(np.frombuffer(self.unpack.decompress(raw[at:at + n]), np.uint8))
            at += n
        ids = from_planes(np.array(planes), self.kind, c["n_ids"])
        if zlib.crc32(ids.tobytes()) != c["crc32"]:
            raise ValueError(f"chunk {k} does not match its checksum")
        return ids

    def ids(self, first: int, stop: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of the first id in the shard, ids) of documents `first` to `stop` - 1."""
        held, have = np.empty(0, f"<u{self.width}"), int(self.start[first]) // self.chunk
        base = have * self.chunk
        for d in range(first, stop):
            a, b = int(self.start[d]), int(self.start[d + 1])
            parts = [held] if len(held) else []
            while base + sum(map(len, parts)) < b:
                parts.append(self.chunk_ids(have))
                have += 1
            held = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else held
            yield self.doc_ids[d], a, held[a - base:b - base]
            held, base = held[b - base:], b


def write_shards(docs: DataFrame, folder: str, model: str, kind: str = "byte", end: int = END) -> DataFrame:
    """Encodes `docs` and writes the shards in order of doc_id to `folder`/ids; returns (shard, first, stop, n_ids): ranges of documents to read, also kept in `folder`/segments."""
    if kind not in KINDS:
        raise ValueError(f"planes are one of {KINDS}")
    spark, width = docs.sparkSession, id_width(model)
    n = partitions(spark)
    bounds = docs.select(order_id().alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    bounds = sorted(max(-(1 << 63), min(int(b), (1 << 63) - 1)) for b in bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, d, i) for b in batches for s, d, i in zip(*(c.to_pylist() for c in b.columns)))
        fs, root = file_system(folder)
        row = next(rows, None)
        while row is not None:
            shard = row[0]

            def own() -> Iterator[tuple[int | None, bytes]]:
                nonlocal row
                while row is not None and row[0] == shard:
                    yield row[1], row[2]
                    row = next(rows, None)
            fs.create_dir(f"{root}/ids", recursive=True)
            sizes: list[int] = []
            stored(fs, f"{root}/ids/{shard:06d}.ids", lambda out: sizes.extend(write_file(out, own(), width, kind)))
            cuts = list(blocks(sizes, SEGMENT))
            yield pa.record_batch([pa.array([shard] * len(cuts), pa.int64()), pa.array([a for a, _ in cuts], pa.int64()), pa.array([b for _, b in cuts], pa.int64()), pa.array([sum(sizes[a:b]) for a, b in cuts], pa.int64())],
                                  names=["shard", "first", "stop", "n_ids"])
    rows = encoded(docs, model, end).withColumn("shard", shard_of(order_id(), F.col("tie"), bounds))
    rows = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", order_id(), "tie", "ids").select("shard", "doc_id", "ids")
    rows.mapInArrow(run, WRITTEN).write.parquet(f"{folder}/segments")
    return spark.read.parquet(f"{folder}/segments")


def read_with(segments: DataFrame, folder: str, values: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """(doc_id, start, n_tokens, *values(ids)) of every document in the segments; `schema` is that of the values.

    Segments, not documents, are numbered in one place: there is one for each 4 million ids.
    """
    before = Window.orderBy("shard", "first").rowsBetween(Window.unboundedPreceding, -1)
    tasks = segments.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    full = f"doc_id long, start long, n_tokens long, {schema}"
    names = [c.split()[0] for c in full.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            for shard, first, stop, base in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{root}/ids/{shard:06d}.ids") as source:
                    reader, rows, size = Shard(source), [], 0
                    origin = int(reader.start[first])
                    for doc, at, ids in reader.ids(first, stop):
                        rows.append((doc, base + at - origin, len(ids), *values(ids)))
                        size += len(ids)
                        if size > 1 << 20 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], kinds)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], kinds)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(full))
    return tasks.select("shard", "first", "stop", "base").repartition(partitions(segments.sparkSession), "shard", "first").mapInArrow(run, full)


def read_ids(segments: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document."""
    return read_with(segments, folder, lambda ids: (ids.tolist(),), "ids array<bigint>")


def digest(spark: SparkSession, docs: DataFrame, folder: str, path: str, kind: str = "byte") -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files. `path` is the tokenizer's file on the driver."""
    with open(path, encoding="utf-8") as f:
        model = f.read()
    return read_with(write_shards(docs, folder, model, kind), folder, lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),), "ids_crc32 long")
