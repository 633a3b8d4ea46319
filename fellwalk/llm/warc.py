"""WARC archives: writing, normalising monolithic gzip streams, and reading by offset.

`write_archives` packs records into whole-file gzip streams, as careless tools leave them. `normalise`
inflates each stream once from front to back, rewrites every record as a gzip member of its own, and
writes a sidecar index (one JSON line a record: offset, length, id, type). `read_records` deals the
index lines out and inflates only the members they name. Streams are copied in chunks, so a record of
any length needs little memory.

Folders are URLs or paths that all executors share; files are reached through Arrow's file systems.
Each file is written under a temporary name and then moved, so a lost or repeated task leaves whole
files with equal contents.

Edge cases: a null or empty payload is an empty record body; a null id becomes a record of its own
and is read back as null; repeated rows stay apart, and among equal payloads every row with the
largest id is a response; line breaks in URLs are percent-encoded, a null URL is left out; an empty
table writes no archive and reads back empty; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fellwalk.llm.common import partitions

CHUNK = 1 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str | None) -> int | None:
    return None if name is None or name == "<urn:page:none>" else int(name[len("<urn:page:"):-1])


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 response with an HTTP head, or a revisit without a body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$%&()*+,/:;=?@[]~')}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_verdicts(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), refers_to: of equal payloads of `least` bytes or more, that with the largest page_id is kept."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    largest = rows.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("largest"))
    refers = F.when((F.col("size") >= least) & ~F.col("largest").eqNullSafe(F.col("page_id")), F.col("largest"))
    return rows.join(largest, "sha1", "left").select("page_id", "url", "sha1", refers.alias("refers_to"), F.when(refers.isNull(), F.col("html")).alias("html"), F.col("size").cast("long").alias("size"))


def _stored(fs: pafs.FileSystem, path: str, write) -> None:
    """Writes under a temporary name, then moves."""
    import uuid

    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as out:
        write(out)
    fs.move(temp, path)


def write_archives(pages: DataFrame, folder: str, least: int = 0, per_archive: int = 64 << 20) -> DataFrame:
    """Writes one gzip stream for each partition (or `per_archive` payload bytes of it); returns the list of archives, which is also kept in `folder`/archives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        fs, root = file_system(folder)
        names: list[str] = []

        def rows():
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns)):
                    yield r

        todo = rows()
        row = next(todo, None)
        fs.create_dir(f"{root}/whole", recursive=True)
        while row is not None:
            name = f"part-{part:06d}-{number:04d}.warc.gz"

            def write(out):
                nonlocal row
                packer, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                while row is not None and size < per_archive:
                    page, url, sha1, refers, html, n = row
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    body = (html or "").encode()
                    raw = record(page, url, body, digest, refers, refers is not None)
                    if refers is not None:  # the HTTP head names the full length
                        raw = raw.replace(b"Content-Length: 0\r\n\r\n", b"Content-Length: %d\r\n\r\n" % n, 1)
                        old = raw.split(b"\r\n\r\n", 1)
                        raw = old[0][:old[0].rindex(b" ")] + b" %d" % (len(old[1]) - 4) + b"\r\n\r\n" + old[1]
                    out.write(packer.compress(raw))
                    size += len(raw)
                    row = next(todo, None)
                out.write(packer.flush())
            _stored(fs, f"{root}/whole/{name}", write)
            names.append(name)
            number += 1
        yield pa.record_batch([pa.array(names, pa.string())], names=["archive"])
    rows = with_verdicts(pages, least)
    rows.mapInArrow(run, "archive string").write.mode("overwrite").parquet(f"{folder}/archives")
    return pages.sparkSession.read.parquet(f"{folder}/archives")


def inflated(source) -> Iterator[bytes]:
    """The contents of a gzip stream of one or more members, in chunks."""
    unpack, data = zlib.decompressobj(31), b""
    while data := unpack.unused_data or source.read(CHUNK):
        if unpack.eof:
            unpack = zlib.decompressobj(31)
        if got := unpack.decompress(data, CHUNK):
            yield got
        while unpack.unconsumed_tail:
            yield unpack.decompress(unpack.unconsumed_tail, CHUNK)


class Stream:
    """Reads lines and counted bytes from chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, b""

    def more(self) -> bool:
        got = next(self.chunks, None)
        self.held += got or b""
        return got is not None

    def until(self, end: bytes) -> bytes | None:
        """Bytes up to and with `end`; None at the end of the stream."""
        at = 0
        while (found := self.held.find(end, at)) < 0:
            at = max(0, len(self.held) - len(end) + 1)
            if not self.more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.held = self.held[:found + len(end)], self.held[found + len(end):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("the archive ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_members(source, out) -> list[tuple[int, int, str, str]]:
    """Copies each record of a gzip stream to a member of its own; (offset, length, id, type) of the members."""
    stream, index, at = Stream(inflated(source)), [], 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        h = headers(head.lstrip(b"\r\n"))
        packer, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        for part in (head.lstrip(b"\r\n"), *[None], b"\r\n\r\n"):
            for piece in (stream.take(int(h["content-length"])) if part is None else (part,)):
                size += out.write(packer.compress(piece))
        size += out.write(packer.flush())
        for _ in stream.take(4):  # the blank lines after the block
            pass
        index.append((at, size, h.get("warc-record-id"), h.get("warc-type")))
        at += size
    return index


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives in `folder`/whole record by record to `folder`/records, each with a sidecar `.idx`; returns the index."""
    spark = archives.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(f"{root}/records", recursive=True)
        for b in batches:
            for name in b.column(0).to_pylist():
                index: list = []
                with fs.open_input_stream(f"{root}/whole/{name}", compression=None) as source:
                    _stored(fs, f"{root}/records/{name}", lambda out: index.extend(split_members(source, out)))
                lines = "".join(json.dumps({"archive": name, "offset": o, "length": n, "record_id": i, "record_type": t}) + "\n" for o, n, i, t in index)
                _stored(fs, f"{root}/records/{name}.idx", lambda out: out.write(lines.encode()))
                yield pa.record_batch([pa.array([name])], names=["archive"])
    done = archives.repartition(partitions(spark), "archive").mapInArrow(run, "archive string")
    done.write.mode("overwrite").parquet(f"{folder}/normalised")
    if spark.read.parquet(f"{folder}/normalised").isEmpty():
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json(f"{folder}/records/*.idx")


def parsed(raw: bytes) -> tuple:
    """A record as (page_id, url, payload, payload_bytes, digest, type, refers_to)."""
    head, _, block = raw.partition(b"\r\n\r\n")
    h = headers(head)
    block = block[:int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(headers(http)["content-length"])
    kind = h["warc-type"]
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
    return page_of(h["warc-record-id"]), h.get("warc-target-uri"), payload if kind == "response" else None, n, digest, kind, page_of(h.get("warc-refers-to"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that index lines name, each read from its own member."""
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        name, source = None, None
        for b in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, fs.open_input_file(f"{root}/records/{archive}")
                raw = zlib.decompress(source.read_at(length, offset), 31)
                rows.append(parsed(raw))
                size += len(raw)
                if size > 1 << 24:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if source:
            source.close()
    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes, normalises and reads back."""
    return read_records(normalise(write_archives(pages, folder, least), folder), folder)
