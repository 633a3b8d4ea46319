"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blanks become U+2581, one is put in
front if the model says so), the pieces with their ids, and byte fallback for characters outside the
pieces. An input is composed with them to a lattice of pieces and the tropical shortest path through
it is the encoding.

For unigram models an arc costs minus the score of its piece. Scores of a byte-pair (BPE) model are
merge ranks, not costs: there a path is right exactly if merging each adjacent pair of its pieces
alone gives that pair again. So states hold the last piece, an arc costs 0, and infinity after a
piece with which it is no such pair; one path of finite cost is left. Byte fallback costs nothing in
BPE models and a fixed penalty in unigram ones.

No piece crosses from a word into the mark of the next, so words are encoded alone and remembered.
The model file's path is a parameter; every task reads the file once from that path (it has to be
where the executors can read it).

Edge cases: null and empty texts have no ids and decode to the empty text; any Unicode text decodes
to its normal form; a null doc_id is carried; repeated rows are encoded each; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellwalk.llm.common import text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Added cost of a character by bytes in unigram models, beyond the dearest piece.
FALLBACK = 10.0
REMEMBERED = 1 << 20


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at:at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", data[at:at + n])[0]
            at += n


class Transducer:
    """The machines of one model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.prefix, self.squeeze, self.escape, charsmap = UNIGRAM, True, True, True, b""
        for k, v in fields(data):
            if k == 1:
                f = dict(fields(v))
                self.pieces.append((f[1].decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif k == 2:
                self.kind = dict(fields(v)).get(3, UNIGRAM)
            elif k == 3:
                f = dict(fields(v))
                charsmap = f.get(2, b"")
                self.prefix, self.squeeze, self.escape = bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
        if charsmap:
            raise ValueError("models with a table of character rules are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models only")
        if any(MARK in p.rstrip(MARK).lstrip(MARK) or (p.endswith(MARK) and p.strip(MARK)) for p, _, k in self.pieces if k in (NORMAL, USER)):
            raise ValueError("a piece crosses into the next word")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.dearest = -min((s for _, s, k in self.pieces if k == NORMAL), default=0.0)
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.splits: dict[int, tuple[int, int]] = {}
        self.arcs = self.ids
        if self.kind == BPE:
            self.compile_merges()

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def merged(self, s: str) -> tuple[list[str], list[int]]:
        """Byte-pair merging of one short string, best score first, then leftmost: the parts, and the two ids of the last merge."""
        parts, last = list(s), []
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.pieces[k][1] > best):
                    best, at = self.pieces[k][1], i
            if best is None:
                return parts, last
            last = [self.ids.get(parts[at], -1), self.ids.get(parts[at + 1], -1)]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compile_merges(self) -> None:
        """Keeps the pieces that merging their own characters gives, and the last merge of each."""
        self.arcs = {}
        for p, k in self.ids.items():
            parts, last = self.merged(p)
            if parts == [p]:
                self.arcs[p] = k
                if last and -1 not in last:
                    self.splits[k] = (last[0], last[1])

    def apart(self, a: int, b: int) -> bool:
        """Whether the pieces a and b stay as they are when they stand next to each other.

        Merges are undone from the latest back, on the sides that meet: if a merge across the border
        would have come before the one that was undone last, the pair is not stable.
        """
        pieces = self.pieces
        if MARK in pieces[a][0] and MARK in pieces[b][0]:  # runs of marks have equal scores: merge them
            return self.merged(pieces[a][0] + pieces[b][0])[0] == [pieces[a][0], pieces[b][0]]
        limit, left = float("-inf"), False  # score and side of the merge undone last
        while True:
            k = self.ids.get(pieces[a][0] + pieces[b][0])
            if k is not None and (pieces[k][1] > limit or pieces[k][1] == limit and not left):
                return False
            sa = pieces[a][1] if a in self.splits else float("inf")
            sb = pieces[b][1] if b in self.splits else float("inf")
            if sa == sb == float("inf"):
                return True
            if sa < sb:
                limit, left, a = sa, True, self.splits[a][1]
            else:  # of equal merges the left one comes first, so the right one is undone first
                limit, left, b = sb, False, self.splits[b][0]

    def path(self, word: str) -> list[str]:
        """Pieces (or single unknown characters) on the shortest path through the lattice of a word."""
        n, arcs = len(word), self.arcs
        if self.kind == BPE:
            if word in arcs:
                return [word]
            pairs = self.pairs
            lengths = sorted(range(1, min(n, self.longest) + 1), key=lambda x: abs(x - 2.8))  # one fits at most; the usual ones first
            last = [-2] * (n + 1)  # the piece on the path to each place; -1: an unknown character
            back = [0] * (n + 1)
            for end in range(1, n + 1):
                for length in lengths:
                    start = end - length
                    if start < 0:
                        continue
                    k = arcs.get(word[start:end])
                    if k is None:
                        continue
                    if start:
                        before = last[start]
                        if before == -2:
                            continue
                        if before >= 0:
                            key = before << 32 | k
                            good = pairs.get(key)
                            if good is None:
                                if len(pairs) >= REMEMBERED:
                                    pairs.clear()
                                good = pairs[key] = self.apart(before, k)
                            if not good:
                                continue
                    last[end], back[end] = k, start
                    break
                else:
                    if word[end - 1] not in arcs:
                        last[end], back[end] = -1, end - 1
            out, at = [], n
            while at:
                if last[at] == -2:
                    raise ValueError(f"no path through {word!r}")
                out.append(word[back[at]:at])
                at = back[at]
            return out[::-1]
        cost, step = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                k = arcs.get(word[start:end])
                c = cost[start] + (-self.pieces[k][1] if k is not None else self.dearest + FALLBACK if end - start == 1 else float("inf"))
                if c < cost[end]:
                    cost[end], step[end] = c, start
        out, at = [], n
        while at:
            out.append(word[step[at]:at])
            at = step[at]
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        """Little-endian 32-bit ids of one word."""
        out: list[int] = []
        for p in self.path(word):
            k = self.arcs.get(p)
            if k is not None:
                out.append(k)
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        known, out = self.known, []
        for word in WORD.findall(self.normalise(text)):
            got = known.get(word)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = known[word] = self.word_ids(word)
            out.append(got)
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, marks as blanks, the blank in front dropped."""
        out = bytearray()
        for i in ids:
            p, _, kind = self.pieces[i]
            if kind == BYTE:
                out.append(int(p[3:5], 16))
            elif kind == UNKNOWN:
                out += " ⁇ ".encode()
            elif kind != CONTROL:
                out += p.encode()
        text = out.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


#: A run of marks and the word after it; a text without a mark in front starts with a word.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@lru_cache(4)
def load(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip: whether decoding gives the (normalised) text again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            doc, texts = b.column(0), text_bytes(b)
            for lo in range(0, len(texts), 512):
                ids, good = [], []
                for raw in texts[lo:lo + 512]:
                    text = raw.decode("utf-8", "replace")
                    ids.append(t.encode(text))
                    back = decode_ids(t, ids[-1])
                    normal = t.normalise(text).replace(MARK, " ")
                    good.append(back == (normal[1:] if t.prefix and normal else normal))
                n = [len(x) for x in ids]
                column = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                yield pa.record_batch([doc[lo:lo + 512], pa.array(n, pa.int32()), column, pa.array(good)], names=["doc_id", "n_tokens", "ids", "round_trip"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, round_trip boolean")


def decode_ids(t: Transducer, ids: np.ndarray) -> str:
    """decode() by a table of the pieces' bytes."""
    if not hasattr(t, "raw"):
        t.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode() for p, _, k in t.pieces]
    text = b"".join([t.raw[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if t.prefix and text.startswith(" ") else text


def decoded(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows(doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([t.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
