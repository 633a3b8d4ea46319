"""Periodic runs of words by the dictionary of basic factors.

A run is a longest stretch of consecutive words in which words a period apart are identical, at least
`powers` periods long. The dictionary names the stretches of 1, 2, 4, ... words (basic factors): equal
stretches of a document share a name, and a name of 2L words is the pair of two names of L words. For
each length the occurrences of a factor are listed by place; successors no farther apart than twice the
length, three of them at equal distances, form an arithmetic progression and propose their distance as a
period. A proposal is extended both ways while words a period apart agree, and proposals inside a
stretch already extended are dropped.

No run is missed: a run of period q and four or more periods holds three occurrences, q apart, of its
first factor of q to 2q - 1 words, and none in between, or the run would have a smaller period (periods
of one stretch of words that are not longer than half of it divide each other). For the same reason a
proposed distance is the smallest period of the run that it is extended to.

Factors that occur fewer than three times are left out of the next length, so ordinary text costs a few
sorts. Documents are read in blocks of about 64k words, which bounds memory; words of different
documents never get the same name, so no factor crosses documents. A longer text is a block of its own.

Edge cases: null and blank texts have no words and no runs; a null doc_id is kept; repeated rows are
each answered; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellwalk.llm.common import blocks, text_bytes

LEAST, POWERS = 6, 4
BLOCK = 1 << 19  # bytes of text, about 64k words
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def by_name(first: np.ndarray, second: np.ndarray | None, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, place) ordered by name and place; the name stands for the pair. Names found fewer than three times are left out."""
    if second is None:
        second = np.zeros(1, np.int64)
    bits = [int(x.max()).bit_length() for x in (first, second, place)]
    if sum(bits) <= 63:
        keys = np.sort((first << (bits[1] + bits[2])) | (second << bits[2]) | place)
        place = keys & ((1 << bits[2]) - 1)
        change = (keys[1:] >> bits[2]) != (keys[:-1] >> bits[2])
    else:
        order = np.lexsort((place, np.broadcast_to(second, first.shape), first))
        first, second, place = first[order], np.broadcast_to(second, first.shape)[order], place[order]
        change = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    edge = np.flatnonzero(np.r_[True, change, True])
    often = np.diff(edge) >= 3
    sizes = np.diff(edge)[often]
    return np.repeat(np.arange(len(sizes)), sizes), place[np.repeat(often, np.diff(edge))]


def proposals(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period), ordered by period and place, of the arithmetic progressions of all basic factors; of neighbouring places the first."""
    found = []
    at = np.full(len(words), -1, np.int64)
    name, place, length = words, np.arange(len(words)), 1
    second = None
    while len(place) >= 3:
        name, place = by_name(name, second, place)
        if not len(place):
            break
        gap = np.diff(place)
        gap[name[1:] != name[:-1]] = -1
        hit = np.flatnonzero((gap[1:] == gap[:-1]) & (gap[1:] > 0) & (gap[1:] <= 2 * length))
        if len(hit):
            p, i = gap[hit], place[hit]
            order = np.lexsort((i, p))
            p, i = p[order], i[order]
            first = np.r_[True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)]
            found.append((p[first], i[first]))
        at[:] = -1
        at[place] = name
        here = np.flatnonzero(at[:-length] >= 0) if length < len(at) else np.empty(0, np.int64)
        here = here[at[here + length] >= 0]
        name, second, place, length = at[here], at[here + length], here, 2 * length
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, i = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((i, p))
    return i[order], p[order]


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        end = min(n, done + step)
        differ = np.flatnonzero(a[done:end] != b[done:end])
        if len(differ):
            return done + int(differ[0])
        done, step = end, step * 2
    return n


def periodic_runs(words: np.ndarray, least: int = LEAST, powers: int = POWERS) -> np.ndarray:
    """(start, length, period) rows, by start and period, of all runs in an array of word numbers; `powers` of four or more."""
    if powers < 4:
        raise ValueError("the factors find every run of four or more periods only")
    out, period, done = [], 0, 0
    if len(words) >= 4:
        for i, p in zip(*(x.tolist() for x in proposals(words))):
            if p == period and i < done:
                continue
            left = agree(words[:i][::-1], words[p:i + p][::-1])
            right = agree(words[i:-p], words[i + p:])
            period, done = p, i + right
            if left + right + p >= max(least, powers * p):
                out.append((i - left, left + right + p, p))
    return np.array(sorted(out, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def find_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row.

    `runs` holds (start, length, period) by start and period; `collapsed` is the text, its words joined by one
    space, without the words that a run repeats (all after its first period). `edit` may change a document's
    words before.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch)
            ids = batch.column(0).to_pylist()
            for lo, hi in blocks([len(t) for t in texts], BLOCK):
                words = [t.split() for t in texts[lo:hi]]
                if edit:
                    words = [edit(i, w) for i, w in zip(ids[lo:hi], words)]
                start = np.cumsum([0, *map(len, words)])
                number = np.empty(start[-1], np.int64)
                new = count()
                for w, a in zip(words, start.tolist()):
                    number[a:a + len(w)] = list(map(defaultdict(new.__next__).__getitem__, w))
                found = periodic_runs(number, least, powers)
                doc = np.searchsorted(start, found[:, 0], "right") - 1
                gone = np.zeros(len(number) + 1, np.int64)
                np.add.at(gone, found[:, 0] + found[:, 2], 1)
                np.add.at(gone, found[:, 0] + found[:, 1], -1)
                stays = np.cumsum(gone) == 0
                for d in np.unique(doc).tolist():
                    words[d] = list(compress(words[d], stays[start[d]:start[d + 1]].tolist()))
                ends = np.searchsorted(doc, np.arange(len(words) + 1))
                rows = found - np.c_[start[doc], np.zeros((len(doc), 2), np.int64)]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.record_batch([pa.array(ids[lo:hi], pa.int64()), pa.array(np.diff(start)), runs, pa.array([b" ".join(w) for w in words], pa.binary())],
                                      names=["doc_id", "n_words", "runs", "collapsed"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary").withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the checksum of its id, made periodic from some word on; a null id never."""
    n = len(words)
    h = 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digest(docs: DataFrame) -> DataFrame:
    """The runs of every whole text, some texts made periodic before."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = find_runs(docs, planted).withColumn("best", F.get(longest, F.lit(0)))
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
                       F.expr("(-best.l * 1000) div best.period").alias("exponent_milli"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
