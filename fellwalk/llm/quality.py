"""Quality rules per document, and verdicts per host.

Each document is measured once. Per host (the `source` column) the failures of each rule are counted
and the failure rate is shrunk towards the mean of all hosts with a beta prior fitted to the hosts by
moments, so that a host of few documents is not judged by chance. A host is rejected if the shrunk
rate of some rule is above the limit; then all of its documents go, otherwise those that pass the
base rules stay.

Edge cases: null and blank texts have no words and fail; a null source is a host of its own; repeated
rows count each; an empty table gives an empty result; other columns, also ones named like a measure,
do not matter (measures are kept apart until the end).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fellwalk.llm.common import BLANKS, set_apart, text_bytes
from fellwalk.operators.fixpoint import cut
from fellwalk.plans.scratch import scratch

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A host goes if the shrunk failure rate of one rule is above this.
HOST_LIMIT = 0.5
#: Parts of a host's documents in the join with rejected hosts.
SALTS = 32
#: Rules that count per host; the first two are the base rules.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a `width`-word window found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    own = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(ids) == len(words):
        return 0
    key = own[:n]
    for j in range(1, width):
        key = np.unique(key * len(ids) + own[j:n + j], return_inverse=True)[1] if len(ids) ** (j + 1) >= 1 << 62 else key * len(ids) + own[j:n + j]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(found), 1)
    np.add.at(cover, np.flatnonzero(found) + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    solid = text.translate(None, BLANKS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, b"#*$%&|<>")),
            len(lines) - len(set(lines)), repeat_words(words))


def with_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` as they are, and a struct `_m` of the measures."""
    if "_m" in keep:
        raise ValueError("the column name _m is taken")
    cols = list(dict.fromkeys([*keep, "text"]))
    schema = docs.select(keep).schema.add("_m", StructType([StructField(m, LongType()) for m in MEASURES]))
    kind = pa.struct([pa.field(m, pa.int64()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t) for t in text_bytes(b)], np.int64).reshape(-1, len(MEASURES))
            m = pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(len(MEASURES))], fields=list(kind))
            yield pa.record_batch([*(b.column(i) for i in range(len(keep))), m], names=[*keep, "_m"])
    return docs.select(keep if "text" in keep else cols).mapInArrow(run, schema)


def failed(rule: str) -> Column:
    return F.expr(RULES[rule])


def host_verdicts(measured: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, a failure count and a shrunk rate for each rule, host_kept) from rows with `_m` and the host.

    The beta prior of a rule has the mean of all documents and the strength that fits the variance of
    the rates between hosts; without such variance the strength is the number of documents per host.
    """
    counts = measured.select(F.col(host).alias("host"), "_m.*").groupBy("host").agg(
        F.count("*").alias("n_docs"), *[F.sum(failed(r).cast("long")).alias(f"f_{r}") for r in RULES])
    counts = cut(counts)
    prior = counts.agg(F.count("*").alias("hosts"), F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_docs")).cast("double").alias("squares"),
                       *[F.sum(f"f_{r}").alias(f"s_{r}") for r in RULES],
                       *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in RULES]).first()
    out = counts
    for r in RULES:
        mean, strength = beta_prior(prior["hosts"], prior["docs"], prior["squares"], prior[f"s_{r}"], prior[f"q_{r}"])
        out = out.withColumn(f"rate_{r}", (F.col(f"f_{r}") + mean * strength) / (F.col("n_docs") + strength))
    return out.withColumn("host_kept", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) <= limit)


def beta_prior(hosts: int, docs: int | None, squares: float | None, failures: int | None, scaled: float | None) -> tuple[float, float]:
    """(mean, strength): method of moments for rates of hosts of unlike sizes.

    `squares` is the sum of squared host sizes, `scaled` the sum of failures^2 / size. The between-host
    variance is the weighted variance of the rates less its binomial part.
    """
    if not docs:
        return 0.0, 1.0
    mean = failures / docs
    spread = scaled - docs * mean * mean
    noise = mean * (1 - mean)
    weight = docs - squares / docs
    between = (spread - (hosts - 1) * noise) / weight if weight > 0 else 0.0
    if between <= 1e-12 or noise <= 0:
        return mean, docs / hosts
    return mean, max(noise / between - 1, 1.0)


def judged(docs: DataFrame, keep: list[str], host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """`keep`, `_m`, `_base_failed` and `_kept` for every row."""
    cols = list(dict.fromkeys([*keep, host]))
    rows = with_measures(docs, cols)
    if "text" not in cols:  # small rows are kept; texts are measured twice instead of written
        rows = cut(rows)
    skinny = with_measures(docs, [host]) if "text" in cols else rows.select(host, "_m")
    bad = host_verdicts(skinny, host, limit).where("NOT host_kept").select(F.col("host").alias("_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    # written, so that Spark knows its size: few rejected hosts are broadcast, many meet salted rows
    folder = scratch(docs.sparkSession, "hosts")
    bad.write.parquet(folder)
    bad = docs.sparkSession.read.parquet(folder)
    base = F.expr(" OR ".join(f"({RULES[r]})" for r in ("few_words", "repeats")).replace("n_", "_m.n_"))
    salted = rows.withColumn("_s", F.monotonically_increasing_id() % SALTS)
    return (salted.join(bad.withColumn("_bad", F.lit(True)), F.col(host).eqNullSafe(F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
            .select(*[F.col(f"`{c}`") for c in keep], "_m", base.alias("_base_failed"), (~base & F.col("_bad").isNull()).alias("_kept")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed, kept."""
    return judged(docs, ["doc_id"]).select("doc_id", "_m.*", F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


@set_apart("doc_id", "text", "source")
def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep."""
    return judged(docs, docs.columns).where("_kept").select(docs.columns)
