"""Bottom-k sketches of shingle hashes.

A sketch is the sorted array of the `k` smallest distinct 64-bit hashes of a text's word shingles. It
estimates resemblance (Jaccard), containment and the number of distinct shingles; the sketch of a
text in parts is the k smallest of the parts' sketches. While a text has k shingles or fewer the
figures are exact. Only DataFrame functions are used.

Edge cases: null and blank texts have an empty sketch, which resembles an empty one fully and others
not at all; fewer than five words are one shingle; equal texts have equal sketches; rows with equal
doc_id count as one position in the order of ids (each gets the next id's text, of several the
smallest text); a null doc_id is never a next document and is followed by the first; an empty table
gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fellwalk.llm.common import LAST_ID, order_id, partitions
from fellwalk.operators.fixpoint import cut

K = 128
WIDTH = 5
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sorted `k` smallest hashes of the word shingles of a text, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")
    hashes = let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(
        F.size(w) < width, F.array(F.xxhash64(w))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(width)]))))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(sketches: Column, k: int = K) -> Column:
    """The sketch of the union of an array of sketches."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(sketches))), 1, k)


def merged_by(parts: DataFrame, key: list[str], col: str = "sketch", k: int = K, salts: int = 32) -> DataFrame:
    """One sketch for each key from any number of parts, in two steps, so that a hot key is not gathered in one task."""
    first = parts.withColumn("_salt", F.pmod(F.xxhash64(col), F.lit(salts))).select(*key, "_salt", F.explode(col).alias("h")).distinct()
    w = Window.partitionBy(*key, "_salt").orderBy("h")
    low = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return low.groupBy(*key).agg(F.slice(F.sort_array(F.collect_set("h")), 1, k).alias(col))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; else from where the k-th smallest hash lies among all 64-bit values."""
    place = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard: the share of the union's sketch that both have."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        let(both, lambda u: F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has: resemblance x union / a, 1 at most."""
    j = resemblance(a, b, k)
    n = distinct_shingles(F.slice(F.sort_array(F.array_union(a, b)), 1, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * n / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) of each distinct id, in ascending order; the last is followed by the first.

    Ids are dealt out by range; each range finds its own successors, and the first id of each range,
    one row a range, serves the last of the range before.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    dealt = cut(ids.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()))
    heads = dealt.groupBy("part").agg(F.min("doc_id").alias("head"))
    every = Window.orderBy("part")  # one row a range
    after = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every.rowsBetween(Window.unboundedPreceding, 0))).alias("after"))
    own = Window.partitionBy("part").orderBy("doc_id")
    return dealt.withColumn("next_id", F.lead("doc_id").over(own)).join(after, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text, edited, next_sketch: the last quarter of each text is replaced by the start of the next document's.

    What a document needs of the next one, the start of the text and the sketch, is made where the next
    one's text is and sent to the id before it, so whole texts are shuffled once.
    """
    # ids are never null here, so that both joins want the same exchange of the texts
    rows = docs.select(order_id().alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = cut(next_ids(docs))
    first = order.agg(F.min("doc_id").alias("first")).first()["first"]
    need = rows.groupBy("doc_id").agg(F.max(F.expr("length(text) div 4")).alias("need"))
    after = F.coalesce("next_id", F.lit(LAST_ID if first is None else first).cast("long"))
    wanted = need.join(order, "doc_id", "left").select(F.col("doc_id").alias("prev"), after.alias("doc_id"), "need")
    sent = rows.join(wanted, "doc_id").select("prev", F.struct(F.xxhash64("text").alias("h"), F.expr("left(text, need)").alias("start"), sketch(F.col("text"), k).alias("sketch")).alias("s"))
    sent = sent.groupBy("prev").agg(F.min("s").alias("s"))
    n = "length(text) div 4"
    return rows.join(sent, rows["doc_id"] == sent["prev"], "left").select(
        F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text", F.expr(f"concat(left(text, length(text) - {n}), left(coalesce(s.start, ''), {n}))").alias("edited"),
        F.coalesce(F.col("s.sketch"), F.array().cast("array<bigint>")).alias("next_sketch"))


def digest(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, k).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                                     sketch(F.col("text"), k).alias("a"), sketch(F.col("edited"), k).alias("b"), F.col("next_sketch").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return rows.select("doc_id", "n_chars", "edited_sha256", written(a).alias("fingerprint"), written(b).alias("edited_fingerprint"),
                       resemblance(a, b, k).alias("near_edited"), resemblance(a, c, k).alias("near_next"))
