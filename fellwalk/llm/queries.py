"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from fellwalk.llm import fingerprints, langid, negatives, packing, quality, quotes, runs, secrets, simhash, spm, suffix, tokenids, warc
from fellwalk.llm.common import table
from fellwalk.plans.scratch import scratch


def op1_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_token_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.digest(spark, table(spark, sf_dir, "documents"), scratch(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"))


def on_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_bottom_k_fingerprints": on_documents(fingerprints.digest),
    "op3_quotation_linking": lambda spark, sf_dir: quotes.conversations(table(spark, sf_dir, "conversations")),
    "op4_language_codes": on_documents(langid.digest),
    "op5_host_quality": on_documents(quality.digest),
    "op6_variable_best_fit": on_documents(packing.packed),
    "op7_piece_transducer": on_documents(spm.encoded),
    "op8_suffix_array_dedup": on_documents(suffix.digest),
    "op9_randomness_secrets": on_documents(secrets.digest),
    "op10_simhash_multi_index": on_documents(simhash.digest),
    "op11_spanning_tree_negatives": lambda spark, sf_dir: negatives.digest(table(spark, sf_dir, "embeddings")),
    "op12_token_id_planes": op12_token_id_planes,
    "op13_periodic_runs": on_documents(runs.digest),
    "pipeline": corpus_pipeline.run,
}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORD = r"[^\x20\x09-\x0D]+"
ORACLES: dict[str, str] = {
    # a digest's 40 hexadecimal digits, five at a time, are four characters in base 32
    "op1_warc_normaliser": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda k: substr('{ALPHABET}', CAST(1 + ((('0x' || substr(h, CAST(5 * (k // 4) + 1 AS INT), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31) AS INT), 1)), '') AS payload_digest,
 CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM m""",
    "op5_host_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents), w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{WORD}') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1), rep AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS i FROM c) GROUP BY r),
m AS MATERIALIZED (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w) w LEFT JOIN rep ON rep.r = w.r),
f AS (SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b FROM m),
h AS (SELECT source, count(*) AS n, [sum(a::INT), sum(b::INT), sum((10 * n_symbols > n_words)::INT), sum((10 * n_dup_lines > n_words)::INT), sum((word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT)] AS fs FROM f GROUP BY source),
u AS (SELECT source, n * 1e0 AS n, unnest(range(5)) AS rule, unnest(fs) * 1e0 AS f FROM h),
s AS (SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(f) / sum(n) AS mean, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS spread, sum(n) - sum(n * n) / sum(n) AS weight FROM u GROUP BY rule),
t AS (SELECT *, mean * (1 - mean) AS noise, CASE WHEN weight > 0 THEN (spread - (hosts - 1) * mean * (1 - mean)) / weight ELSE 0e0 END AS between_hosts FROM s),
p AS (SELECT rule, mean, CASE WHEN between_hosts <= 1e-12 OR noise <= 0 THEN docs / hosts ELSE greatest(noise / between_hosts - 1, 1e0) END AS strength FROM t),
v AS (SELECT source, bool_and((f + mean * strength) / (n + strength) <= 5e-1) AS kept FROM u JOIN p USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed, NOT (a OR b) AND v.kept AS kept FROM f JOIN v ON v.source IS NOT DISTINCT FROM f.source""",
    "op11_spanning_tree_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, list_inner_product(a.v, v.v)::BIGINT AS score FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND v.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
}
