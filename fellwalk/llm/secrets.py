"""Secret scan: three fixed patterns, and a battery of randomness tests on encoded tokens.

Base kinds, leftmost and non-overlapping: `assign`, `access`, `hex`. The method adds `random`: tokens of
20 characters and more whose encoding can be inferred (hex, base32, base36, base64) and that pass for
uniformly random. An equals sign ends a name or pads a token, so the value of NAME=value is a token of
its own; runs of letters, digits, `+` and `/`, runs with `_` and `-`, and the parts between these marks are
all tested, and of nested tokens that are reported the longest stands. Each token is tested for uniform use of its alphabet (chi-squared with the exact
variance), for runs above and below the middle of the alphabet, and for serial correlation; the
smallest of the three p-values, times three, is its p-value. Among all tokens of one encoding and
length band (a doubling of length) the Benjamini-Hochberg procedure rejects randomness at a false
discovery rate of 5 %, so long and short tokens are controlled apart; what is not rejected is
reported, unless a base span holds it. P-values are rounded up to eighths of a power of two, so a band
is ranked from a small histogram and no task sorts all tokens.

Only DataFrame functions are used. Spans count code points, end exclusive.

Edge cases: null and empty texts have no spans; repeated rows have equal results; a null doc_id is
carried as it is; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fellwalk.llm.common import set_apart
from fellwalk.operators.fixpoint import cut

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs of the characters of both base64 alphabets, and the parts between their marks; = is padding only.
TOKENS = tuple(rf"(?<![{c}])[{c}]{{20,}}={{0,2}}" for c in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE = 8
FDR = 0.05
DIGITS, UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding: its pattern, and its alphabet in the order that the tests use.
ENCODINGS = {
    "hex": ("^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "base32": ("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    "base36": ("^(?=.*[0-9])(?=.*[a-zA-Z])([0-9a-z]+|[0-9A-Z]+)$", DIGITS + UPPER.lower()),
    "base64": ("^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)$", UPPER + UPPER.lower() + DIGITS + "+/"),
}
BINS, BANDS = 400, 16


def quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else 'r"' + pattern.replace('"', r"\x22") + '"'


def located(pattern: str, group: int = 0) -> str:
    """SQL: array of (start, stop, value) of the matches in `_t`; value is the group."""
    p = quoted(pattern)
    item = "array<struct<start:int,stop:int,value:string>>"
    return f"""CASE WHEN _t RLIKE {p} THEN element_at(transform(
        array(named_struct('p', split(_t, {p}, -1), 'm', regexp_extract_all(_t, {p}, 0), 'v', regexp_extract_all(_t, {p}, {group}))),
        x -> aggregate(sequence(0, size(x.m) - 1), named_struct('at', 0, 'out', CAST(array() AS {item})),
            (a, i) -> named_struct('at', a.at + length(x.p[i]) + length(x.m[i]),
                'out', concat(a.out, array(named_struct('start', a.at + length(x.p[i]), 'stop', a.at + length(x.p[i]) + length(x.m[i]), 'value', x.v[i])))),
            a -> a.out)), 1) ELSE CAST(array() AS {item}) END"""


def encoding(token: str) -> str:
    cases = " ".join(f"WHEN {token} RLIKE {quoted(p)} THEN '{k}'" for k, (p, _) in ENCODINGS.items())
    return f"CASE {cases} END"


def tail(z: str) -> str:
    """SQL: two-sided tail of the normal distribution (Abramowitz and Stegun 7.1.26)."""
    x = f"(abs({z}) / sqrt(2D))"
    t = f"(1 / (1 + 0.3275911D * {x}))"
    return f"least(1D, greatest(1e-14D, {t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))) * exp(-{x} * {x})))"


def tested(token: str, kind: str) -> str:
    """SQL: the p-value of a token (trailing = cut) under the uniform distribution over its alphabet."""
    alphabet = "CASE k.e " + " ".join(f"WHEN '{n}' THEN '{a}'" for n, (_, a) in ENCODINGS.items()) + " END"
    chars = "CASE WHEN k.e = 'base64' THEN translate(k.s, '_-', '/+') WHEN k.e = 'base32' THEN k.s ELSE lower(k.s) END"
    values = f"transform(sequence(1, length(k.s)), i -> CAST(instr(k.a, substr(k.c, i, 1)) - 1 AS double))"
    square = "aggregate(array_distinct(w.v), 0D, (q, y) -> q + pow(size(filter(w.v, z -> z = y)), 2))"
    above = "transform(w.v, y -> CAST(2 * y > w.m - 1 AS int))"
    runs = "1 + aggregate(sequence(1, size(u.b) - 1), 0, (r, i) -> r + CAST(u.b[i] <> u.b[i - 1] AS int))"
    serial = "aggregate(sequence(1, size(w.v) - 1), 0D, (r, i) -> r + (w.v[i] - (w.m - 1) / 2) * (w.v[i - 1] - (w.m - 1) / 2))"
    chi = f"((u.sq * w.m / w.n - w.n) - (w.m - 1)) / sqrt(2 * (w.m - 1) * (w.n - 1) / w.n)"
    one = "CAST(aggregate(u.b, 0, (r, y) -> r + y) AS double)"
    mean = "(2 * g.o * (w.n - g.o) / w.n + 1)"
    wald = f"CASE WHEN g.o = 0 OR g.o = w.n THEN 9D ELSE ({runs} - {mean}) / sqrt(greatest(1e-9D, ({mean} - 1) * ({mean} - 2) / (w.n - 1))) END"
    corr = f"({serial}) / ((w.m * w.m - 1) / 12) / sqrt(w.n - 1)"
    let = lambda name, fields, body: f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"
    return let("j", f"'s', rtrim('=', {token}), 'e', {kind}",
               let("k", f"'s', j.s, 'e', j.e, 'a', {alphabet.replace('k.e', 'j.e')}, 'c', {chars.replace('k.', 'j.')}",
                   let("w", f"'v', {values}, 'm', CAST(length(k.a) AS double), 'n', CAST(length(k.s) AS double)",
                       let("u", f"'sq', {square}, 'b', {above}",
                           let("g", f"'o', {one}",
                               f"least(1D, 3 * least({tail(chi)}, {tail(wald)}, {tail(corr)}))")))))


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, and `_base` (start, kind as its number, stop) and `_tokens` (start, stop, stratum, bin) of each text."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    found = rows.select(*[F.col(f"`{c}`") for c in keep], F.expr(f"filter({located(ASSIGN, 1)}, x -> length(x.value) >= {MIN_VALUE})").alias("_a"),
                        F.expr(located(ACCESS)).alias("_k"), F.expr(located(HEX)).alias("_h"), F.expr(f"array_distinct(concat({', '.join(map(located, TOKENS))}))").alias("_r"))
    span = lambda col, k: f"transform({col}, x -> named_struct('start', x.start, 'kind', {k}, 'stop', x.stop))"
    token = "named_struct('start', x.start, 'stop', x.start + length(rtrim('=', x.value)), 'value', x.value, 'e', {})".format(encoding("rtrim('=', x.value)"))
    known = f"filter(transform(_r, x -> {token}), x -> x.e IS NOT NULL AND x.stop - x.start >= 20)"
    stratum = f"concat(x.e, '/', CAST(least({BANDS - 1}, floor(log2(x.stop - x.start))) AS string))"
    binned = f"CAST(least({BINS}, floor(-8 * log2({tested('x.value', 'x.e')}))) AS int)"
    return found.select(*[F.col(f"`{c}`") for c in keep],
                        F.expr(f"sort_array(concat({span('_a', 0)}, {span('_k', 1)}, {span('_h', 2)}))").alias("_base"),
                        F.expr(f"transform({known}, x -> named_struct('start', x.start, 'stop', x.stop, 'stratum', {stratum}, 'bin', {binned}))").alias("_tokens"))


def cut_offs(found: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """For each stratum the smallest bin that is rejected as not random; one that rejects nothing is left out.

    At most 4 encodings x 16 bands x 401 bins are counted, whatever the input.
    """
    bins = found.select(F.explode("_tokens").alias("x")).groupBy("x.stratum", "x.bin").agg(F.count("*").alias("n"))
    ranked = bins.selectExpr("stratum", "bin", "sum(n) OVER (PARTITION BY stratum ORDER BY bin DESC) AS k", "sum(n) OVER (PARTITION BY stratum) AS total")
    low = ranked.where(f"pow(2D, -bin / 8) <= {fdr} * k / total").groupBy("stratum").agg(F.min("bin").alias("bin"))
    return {r["stratum"]: r["bin"] for r in low.collect()}


def all_spans(limits: dict[str, int]) -> Column:
    """`_base` and the random tokens that no base span holds, sorted."""
    limit = "map(" + ", ".join(f"'{k}', {v}" for k, v in sorted(limits.items())) + ")" if limits else "CAST(map() AS map<string, int>)"
    random = f"filter(_tokens, x -> x.bin < coalesce(element_at({limit}, x.stratum), {BINS + 1}) AND NOT exists(_base, y -> y.start <= x.start AND y.stop >= x.stop))"
    longest = f"element_at(transform(array({random}), r -> filter(r, x -> NOT exists(r, y -> y.start <= x.start AND y.stop >= x.stop AND y.stop - y.start > x.stop - x.start))), 1)"
    return F.expr(f"sort_array(concat(_base, transform({longest}, x -> named_struct('start', x.start, 'kind', 3, 'stop', x.stop))))")


def written(col: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({col}, x -> concat({names}[x.kind], ':', x.start, ':', x.stop)), ',')")


def digest(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = cut(scanned(docs, ["doc_id"]))
    limits = cut_offs(found, fdr)
    counts = [F.expr(f"CAST(size(filter(_base, x -> x.kind = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.withColumn("_all", all_spans(limits)).select("doc_id", *counts, F.sha2(written("_base"), 256).alias("base_sha256"), written("_all").alias("spans"))


@set_apart("text")
def redacted(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `docs` with each stretch of secrets in `text` replaced by `mark`."""
    limits = cut_offs(scanned(docs, []), fdr)
    rows = scanned(docs, docs.columns).withColumn("_all", all_spans(limits))
    text = f"""CASE WHEN size(_all) = 0 THEN text ELSE aggregate(_all, named_struct('at', 0, 'out', ''),
        (a, x) -> named_struct('at', greatest(a.at, x.stop), 'out', CASE WHEN x.start < a.at OR (x.start = a.at AND a.at > 0) THEN a.out
            ELSE concat(a.out, substr(text, a.at + 1, x.start - a.at), '{mark}') END),
        a -> concat(a.out, substr(text, a.at + 1))) END"""
    return rows.select(*[F.expr(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
