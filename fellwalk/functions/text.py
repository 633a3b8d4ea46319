"""Text folding, stems, trigrams and edit distance for place names, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and their base letters, by canonical decomposition.
_PAIRS = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if "a" <= unicodedata.normalize("NFD", chr(c))[0] <= "z" and chr(c).islower()]

# Inflected forms of common place words, number words, filler words.
LEMMA_FORMS = {
    "lac": "lacul lacului lacurile lacurilor lacu lacuri", "varf": "varful varfului varfurile varfurilor varfu varfuri",
    "cabana": "cabanei cabanele cabanelor cabane", "cascada": "cascadei cascadele cascadelor cascade",
    "pestera": "pesterii pesterile pesterilor pesteri", "chei": "cheile cheilor", "vale": "valea vaii vaile vailor vai",
    "sa": "saua seii seaua sei", "munte": "muntele muntelui muntii muntilor munti", "izvor": "izvorul izvorului izvoarele izvoarelor izvoare",
    "poiana": "poienii poienile poieni", "cetate": "cetatea cetatii cetatile cetati", "manastire": "manastirea manastirii manastirile manastiri",
    "biserica": "bisericii bisericile biserici", "castel": "castelul castelului castele", "drum": "drumul drumului drumurile drumuri",
    "strada": "strazii strazile strazi", "rau": "raul raului raurile rauri", "parau": "paraul paraului paraiele", "padure": "padurea padurii padurile paduri",
    "culme": "culmea culmii", "creasta": "crestei crestele creste", "refugiu": "refugiul refugiului refugii", "parc": "parcul parcului parcurile parcuri",
    "partie": "partia partiei partiile partii", "turn": "turnul turnului", "piata": "pietei", "deal": "dealul dealului dealurile dealuri",
    "cruce": "crucea crucii", "canion": "canionul canionului canioane", "traseu": "traseul traseului traseele trasee", "pod": "podul podului",
    "baraj": "barajul barajului", "tau": "taul taului", "piatra": "pietrele pietrei", "plai": "plaiul", "colt": "coltul coltii", "pas": "pasul pasului",
}
NUMBER_WORDS = {"1": "unu", "2": "doi", "3": "trei", "4": "patru", "5": "cinci", "6": "sase", "7": "sapte", "8": "opt", "10": "zece",
                "12": "doisprezece", "una": "unu", "doua": "doi"}
LEMMA = {form: base for base, forms in LEMMA_FORMS.items() for form in forms.split()}


def literal_map(d: dict) -> Column:
    """A constant map of words without commas, as one small expression."""
    return F.map_from_arrays(F.split(F.lit(",".join(d)), ","), F.split(F.lit(",".join(map(str, d.values()))), ","))


def fold(c: Column) -> Column:
    """Lower case without accents; anything but letters and digits becomes one space."""
    low = F.translate(F.lower(c), "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS))
    low = F.regexp_replace(F.replace(low, F.lit("ß"), F.lit("ss")), "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(fold(c), " "), lambda t: t != "")


def stem(t: Column) -> Column:
    known = F.try_element_at(literal_map(LEMMA | NUMBER_WORDS), t)
    n = F.length(t)
    rule = (F.when((n <= 4) | t.rlike(r"\d"), t).when(t.endswith("ului"), F.left(t, n - 3)).when(t.endswith("ul"), F.left(t, n - 1))
            .when(t.endswith("ilor") & (n > 6), F.left(t, n - 4)).otherwise(t))
    return F.coalesce(known, rule)


def trigrams(s: Column) -> Column:
    """Distinct character trigrams of the text padded with two blanks before and one after."""
    p = F.concat(F.lit("  "), s, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total > 0, inter / total).otherwise(0.0)


def swapped(a: Column, b: Column) -> Column:
    """Whether one swap of neighbours turns a into b."""
    n = F.length(a)
    at = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(
        F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (n == F.length(b)) & (n > 1) & (a != b) & at


def edit_distance(a: Column, b: Column, limit: int = 2) -> Column:
    """Restricted Damerau distance (an adjacent swap counts once) up to a limit of two, limit + 1 when larger.

    A swap costs the built-in Levenshtein distance two, so one of two or less is lowered by a swap only, and one of
    three or four is within two only if a swap stands between parts that differ by one edit or one more swap.
    """
    if limit not in (1, 2):
        raise ValueError("limits of one and two only")
    lev, n = F.levenshtein(a, b, 2 * limit), F.length(a)
    part = lambda i, j: F.when(F.substring(a, i, F.lit(1)).eqNullSafe(F.substring(b, j + 1, F.lit(1))) & F.substring(a, i + 1, F.lit(1)).eqNullSafe(F.substring(b, j, F.lit(1))), F.when(
        F.levenshtein(F.left(a, i - 1), F.left(b, j - 1)) + F.levenshtein(F.substring(a, i + 2, n), F.substring(b, j + 2, n + 2)) <= 1, True).otherwise(
        (F.left(a, i - 1) == F.left(b, j - 1)) & swapped(F.substring(a, i + 2, n), F.substring(b, j + 2, n + 2)))).otherwise(False)
    inside = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.exists(
        F.array(i - 1, i, i + 1), lambda j: (j >= 1) & (i < n) & (j < F.length(b)) & part(i, j)))
    two = F.when(lev < 0, limit + 1).when(lev <= 1, lev).when(swapped(a, b), 1)
    if limit == 1:
        return two.otherwise(F.when(a.isNotNull() & b.isNotNull(), 2))
    return two.when(lev == 2, 2).when(inside, 2).otherwise(F.when(a.isNotNull() & b.isNotNull(), 3))


def within_one(a: Column, b: Column) -> Column:
    """Edit distance at most one: one edit or one adjacent swap."""
    lev = F.levenshtein(a, b, 2)
    return F.when((lev >= 0) & (lev <= 1), True).when(lev < 0, False).otherwise(swapped(a, b))


def token_match(q: Column, n: Column, q_stem: Column | None = None, n_stem: Column | None = None) -> Column:
    """How well a query token matches a name token: 1 exact to 0 none. The stems may be there already."""
    q_stem, n_stem = stem(q) if q_stem is None else q_stem, stem(n) if n_stem is None else n_stem
    lq, ln = F.length(q), F.length(n)
    d = edit_distance(q, n, 2)
    typo = (F.when(d == 1, 0.8).when((d == 2) & (lq >= 6), 0.6)
            .when((ln > lq) & within_one(q, F.left(n, lq)) & (q != F.left(n, lq)), 0.55).otherwise(0.0))
    return (F.when(q == n, 1.0).when(q_stem == n_stem, 0.95).when((lq >= 3) & n.startswith(q), 0.6 + 0.3 * (lq / ln))
            .when(lq >= 4, typo).otherwise(0.0))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(4294967295)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), step)
