"""Typo-tolerant place search over whole query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions import text as X
from fellwalk.functions.geo import planar_km, round_half_up
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.matching import match_table

# Categories in order, cue words, stop / near / me words.
CATS = ["city", "town", "village", "district", "peak", "saddle", "ridge", "lake", "river", "waterfall", "spring", "cave", "gorge", "valley", "forest", "meadow",
        "hut", "camp", "lodging", "viewpoint", "attraction", "castle", "monument", "church", "park", "ski", "food", "station", "parking", "shop", "health", "sport",
        "trail", "path", "street", "other"]
CUES = {
    "city": ["oras", "orasul", "municipiu", "city", "town centre", "centru", "centrul"],
    "town": ["oras", "town", "statiune"],
    "village": ["sat", "satul", "comuna", "village", "localitate", "villages"],
    "district": ["cartier", "cartierul", "district", "neighbourhood", "neighborhood", "zona"],
    "peak": ["varf", "varful", "vf", "peak", "summit", "pisc", "munte", "mount", "top", "deal", "peaks", "mountains"],
    "saddle": ["sa", "saua", "pas", "pasul", "pass", "col", "trecatoare"],
    "ridge": ["creasta", "ridge", "culme", "culmea", "abrupt", "perete", "stanca", "colt", "cliff", "rock"],
    "lake": ["lac", "lacul", "lake", "tau", "iezer", "balta", "baraj", "reservoir", "tarn", "pond", "lakes"],
    "river": ["rau", "raul", "parau", "paraul", "river", "stream", "creek", "rivers"],
    "waterfall": ["cascada", "waterfall", "falls", "cascade", "saritoare", "waterfalls"],
    "spring": ["izvor", "izvorul", "spring", "fantana", "apa", "water", "cismea", "springs"],
    "cave": ["pestera", "cave", "aven", "grota", "cavern", "caves"],
    "gorge": ["chei", "cheile", "canion", "canionul", "gorge", "canyon", "defileu", "gorges", "canyons"],
    "valley": ["vale", "valea", "valley"],
    "forest": ["padure", "padurea", "forest", "woods", "codru"],
    "meadow": ["poiana", "meadow", "pajiste", "livada"],
    "hut": ["cabana", "refugiu", "refugiul", "hut", "shelter", "adapost", "stana", "cottage", "huts", "refuges", "chalets"],
    "camp": ["camping", "campare", "camp", "campsite", "cort", "tent", "campsites"],
    "lodging": ["hotel", "pensiune", "pensiunea", "hostel", "motel", "vila", "cazare", "accommodation", "sleep", "dormit", "hotels", "guesthouses"],
    "viewpoint": ["belvedere", "viewpoint", "view", "panorama", "priveliste", "lookout", "viewpoints"],
    "attraction": ["muzeu", "museum", "zoo", "atractie", "attraction", "obiectiv", "turistic"],
    "castle": ["castel", "castelul", "cetate", "cetatea", "citadel", "fortress", "castle", "bastion", "turn", "fortareata", "fort", "castles", "fortresses"],
    "monument": ["monument", "ruine", "ruina", "memorial", "statuie", "ruins"],
    "church": ["biserica", "manastire", "schit", "catedrala", "church", "monastery", "cathedral", "templu", "churches", "monasteries"],
    "park": ["parc", "parcul", "park", "rezervatie", "reserve", "gradina", "garden", "national park", "parks"],
    "ski": ["partie", "ski", "schi", "telecabina", "telegondola", "telescaun", "teleschi", "gondola", "cable car", "slope", "slopes"],
    "food": ["restaurant", "cafenea", "cafe", "pizza", "mancare", "food", "bar", "pub", "terasa", "eat", "coffee", "restaurants", "cafes"],
    "station": ["gara", "station", "autogara", "statie", "train", "tren", "bus"],
    "parking": ["parcare", "parking", "car park"],
    "shop": ["magazin", "supermarket", "mall", "shop", "store", "market"],
    "health": ["spital", "farmacie", "hospital", "pharmacy", "salvamont", "clinica", "urgenta"],
    "sport": ["stadion", "piscina", "bazin", "pool", "patinoar", "sala", "stadium", "swim", "inot", "climbing", "catarare"],
    "trail": ["traseu", "traseul", "trail", "poteca", "marcaj", "hike", "hiking", "drumetie", "route", "banda", "cruce", "punct", "triunghi", "trails", "hikes"],
    "path": ["poteca", "drum", "drumul", "path", "track", "forestier", "trail"],
    "street": ["strada", "str", "bulevard", "bulevardul", "bd", "calea", "aleea", "soseaua", "piata", "street", "avenue", "road"],
}
STOP = "de la din cu si al a ale lui pe the of to and in at on for unde e este where is how get go show find me my vreau merg catre spre".split()
NEAR = "langa aproape near around by la in din from linga zona spre".split()
ME = "mine me nearby aici here apropiere aproape".split()
NOT_GENERIC = "centru top apa zona turistic national bus train".split()
GENERIC_EXTRA = "de la din lui si cu mare mic mica vf sf nr".split()
PLACE_BONUS = {"city": 3.0, "town": 2.5, "village": 1.2, "district": 1.5, "park": 1.5, "ridge": 1.0, "peak": 1.0, "lake": 1.0, "street": -3.0}
SETTLEMENTS = ["city", "town", "village", "district"]
HOME = (25.5887, 45.6427)
HOME_COUNTY = "Brașov"
#: Parts of a posting list.
SALTS = 16


def _py_stem(t: str) -> str:
    if t in X.NUMBER_WORDS:
        return X.NUMBER_WORDS[t]
    if t in X.LEMMA:
        return X.LEMMA[t]
    if len(t) <= 4 or any(c.isdigit() for c in t):
        return t
    for end, cut in (("ului", 3), ("ul", 1)):
        if t.endswith(end):
            return t[:-cut]
    return t[:-4] if t.endswith("ilor") and len(t) > 6 else t


# Cues of one word vote for a category; every word of a cue is too common to name a place.
CUE_CATS: dict[str, list[int]] = {}
for _cat, _cues in CUES.items():
    for _cue_word in _cues:
        if " " not in _cue_word and CATS.index(_cat) not in CUE_CATS.setdefault(_py_stem(_cue_word), []):
            CUE_CATS[_py_stem(_cue_word)].append(CATS.index(_cat))
GENERIC = sorted(({_py_stem(w) for cues in CUES.values() for c in cues for w in c.split()} | set(GENERIC_EXTRA)) - set(NOT_GENERIC))


def is_generic(stem: Column) -> Column:
    return stem.isin(*GENERIC)


def _cue(stem: Column) -> Column:
    return F.transform(F.split(F.try_element_at(X.literal_map({k: " ".join(map(str, v)) for k, v in CUE_CATS.items()}), stem), " "), lambda c: c.cast("int"))


def rule_parse(queries: DataFrame, text: str = "query") -> DataFrame:
    """tokens, roles, cats (37 shares, last one "any") by cue, near, me and stop words, then the word lists per role.

    The only state from left to right is "a near word was seen"; its first position decides it.
    """
    q = queries.withColumn("tokens", X.tokens(F.col(text)))
    nxt = lambda i: F.get("tokens", i + 1)
    me = lambda t: t.isin(*ME)
    near = lambda t, i: t.isin(*NEAR) & nxt(i).isNotNull() & ~F.coalesce(me(nxt(i)), F.lit(False)) & (i > 0) & ~me(t)
    first = F.array_position(F.transform("tokens", lambda t, i: F.coalesce(near(t, i), F.lit(False))), True)
    q = q.withColumn("_near", F.when(first > 0, first - 1).otherwise(F.lit(1 << 20)).cast("int"))

    def role(t, i):
        after = i > F.col("_near")
        return (F.when(me(t) & (after | (i > 0)), "me").when(F.coalesce(near(t, i), F.lit(False)), "near")
                .when(t.isin(*NEAR) & F.coalesce(me(nxt(i)), F.lit(False)), "near").when(after, "anchor").when(_cue(X.stem(t)).isNotNull(), "cue")
                .when(t.isin(*STOP), "fill").otherwise("name"))

    q = q.withColumn("roles", F.transform("tokens", role)).drop("_near")
    cues = F.filter(F.transform("tokens", lambda t, i: F.when(F.get("roles", i) == "cue", _cue(X.stem(t)))), lambda c: c.isNotNull())
    q = q.withColumn("_c", cues)
    vote = lambda c: F.aggregate("_c", F.lit(0.0), lambda acc, a: acc + F.when(F.array_contains(a, c), 1.0 / F.size(a)).otherwise(0.0))
    n = F.size("_c")
    cats = F.transform(F.sequence(F.lit(0), F.lit(36)), lambda c: F.when(n > 0, vote(c) / n).otherwise(F.when(c == 36, 1.0).otherwise(0.0)))
    # later filters on the word lists must not be pushed through the nested token expressions
    return assemble(cut(q.withColumn("cats", cats).drop("_c")))


def assemble(parsed: DataFrame) -> DataFrame:
    """name, cue and anchor words and near_me from tokens and roles; a lone anchor becomes the name."""
    pick = lambda r: F.filter("tokens", lambda t, i: F.get("roles", i) == r)
    p = parsed.withColumns({"name": pick("name"), "cue": pick("cue"), "anchor": pick("anchor"), "near_me": F.array_contains("roles", "me")})
    lone = (F.size("name") == 0) & (F.size("cue") == 0) & (F.size("anchor") > 0)
    return p.withColumns({"name": F.when(lone, F.col("anchor")).otherwise(F.col("name")), "anchor": F.when(lone, F.array().cast("array<string>")).otherwise(F.col("anchor"))})


def content_words(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("content", F.filter("tokens", lambda t, i: F.get("roles", i).isin("name", "cue", "anchor")))


def top_cats(parsed: DataFrame) -> DataFrame:
    idx = F.filter(F.sequence(F.lit(0), F.lit(35)), lambda c: F.get("cats", c) >= 0.12)
    return parsed.withColumn("top_cats", idx)


def reconcile_parse(model: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Model reading corrected by the rules: key, tokens, roles, cats and word lists."""
    r = rules.select(key, F.col("roles").alias("r_roles"), F.col("cats").alias("r_cats"))
    m = model.select(key, "tokens", "roles", "cats").join(r, key)
    stems = F.transform("tokens", X.stem)
    # an anchor without a near word that is a category word is a cue
    no_near = ~F.array_contains("roles", "near")
    m = m.withColumn("_s", stems).withColumn("roles", F.transform("roles", lambda x, i: F.when(no_near & (x == "anchor") & _cue(F.get("_s", i)).isNotNull(), "cue").otherwise(x)))
    empty = ~F.exists("roles", lambda x: x.isin("name", "cue", "anchor")) & (F.size("tokens") > 0)
    m = m.withColumns({"_e": empty}).withColumns({"roles": F.when(F.col("_e"), F.col("r_roles")).otherwise(F.col("roles")), "cats": F.when(F.col("_e"), F.col("r_cats")).otherwise(F.col("cats"))})

    def votes(role):
        cs = F.filter(F.transform("_s", lambda s, i: F.when(F.get("roles", i) == role, _cue(s))), lambda c: c.isNotNull())
        one = lambda c: F.aggregate(cs, F.lit(0.0), lambda acc, a: acc + F.when(F.array_contains(a, c), 1.0).otherwise(0.0))
        v = F.transform(F.sequence(F.lit(0), F.lit(36)), one)
        return v, F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    v, tot = votes("cue")
    mixed = F.zip_with("cats", v, lambda c, x: 0.3 * c + 0.7 * x / F.nullif(tot, F.lit(0.0)))
    m = m.withColumn("cats", F.when(~F.col("_e") & (tot > 0), mixed).otherwise(F.col("cats")))
    a = assemble(m)
    browse = ~F.col("_e") & (F.size("name") > 0) & ((F.size("anchor") > 0) | F.col("near_me")) & F.forall("name", lambda t: _cue(X.stem(t)).isNotNull())
    v2, tot2 = votes("name")
    a = a.withColumn("_b", browse).withColumn("cats", F.when(F.col("_b"), F.transform(v2, lambda x: x / tot2)).otherwise(F.col("cats")))
    a = a.withColumn("roles", F.when(F.col("_b"), F.transform("roles", lambda x: F.when(x == "name", "cue").otherwise(x))).otherwise(F.col("roles")))
    return assemble(a.select(key, "tokens", "roles", "cats"))


# ---------------------------------------------------------------- index

def build_search_index(entries: DataFrame) -> dict[str, DataFrame]:
    """entries(id, name, alt array, cat int, lng, lat, imp) -> names, entry_names (nm: the names of an entry in order), postings, vocab (df)."""
    all_names = F.concat(F.array("name"), F.coalesce("alt", F.array().cast("array<string>")))
    n = entries.select("id", "cat", F.posexplode(all_names).alias("idx", "nm")).withColumn("tokens", X.tokens(F.col("nm")))
    n = cut(n.where(F.size("tokens") > 0).withColumn("stems", F.transform("tokens", X.stem)).select("id", "cat", "idx", "tokens", "stems"))
    settlement = F.get(F.array(*[F.lit(c) for c in CATS]), F.col("cat")).isin(*SETTLEMENTS)
    silent = (F.col("idx") == 0) & ~settlement & F.forall("stems", is_generic)
    post = n.where(~silent).select("id", F.explode("stems").alias("token")).distinct()
    vocab = post.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    own = n.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "stems", "tokens"))).alias("nm"))
    return {"names": n, "entry_names": own, "postings": post, "vocab": vocab}


def idf(n_entries: Column, df: Column) -> Column:
    return F.log(1 + n_entries / (1 + F.coalesce(df, F.lit(0))))


def expand_tokens(words: DataFrame, index: dict[str, DataFrame], table: DataFrame | None = None) -> DataFrame:
    """(word, typing, token, match) for distinct words(word, typing): exact and stem, prefix, and typo matches.

    A typo match shares two trigrams and 35 % of the word's with a token at most three letters longer or shorter.
    `table` may hold the words' `match_table`.
    """
    w = words.select("word", "typing").distinct()
    table = match_table(w, index["vocab"]) if table is None else table
    word, token = F.col("word"), F.col("token")
    exact = token.isin(word) | (token == X.stem(word))
    prefix = token.startswith(word) & (F.length(word) >= 2) & (F.col("typing") | (F.length(word) >= 3))
    grams = X.trigrams(word)
    shared = F.size(F.array_intersect(grams, X.trigrams(token)))
    typo = (F.length(word) >= 4) & (F.length(token) >= 4) & (F.abs(F.length(token) - F.length(word)) <= 3) & (shared >= F.greatest(F.lit(2), F.size(grams) * 0.35))
    pairs = table.join(index["vocab"].select("token"), "token", "left_semi").join(w, "word")
    kind = F.when(exact, 2).when(prefix, 1).when(typo, 1).otherwise(0)
    return pairs.withColumn("_k", kind).where("_k > 0").select("word", "typing", "token", F.when(F.col("_k") == 2, 1.0).otherwise(F.col("m")).alias("match"))


def entry_classes(index: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(id, class): entries of the same names and postings, by the smallest id among them; entries that no word reaches are left out."""
    own = index["postings"].groupBy("id").agg(F.sort_array(F.collect_list("token")).alias("ts"))
    rows = index["entry_names"].join(entries.select("id"), "id", "left_semi").join(own, "id")
    return rows.join(rows.groupBy("nm", "ts").agg(F.min("id").alias("class")), ["nm", "ts"]).select("id", "class")


def distinct_lists(words: DataFrame) -> DataFrame:
    """(query_id, list, lid): word lists of queries, equal ones by the smallest (query_id, list) among them."""
    ws = words.groupBy("query_id", "list").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "typing"))).alias("ws"))
    return ws.join(ws.groupBy("ws").agg(F.min(F.struct("query_id", "list")).alias("lid")), "ws").select("query_id", "list", "lid")


def reach_classes(words: DataFrame, lists: DataFrame, classes: DataFrame, expanded: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(lid, class, retrieval): what distinct lists of words reach, by summed match x max(1, idf), once per class of entries."""
    total = entries.agg(F.count(F.lit(1))).scalar()
    w = words.join(lists.where((F.col("lid.query_id") == F.col("query_id")) & (F.col("lid.list") == F.col("list"))), ["query_id", "list"])
    weight = w.withColumn("token", X.stem(F.col("word"))).join(index["vocab"], "token", "left").withColumn("w", F.greatest(F.lit(1.0), idf(total, F.col("df")))).select("lid", "pos", "word", "typing", "w")
    # a word of very many classes has a long posting list: its rows are dealt by a salt of the class
    salt = F.pmod(F.xxhash64("class"), F.lit(SALTS))
    postings = index["postings"].join(classes.select(F.col("class").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "class").withColumn("salt", salt)
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    ex = expanded.withColumn("salt", every)
    # classes per distinct word first, so repeated words of a query log share the posting join
    per_word = ex.join(postings, ["token", "salt"]).groupBy("word", "typing", "class", "salt").agg(F.max("match").alias("m"))
    return weight.withColumn("salt", every).join(per_word, ["word", "typing", "salt"]).groupBy("lid", "class").agg(F.round(F.sum(F.col("m") * F.col("w")), 9).alias("retrieval"))


def reach(words: DataFrame, expanded: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(query_id, list, id, retrieval): all entries that the words of a query's list reach. words(query_id, list, pos, word, typing)."""
    lists, classes = cut(distinct_lists(words)), cut(entry_classes(index, entries))
    hits = reach_classes(words, lists, classes, expanded, index, entries)
    return hits.join(lists, "lid").join(classes, "class").select("query_id", "list", "id", "retrieval")


def _query_words(qwords: DataFrame, typing_last: bool) -> DataFrame:
    return qwords.select("query_id", F.lit("all").alias("list"), "pos", "word", (F.col("last") if typing_last else F.lit(False)).alias("typing"))


def retrieve(qwords: DataFrame, index: dict[str, DataFrame], entries: DataFrame, typing_last: bool = True) -> DataFrame:
    """All entries that a query's words reach, by summed match x max(1, idf). qwords(query_id, pos, word, last) -> query_id, id, retrieval."""
    qw = _query_words(qwords, typing_last)
    return reach(qw, expand_tokens(qw.select("word", "typing"), index), index, entries).drop("list")


def retrieve_totals(qwords: DataFrame, index: dict[str, DataFrame], entries: DataFrame, typing_last: bool = True) -> DataFrame:
    """(query_id, hits, best): how many entries `retrieve` gives for a query and its best retrieval, without listing the pairs."""
    qw = cut(_query_words(qwords, typing_last))
    lists, classes = cut(distinct_lists(qw)), cut(entry_classes(index, entries))
    hits = reach_classes(qw, lists, classes, expand_tokens(qw.select("word", "typing"), index), index, entries)
    size = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    per = hits.join(size, "class").groupBy("lid").agg(F.sum("n").alias("hits"), F.max("retrieval").alias("best"))
    return lists.join(per, "lid").select("query_id", "hits", "best")


def _buckets_around(points: DataFrame, keys: list[str], km: float) -> DataFrame:
    """keys, bx, by: the square of 0.1 degree buckets around each point."""
    r = int(-(-km // 8))
    o = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(-r, r + 1) for y in range(-r, r + 1)])
    p = points.select(*keys, F.floor(F.col("lng") * 10).alias("bx"), F.floor(F.col("lat") * 10).alias("by"), F.explode(o).alias("o"))
    return p.select(*keys, (F.col("bx") + F.col("o.x")).alias("bx"), (F.col("by") + F.col("o.y")).alias("by"))


def _bucketed(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.floor(F.col("lng") * 10).alias("bx"), F.floor(F.col("lat") * 10).alias("by"))


def near(points: DataFrame, key: str, entries: DataFrame, km: float) -> DataFrame:
    """Entries in the square of 0.1 degree buckets around each point (no distance filter)."""
    return _buckets_around(points, [key], km).join(_bucketed(entries, "id"), ["bx", "by"]).select(key, "id")


def near_counts(points: DataFrame, key: str, entries: DataFrame, km: float) -> DataFrame:
    """(key, found): how many rows `near` gives for a key, from the entries of each bucket, without listing the pairs."""
    n = _bucketed(entries).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    own = _bucketed(points, key).groupBy(key, "bx", "by").agg(F.count(F.lit(1)).alias("times"))
    at = own.select(F.struct("bx", "by").alias("at"), ((F.col("bx") + 0.5) / 10).alias("lng"), ((F.col("by") + 0.5) / 10).alias("lat")).distinct()
    found = _buckets_around(at, ["at"], km).join(n, ["bx", "by"]).groupBy("at").agg(F.sum("n").alias("n"))
    return own.join(found.select("at.bx", "at.by", "n"), ["bx", "by"]).groupBy(key).agg(F.sum(F.col("n") * F.col("times")).alias("found"))


def browse(points: DataFrame, key: str, entries: DataFrame, cats: list[int], km: float = 25.0, limit: int = 20) -> DataFrame:
    """Best places of the categories around each point."""
    e = entries.where(F.col("cat").isin(*cats))
    c = near(points, key, e, km).join(e, "id").join(points.select(key, F.col("lng").alias("_x"), F.col("lat").alias("_y")), key)
    c = c.withColumn("score", F.round(F.col("imp") / 25 - F.log10(1 + planar_km("_x", "_y", "lng", "lat")) * 2, 9))
    w = W.partitionBy(key).orderBy(F.desc("score"), "id")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(key, "id", "score", "rank")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_match(word: Column, token: Column) -> Column:
    """The match of a query word, which carries its own map of tokens, and a name token."""
    return F.coalesce(F.try_element_at(word["m"], token), F.lit(0.0))


def coverage(words: Column, names: Column) -> Column:
    """Best share of query words matched >= 0.8 over an entry's names."""
    hit = lambda n: lambda w: F.exists(n["stems"], lambda t: word_match(w, t) >= 0.8)
    return F.array_max(F.transform(names, lambda n: F.size(F.filter(words, hit(n))) / F.size(words)))


#: The word lists of a parsed query that retrieval and features read.
LISTS = ("match", "content", "anchor")


def list_words(parsed: DataFrame) -> DataFrame:
    """(query_id, list, pos, word, typing): the words of every list; the last one of `match` and `content` may be unfinished."""
    lists = F.array(*[F.struct(F.lit(k).alias("list"), F.col(k).alias("words")) for k in LISTS])
    rows = parsed.select("query_id", "typing", F.explode(lists).alias("l")).select("query_id", "typing", "l.list", F.size("l.words").alias("_n"), F.posexplode("l.words").alias("pos", "word"))
    return rows.select("query_id", "list", "pos", "word", (F.col("typing") & (F.col("list") != "anchor") & (F.col("pos") == F.col("_n") - 1)).alias("typing"))


def with_word_maps(parsed: DataFrame, words: DataFrame, table: DataFrame, index: dict[str, DataFrame], total: int) -> DataFrame:
    """`parsed` with m_match, m_content and m_anchor: arrays of (word, last, idf, m), m mapping the tokens that match the word."""
    maps = table.groupBy("word").agg(F.collect_list(F.struct("token", "m")).alias("pairs"))
    rows = words.withColumn("token", X.stem(F.col("word"))).join(index["vocab"], "token", "left").join(maps, "word", "left")
    rows = rows.select("query_id", "list", F.struct("pos", "word", F.col("typing").alias("last"), idf(total, F.col("df")).alias("idf"), F.coalesce("pairs", F.array().cast("array<struct<token:string,m:double>>")).alias("pairs")).alias("w"))
    made = F.transform(F.array_sort(F.collect_list("w")), lambda w: F.struct(w["word"].alias("word"), w["last"].alias("last"), w["idf"].alias("idf"), F.map_from_entries(w["pairs"]).alias("m")))
    rows = rows.groupBy("query_id", "list").agg(made.alias("ws"))
    wide = rows.groupBy("query_id").agg(*[F.max_by("ws", F.when(F.col("list") == k, 1)).alias(f"m_{k}") for k in LISTS])
    none = F.array().cast("array<struct<word:string,last:boolean,idf:double,m:map<string,double>>>")
    return parsed.join(wide, "query_id", "left").withColumns({f"m_{k}": F.coalesce(f"m_{k}", none) for k in LISTS})


def _place_bonus() -> Column:
    cat = F.get(F.array(*[F.lit(c) for c in CATS]), F.col("cat"))
    bonus = F.lit(0.0)
    for c, b in PLACE_BONUS.items():
        bonus = F.when(cat == c, b).otherwise(bonus)
    return bonus


def _full_cover() -> Column:
    return F.when(coverage(F.col("m_anchor"), F.col("nm")) >= 0.99, 3).otherwise(0)


def _anchor_score() -> Column:
    return F.col("retrieval") + F.col("full") + F.col("bonus") + F.col("imp") / 20 - 0.6 * F.log10(1 + planar_km("focus_lng", "focus_lat", "lng", "lat"))


def _best_anchor(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.max(F.struct(F.round(_anchor_score(), 9).alias("s"), "id")).alias("b")).select("query_id", F.col("b.id").alias("anchor_id"))


def anchor_candidates(parsed: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(query_id, focus_lng, focus_lat, id, lng, lat, imp, bonus, retrieval, full): the entries that can be a query's anchor.

    Only the distance depends on the query's focus. What it takes off is bounded by the extent of foci and entries, so
    of a list's entries only those that come within this bound of its best one without distances remain.
    """
    parsed = parsed.withColumns({"match": F.array().cast("array<string>"), "content": F.array().cast("array<string>"), "typing": F.lit(False)})
    words = cut(list_words(parsed))
    table = cut(match_table(words, index["names"].select(F.explode("stems").alias("token"))))
    lists, classes = cut(distinct_lists(words)), cut(entry_classes(index, entries))
    hits = reach_classes(words, lists, classes, expand_tokens(words.select("word", "typing"), index, table), index, entries)
    first = parsed.join(lists.select(F.col("lid.query_id").alias("query_id")).distinct(), "query_id", "left_semi")
    maps = with_word_maps(first, words.join(first.select("query_id"), "query_id", "left_semi"), table, index, entries.agg(F.count(F.lit(1))).scalar())
    hits = (hits.join(maps.select(F.col("query_id").alias("_q"), "m_anchor"), F.col("lid.query_id") == F.col("_q"))
            .join(index["entry_names"].withColumnRenamed("id", "class"), "class").select("lid", "class", "retrieval", _full_cover().alias("full")))
    places = entries.join(classes, "id").select("class", "id", "lng", "lat", "imp", _place_bonus().alias("bonus")).withColumn("still", F.col("bonus") + F.col("imp") / 20)
    top = places.where("lng is not null and lat is not null").groupBy("class").agg(F.max("still").alias("top"))
    hits = cut(hits.join(top, "class", "left").withColumn("top", F.col("retrieval") + F.col("full") + F.col("top")))
    box = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    f, e = box(parsed, "focus_lng", "focus_lat"), box(entries, "lng", "lat")
    # no two places are farther apart than a degree of 120 km for each degree of either axis
    far = F.lit(float("inf")) if None in (*f, *e) else 0.6 * F.log10(F.lit(1 + 120 * sum(max(f[i + 1] - e[i], e[i + 1] - f[i], 0) for i in (0, 2)))) + 1e-6
    least = hits.groupBy("lid").agg((F.max("top") - far).alias("least"))
    kept = hits.join(least, "lid").where(F.coalesce(F.col("top") >= F.col("least"), F.lit(True)))
    kept = kept.join(places, "class").where(F.coalesce(F.col("retrieval") + F.col("full") + F.col("still") >= F.col("least"), F.lit(True)))
    return kept.join(lists, "lid").join(parsed.select("query_id", "focus_lng", "focus_lat"), "query_id")


def resolve_anchor(parsed: DataFrame, index: dict[str, DataFrame], entries: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(query_id, anchor_id) of the place named by the anchor words. parsed has focus_lng, focus_lat; hits(query_id, id, retrieval) and m_anchor may be there already."""
    if hits is None:
        return _best_anchor(anchor_candidates(parsed, index, entries))
    rows = hits.select("query_id", "id", "retrieval").join(entries, "id").join(index["entry_names"], "id").join(parsed.select("query_id", "focus_lng", "focus_lat", "m_anchor"), "query_id")
    return _best_anchor(rows.withColumns({"full": _full_cover(), "bonus": _place_bonus()}))


def prepared(parsed: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed queries with word maps, the entries that each list of words reaches (query_id, list, id, retrieval), and the words' match table."""
    words = cut(list_words(parsed))
    table = cut(match_table(words, index["names"].select(F.explode("stems").alias("token"))))
    total = entries.agg(F.count(F.lit(1))).scalar()
    p = cut(with_word_maps(parsed, words, table, index, total))
    expanded = expand_tokens(words.select("word", "typing"), index, table)
    # `content` is looked up only where it says more than `match`
    more = words.join(parsed.where(F.size("content") > F.size("match")).select("query_id", F.lit("content").alias("list")), ["query_id", "list"], "left_semi")
    return p, cut(reach(words.where("list <> 'content'").unionByName(more), expanded, index, entries)), table


def place_columns(entries: DataFrame) -> DataFrame:
    """Entries with a county and an extent (x0, y0, x1, y1), null where the table has none."""
    more = {"county": F.lit(None).cast("string"), "bbox": F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")}
    return entries.withColumns({k: v for k, v in more.items() if k not in entries.columns})


def candidates(parsed: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate entries per query (query_id, id, retrieval), the parsed queries with anchor columns and word maps, and the words' match table.

    parsed(query_id, query, tokens, roles, cats, name, cue, anchor, near_me, focus_lng, focus_lat).
    """
    entries = place_columns(entries)
    p = top_cats(content_words(parsed)).withColumns({"typing": ~F.col("query").rlike(r"\s$"), "match": F.when(F.size("name") > 0, F.col("name")).otherwise(F.col("cue"))})
    p, lists, table = prepared(p, index, entries)
    a = resolve_anchor(p, index, entries, lists.where("list = 'anchor'")).join(entries.select(
        F.col("id").alias("anchor_id"), F.col("lng").alias("a_lng"), F.col("lat").alias("a_lat"), F.col("cat").alias("a_cat"), F.col("bbox").alias("a_bbox")), "anchor_id")
    p = cut(p.join(a, "query_id", "left"))
    wants = ((F.size("name") == 0) & (F.size("cue") > 0)) | ((F.col("anchor_id").isNotNull() | F.col("near_me")) & (F.size("top_cats") > 0))
    b = p.where(wants).select("query_id", F.coalesce("a_lng", "focus_lng").alias("lng"), F.coalesce("a_lat", "focus_lat").alias("lat"), "top_cats", F.col("a_cat").isin(CATS.index("city"), CATS.index("park")).alias("wide"))
    found = near(b.where("wide"), "query_id", entries, 30).unionByName(near(b.where(~F.coalesce("wide", F.lit(False))), "query_id", entries, 20))
    found = found.join(b.select("query_id", "top_cats"), "query_id").join(entries.select("id", "cat"), "id").where(F.array_contains("top_cats", F.col("cat"))).select("query_id", "id", F.lit(0.0).alias("retrieval"))
    # a name hit outranks the safety net, which outranks browsing, whatever their scores
    hits, net = lists.where("list = 'match'"), lists.where("list = 'content'").withColumn("retrieval", F.col("retrieval") * 0.8)
    allc = hits.drop("list").withColumn("src", F.lit(3)).unionByName(net.drop("list").withColumn("src", F.lit(2))).unionByName(found.withColumn("src", F.lit(1)))
    c = allc.groupBy("query_id", "id").agg(F.max(F.struct("src", "retrieval")).alias("b")).select("query_id", "id", F.col("b.retrieval").alias("retrieval"))
    c = c.join(p.select("query_id", "anchor_id", "name", "cue", "top_cats", "m_content"), "query_id").join(entries.select("id", "cat"), "id").join(index["entry_names"], "id")
    c = c.where(~(F.coalesce(F.col("anchor_id") == F.col("id"), F.lit(False)) & (F.size("name") == 0)))
    strict = (F.size("name") == 0) & (F.size("cue") > 0) & (F.size("top_cats") > 0) & ~F.array_contains("top_cats", F.col("cat"))
    return c.where(F.when(strict, coverage(F.col("m_content"), F.col("nm")) >= 0.99).otherwise(True)).select("query_id", "id", "retrieval"), p, table


FEATURES = ["name_cover", "name_cover_plain", "entity_cover", "exact_name", "exact_full", "prefix_name", "min_match", "alt_only", "cue_in_name", "cat_prob", "cat_any",
            "cat_prob_cue", "importance", "has_anchor", "d_anchor", "in_anchor", "d_focus", "near_me_dist", "home", "home_focus", "extra_tokens", "name_len", "typing_flag",
            "all_cover", "all_exact", "surface_exact"]


def name_fit(words: Column, name: Column) -> Column:
    """How query words fit one name: (cover, ent, ni, plain, low, stems), ordered so that the greatest fits best."""
    def best(w):
        def one(t, k):
            m = word_match(w, t)
            return F.struct(F.when(w["last"] & t.startswith(w["word"]), F.greatest(m, F.lit(0.9))).otherwise(m).alias("m"), (-k).alias("nj"), t.alias("stem"))
        return F.struct(F.array_max(F.transform(name["stems"], one)).alias("b"), w["idf"].alias("idf"))

    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda x, y: x + f(y))

    def fit(b):
        used = F.transform(F.filter(b, lambda x: x["b"]["m"] > 0), lambda x: x["b"]["stem"])
        own = F.filter(name["stems"], lambda t: ~is_generic(t))
        ent = F.when(F.size(own) > 0, F.size(F.filter(own, lambda t: F.array_contains(used, t))) / F.size(own)).otherwise((F.size(used) > 0).cast("double"))
        cover = F.coalesce(total(b, lambda x: x["b"]["m"] * x["idf"]) / F.nullif(total(b, lambda x: x["idf"]), F.lit(0.0)), F.lit(0.0))
        return F.struct(F.round(cover, 9).alias("cover"), ent.alias("ent"), (-name["idx"]).alias("ni"), (total(b, lambda x: x["b"]["m"]) / F.size(b)).alias("plain"),
                        F.array_min(F.transform(b, lambda x: x["b"]["m"])).alias("low"), name["stems"].alias("stems"))
    return let(F.transform(words, best), fit)


def place_features(f: DataFrame) -> dict[str, Column]:
    """The features that need no names: category, importance and distances, for rows with the columns of query and entry."""
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    zero, lg = F.lit(0.0), lambda d: F.log10(1 + d) / 3
    d_a, d_f = planar_km("lng", "lat", "a_lng", "a_lat"), planar_km("lng", "lat", "focus_lng", "focus_lat")
    inside = (F.col("lng") >= F.col("a_bbox.x0")) & (F.col("lng") <= F.col("a_bbox.x1")) & (F.col("lat") >= F.col("a_bbox.y0")) & (F.col("lat") <= F.col("a_bbox.y1"))
    home = F.coalesce(F.col("county") == HOME_COUNTY, F.lit(False)) | (planar_km("lng", "lat", F.lit(HOME[0]), F.lit(HOME[1])) < 35)
    home_focus = planar_km("focus_lng", "focus_lat", F.lit(HOME[0]), F.lit(HOME[1])) < 50
    prob = F.coalesce(F.get("cats", F.col("cat")), zero)
    return {
        "cat_prob": prob, "cat_any": F.get("cats", F.lit(36)), "cat_prob_cue": F.when(F.size("cue") > 0, prob).otherwise(0.0), "importance": F.col("imp") / 100,
        "has_anchor": flag(F.col("anchor_id").isNotNull()), "d_anchor": F.coalesce(lg(d_a), zero), "in_anchor": flag(F.when(F.col("a_bbox").isNotNull(), inside).otherwise(d_a < 5)),
        "d_focus": lg(d_f), "near_me_dist": F.when(F.col("near_me"), lg(d_f)).otherwise(0.0), "home": flag(home), "home_focus": flag(home & home_focus)}


def score_bounds(cands: DataFrame, parsed: DataFrame, table: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """(query_id, id, bound): an upper bound of each candidate's hand-set score, without its names.

    Every word counts with its best match anywhere in the entry, so what a single name gives is at most that; exact
    and prefix features are possible only if all words, or all but the last, match fully. Place features are exact.
    """
    tokens = index["names"].select("id", F.explode("stems").alias("token")).distinct()
    best = table.join(tokens, "token").groupBy("word", "id").agg(F.max("m").alias("m"))
    rows = parsed.select("query_id", F.explode(F.array(*[F.struct(F.lit(k).alias("list"), F.col(f"m_{k}").alias("ws")) for k in LISTS[:2]])).alias("l"))
    rows = rows.select("query_id", "l.list", F.size("l.ws").alias("n"), F.posexplode("l.ws").alias("pos", "w")).select("query_id", "list", "n", "pos", "w.word", "w.last", "w.idf")
    m = F.when(F.col("last"), F.greatest("m", F.lit(0.9))).otherwise(F.col("m"))
    own = lambda c: F.when(F.col("list") == "match", c)
    full = F.col("m") >= 0.95
    sums = rows.join(best, "word").groupBy("query_id", "id").agg(
        F.coalesce(F.sum(own(m * F.col("idf"))), F.lit(0.0)).alias("cover"), F.coalesce(F.sum(own(m)), F.lit(0.0)).alias("plain"), F.count(own(F.col("m"))).alias("hits"), F.min(own(m)).alias("low"),
        F.count(own(F.when(full, 1))).alias("fit"), F.count(own(F.when(full & (F.col("pos") < F.col("n") - 1), 1))).alias("head"),
        F.count(F.when((F.col("list") == "content") & (F.col("m") >= 0.8), 1)).alias("well"))
    e = place_columns(entries).select("id", "cat", "lng", "lat", "imp", "county")
    need = ["query_id", "cats", "cue", "anchor_id", "a_lng", "a_lat", "a_bbox", "focus_lng", "focus_lat", "near_me"]
    total = F.aggregate("m_match", F.lit(0.0), lambda a, w: a + w["idf"])
    # an unfinished word of two letters may begin any token, and a stem with a stem of its own equal one, without a full match in the table
    loose = F.exists("m_match", lambda w: (w["last"] & (F.length(w["word"]) < 3)) | (X.stem(X.stem(w["word"])) != X.stem(w["word"])))
    q = parsed.select(*need, F.size("m_match").alias("nm"), F.size("m_content").alias("nc"), total.alias("idfs"), loose.alias("loose"))
    f = cands.select("query_id", "id").join(q, "query_id").join(e, "id").join(sums, ["query_id", "id"], "left").na.fill(0, ["cover", "plain", "hits", "low", "fit", "head", "well"])
    nm, all_hit = F.col("nm"), F.col("hits") == F.col("nm")
    plain = F.when(nm > 0, F.col("plain") / nm).otherwise(0.0)
    cover = F.when(F.col("nc") > nm, F.col("well") / F.col("nc")).otherwise(plain)
    names = {"name_cover": F.when(nm > 0, F.col("cover") / F.col("idfs")).otherwise(0.0), "all_cover": cover, "all_exact": (cover >= 0.98).cast("double"), "surface_exact": F.lit(1.0), "entity_cover": (F.col("hits") > 0).cast("double"),
             "exact_name": (F.col("fit") == nm).cast("double"), "exact_full": (F.col("fit") == nm).cast("double"), "prefix_name": (F.col("head") >= nm - 1).cast("double"), "min_match": F.when(all_hit, F.col("low")).otherwise(0.0),
             "cue_in_name": (F.size("cue") > 0).cast("double")}
    bound = F.lit(0.0)
    for k, v in names.items():
        bound = bound + HEURISTIC[k] * F.when(F.col("loose"), 1.0).otherwise(v)
    for k, v in place_features(f).items():
        bound = bound + HEURISTIC.get(k, 0) * v
    return f.select("query_id", "id", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))


def ranking_features(cands: DataFrame, parsed: DataFrame, index: dict[str, DataFrame], entries: DataFrame) -> DataFrame:
    """The 26 named features per (query, entry); the 36 category one-hots follow from `cat`.

    One row per candidate carries the words of the query with their matches and the names of the entry, so no row
    is made for a pair of a word and a name.
    """
    e = place_columns(entries).select("id", "cat", "lng", "lat", "imp", "county")
    f = cands.select("query_id", "id").join(parsed, "query_id").join(e, "id").join(index["entry_names"], "id")
    f = f.withColumn("t", F.when(F.size("m_match") > 0, F.array_max(F.transform("nm", lambda n: name_fit(F.col("m_match"), n)))))
    zero = F.lit(0.0)
    first = F.get("nm", F.lit(0))["stems"]
    core0 = F.filter(first, lambda t: ~is_generic(t))
    f = f.withColumns({"first": first, "core0": core0})
    core = F.when(F.size("core0") > 0, F.col("core0")).otherwise(F.col("first"))
    join = lambda a: F.array_join(a, " ")
    more = F.size("content") > F.size("match")
    hits = lambda own: F.size(F.filter("m_match", lambda w: F.exists(own, lambda t: word_match(w, t) > 0)))
    main = F.get("nm", F.lit(0))["idx"] == 0  # the first name may have no words
    f = f.withColumns({
        "core": core, "full": F.coalesce("t.stems", "first"), "q_stem": join(F.transform("match", X.stem)), "q_full": join(F.transform(F.concat("cue", "name"), X.stem)),
        "cues": F.transform("cue", X.stem), "surface": F.flatten(F.transform("nm", lambda n: n["tokens"])), "plain": F.coalesce("t.plain", zero),
        "extra_hits": F.when(main, F.when(F.size("core0") > 0, hits(F.col("core0"))).otherwise(hits(F.col("first")))).otherwise(0)})
    f = f.withColumns({"s_core": join("core"), "s_full": join("full"), "all_c": F.when(more, F.when(F.size("m_content") > 0, coverage(F.col("m_content"), F.col("nm"))).otherwise(0.0)).otherwise(F.col("plain"))})
    flag = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    cue_in = F.exists("cues", lambda c: F.exists("first", lambda t: (t == c) | ((F.length(c) >= 4) & X.within_one(c, t))))
    has_match = F.size("match") > 0
    place = place_features(f)
    said = (F.col("q_stem") != "")
    cols = {
        "name_cover": F.coalesce("t.cover", zero), "name_cover_plain": F.col("plain"), "entity_cover": F.coalesce("t.ent", zero),
        "exact_name": flag(said & ((F.col("q_stem") == F.col("s_core")) | (F.col("q_stem") == F.col("s_full")))), "exact_full": flag((F.col("q_full") != "") & (F.col("q_full") == F.col("s_full"))),
        "prefix_name": flag(said & (F.col("s_core").startswith(F.col("q_stem")) | F.col("s_full").startswith(F.col("q_stem")))), "min_match": F.coalesce("t.low", zero),
        "alt_only": flag(F.col("t.ni") < 0), "cue_in_name": flag(cue_in), **place,
        "extra_tokens": F.least(F.lit(1.0), F.greatest(F.lit(0), F.size("core") - F.col("extra_hits")) / 4), "name_len": F.least(F.lit(1.0), F.size("first") / 6),
        "typing_flag": flag(F.col("typing") & has_match & ~F.array_contains("full", X.stem(F.element_at("match", F.when(has_match, -1))))),
        "all_cover": F.col("all_c"), "all_exact": flag((F.col("all_c") >= 0.99) & F.exists("nm", lambda n: F.size(n["stems"]) == F.size("content"))),
        "surface_exact": F.when(F.size("content") > 0, F.size(F.filter("content", lambda w: F.array_contains("surface", w))) / F.size("content")).otherwise(0.0)}
    return f.select("query_id", "id", "cat", *[c.cast("double").alias(n) for n, c in cols.items()])


HEURISTIC = {"all_cover": 3, "all_exact": 2, "surface_exact": 1, "name_cover": 4, "entity_cover": 1.5, "exact_name": 2, "exact_full": 1, "prefix_name": 0.8, "min_match": 1,
             "alt_only": -0.3, "cue_in_name": 0.8, "cat_prob": 2, "importance": 1.6, "d_anchor": -2.2, "in_anchor": 0.6, "d_focus": -0.9, "near_me_dist": -1.5, "home": 0.25, "home_focus": 0.5}


def heuristic_score(features: DataFrame) -> DataFrame:
    total = F.lit(0.0)
    for k, v in HEURISTIC.items():
        total = total + v * F.col(k)
    return features.withColumn("score", total)


def learned_rank_score(features: DataFrame, weights: Column) -> DataFrame:
    """Standardised features through one tanh layer, plus a share of the hand-set score. weights(mean, std, w1 rows, b1, w2, b2, h_scale)."""
    from fellwalk.functions.speed import mlp
    one_hot = [(F.col("cat") == i).cast("double") for i in range(len(CATS))]
    x = F.array(*[F.col(f) for f in FEATURES], *one_hot)
    z = F.zip_with(F.zip_with(x, weights["mean"], lambda a, m: a - m), weights["std"], lambda a, s: a / F.when(s == 0, 1.0).otherwise(s))
    h = heuristic_score(features)
    return h.withColumn("score", weights["h_scale"] * F.col("score") + mlp(z, weights["w1"], weights["b1"], weights["w2"], weights["b2"]))


def rank_results(scored: DataFrame, entries: DataFrame, limit: int = 12) -> DataFrame:
    """Near-duplicates (same name within a 0.02 degree cell) collapsed, best `limit` per query, confidence = margin of the top two."""
    s = scored.select("query_id", "id", F.round("score", 9).alias("score")).join(entries.select("id", "name", "lng", "lat"), "id")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    s = s.withColumns({"_r": F.row_number().over(w), "_n": F.lead("score").over(w)})
    conf = s.where("_r = 1").select("query_id", F.coalesce(F.col("score") - F.col("_n"), F.lit(5.0)).alias("confidence"))
    cell = [F.lower("name"), round_half_up(F.col("lng") * 50), round_half_up(F.col("lat") * 50)]
    first = s.groupBy("query_id", *[c.alias(f"_k{i}") for i, c in enumerate(cell)]).agg(F.min(F.struct("_r", "id", "name", "score")).alias("b")).select("query_id", "b.*")
    out = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_r"))).where(F.col("rank") <= limit)
    return out.join(conf, "query_id").select("query_id", "id", "name", "score", "rank", "confidence")


def search(queries: DataFrame, index: dict[str, DataFrame], entries: DataFrame, limit: int = 12) -> DataFrame:
    """Rule parse, candidates, features, hand-set score, ranking. queries(query_id, query, focus_lng, focus_lat).

    Exact top results by upper bounds: the candidates with the greatest bounds are scored first; the score of a query's
    last result on that page is then a threshold, and of the others only those whose bound reaches it are scored.
    """
    c, p, table = candidates(rule_parse(queries), index, entries)
    b = cut(score_bounds(c, p, table, index, entries))
    scored = lambda rows: cut(heuristic_score(ranking_features(rows, p, index, entries)).select("query_id", "id", "score"))
    w = W.partitionBy("query_id").orderBy(F.desc("bound"), "id")
    b = cut(b.withColumn("early", F.row_number().over(w) <= 3 * limit))
    first = scored(b.where("early"))
    page = rank_results(first, entries, limit).where(F.col("rank") == limit).select("query_id", (F.col("score") - 1e-6).alias("least"))
    rest = b.where("not early").join(page, "query_id", "left").where(F.coalesce(F.col("bound") >= F.col("least"), F.lit(True)))
    return rank_results(first.unionByName(scored(rest)), entries, limit)


def local_search(queries: DataFrame, places: DataFrame, limit: int = 8) -> DataFrame:
    """Places whose folded name contains every query word, prefix hits first, then by distance.

    A word of the query must start inside a name through some token trigram; the longest query word picks the
    names through shared trigrams, so no query meets all names. queries(query_id, query, lng, lat), places(name, kind, lng, lat).
    """
    fold = lambda c: F.translate(F.lower(F.regexp_replace(c, "[̀-ͯ]", "")), "".join(a for a, _ in X._PAIRS), "".join(b for _, b in X._PAIRS))
    q = queries.withColumn("words", F.filter(F.split(fold(F.col("query")), r"\s+"), lambda w: w != "")).where(F.size("words") > 0)
    longest = F.aggregate("words", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    q = q.withColumn("seed", F.left(longest, F.lit(3)))
    p = places.withColumn("folded", fold(F.col("name"))).groupBy("folded", "kind").agg(F.min(F.struct("name", "lng", "lat")).alias("p"))
    n = F.length("folded")
    seeds = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array(*[F.substring(F.col("folded"), i, F.lit(k)) for k in (1, 2, 3)]))))
    p = p.withColumn("seed", F.explode(seeds))
    hit = q.join(p, "seed").where(F.forall("words", lambda w: F.contains("folded", w)))
    d = F.hypot(F.col("p.lng") - F.col("lng"), (F.col("p.lat") - F.col("lat")) * 1.4) / 10
    s = F.when(F.col("folded").startswith(F.get("words", F.lit(0))), 0.0).otherwise(1.0) + F.coalesce(d, F.lit(0.0))
    r = hit.select("query_id", "folded", "kind", F.col("p.name").alias("name"), F.round(s, 9).alias("score")).distinct()
    w = W.partitionBy("query_id").orderBy("score", "name", "kind")
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "name", "kind", "score", "rank")


def merge_external(local: DataFrame, web: DataFrame, parsed: DataFrame) -> DataFrame:
    """Local results plus web hits for weak queries without a cue; web hits beside a same-named local one are dropped."""
    n = local.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("conf"))
    weak = parsed.select("query_id", F.size("cue").alias("cues")).join(n, "query_id", "left").where(
        ((F.coalesce("n", F.lit(0)) < 3) | (F.coalesce("conf", F.lit(0.0)) < 0.4)) & (F.col("cues") == 0)).select("query_id")
    w = web.join(weak, "query_id", "left_semi").withColumn("_k", X.fold(F.col("name")))
    l = local.select("query_id", X.fold(F.col("name")).alias("_k"), F.col("lng").alias("lx"), F.col("lat").alias("ly"))
    same = w.join(l, ["query_id", "_k"]).where((F.abs(F.col("lng") - F.col("lx")) < 0.02) & (F.abs(F.col("lat") - F.col("ly")) < 0.02)).select("query_id", "web_id").distinct()
    fresh = w.join(same, ["query_id", "web_id"], "left_anti")
    return local.select("query_id", "name", "lng", "lat", F.lit("local").alias("source")).unionByName(fresh.select("query_id", "name", "lng", "lat", F.lit("web").alias("source")))


def match_spans(results: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    """Start and length of every query word at a word start of the folded name (same length as the name)."""
    flat = F.translate(F.lower(F.col(name)), "".join(a for a, _ in X._PAIRS), "".join(b for _, b in X._PAIRS))
    words = F.array_distinct(X.tokens(F.col(query)))
    starts = F.filter(F.sequence(F.lit(1), F.length(flat)), lambda i: F.substring(flat, i, F.lit(1)).rlike("[a-z0-9]") & ((i == 1) | ~F.substring(flat, i - 1, F.lit(1)).rlike("[a-z0-9]")))
    one = lambda w: F.transform(F.filter(starts, lambda i: F.substring(flat, i, F.length(w)) == w), lambda i: F.struct((i - 1).alias("start"), F.length(w).alias("length")))
    return results.withColumn("spans", F.array_sort(F.flatten(F.transform(words, one))))


def search_eval(results: DataFrame, cases: DataFrame) -> DataFrame:
    """top1 and top3 shares. results(query_id, name, cat, rank), cases(query_id, pattern, category nullable)."""
    ok = F.rlike(F.lower("name"), F.lower("pattern")) & (F.col("category").isNull() | (F.col("category") == F.col("cat")))
    r = cases.join(results, "query_id", "left").withColumn("hit", F.when(ok, F.col("rank")))
    per = r.groupBy("query_id").agg(F.min("hit").alias("first"))
    return per.agg(F.count(F.lit(1)).alias("cases"), F.avg(F.coalesce((F.col("first") <= 1).cast("double"), F.lit(0.0))).alias("top1"), F.avg(F.coalesce((F.col("first") <= 3).cast("double"), F.lit(0.0))).alias("top3"))


def load_shards(queries: DataFrame, streets: DataFrame) -> DataFrame:
    """Streets of the 3x3 degree shards around any query focus (shard_x, shard_y are partition columns)."""
    o = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    k = queries.select(F.floor("focus_lng").alias("a"), F.floor("focus_lat").alias("b")).distinct().select("a", "b", F.explode(o).alias("o"))
    k = k.select((F.col("a") + F.col("o.x")).cast("int").alias("shard_x"), (F.col("b") + F.col("o.y")).cast("int").alias("shard_y")).distinct()
    return streets.join(k, ["shard_x", "shard_y"], "left_semi")


def token_features(queries: DataFrame, buckets: int = 16384) -> DataFrame:
    """Hashed features per token: query_id, pos, feature, bucket. queries(query_id, tokens)."""
    t = queries.select("query_id", "tokens", F.posexplode("tokens").alias("pos", "t"))
    at = lambda o, d: F.coalesce(F.when(F.col("pos") + o >= 0, F.get("tokens", F.col("pos") + o)), F.lit(d))
    f = [F.concat(F.lit(p), v) for p, v in (("w:", F.col("t")), ("s:", X.stem(F.col("t"))), ("p:", at(-1, "^")), ("n:", at(1, "$")), ("pp:", at(-2, "^")), ("l:", F.least(F.length("t"), F.lit(9)).cast("string")))]
    f += [F.when(F.col("pos") == 0, "first"), F.when(F.col("pos") == F.size("tokens") - 1, "last"), F.when(F.col("t").rlike(r"\d"), "digit")]
    w = F.concat(F.lit("<"), F.col("t"), F.lit(">"))
    grams = [F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i, n=n: F.concat(F.lit("g:"), F.substring(w, i, F.lit(n))))).otherwise(F.array().cast("array<string>")) for n in (3, 4, 5)]
    rows = t.select("query_id", "pos", F.explode(F.concat(F.array_compact(F.array(*f)), *grams)).alias("feature"))
    d = rows.select("feature").distinct().withColumn("bucket", (X.fnv1a(F.col("feature")) % buckets).cast("int"))
    return rows.join(d, "feature")


ROLES = ["name", "cue", "near", "anchor", "me", "fill"]


def model_parse(queries: DataFrame, features: DataFrame, embedding: DataFrame, head: Column, scale: float) -> DataFrame:
    """Roles and category probabilities from mean embeddings. embedding(bucket, v array<double>); head(role_w, role_b, cat_w, cat_b).

    Tokens with the same buckets have one vector, and queries with the same tokens one mean, so vectors meet only distinct lists.
    """
    from fellwalk.functions.speed import dot
    dims = range(embedding.agg(F.max(F.size("v"))).first()[0] or 0)

    def mean(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count(F.lit(1)), *[F.avg(F.get("v", F.lit(k))).alias(f"_{k}") for k in dims]).select(key, F.array(*[F.col(f"_{k}") for k in dims]).alias("v"))

    tokens = cut(features.groupBy("query_id", "pos").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")))
    lists = tokens.select("buckets").distinct().withColumn("bucket", F.explode("buckets"))
    vec = mean(lists.join(embedding.select("bucket", "v"), "bucket"), "buckets").withColumn("v", F.transform("v", lambda x: x * scale))
    score = lambda w, b, v: F.zip_with(w, b, lambda row, c: c + dot(row, v))
    vec = vec.withColumn("rs", score(head["role_w"], head["role_b"], F.col("v")))
    best = F.array_position("rs", F.array_max("rs")) - 1
    vec = cut(vec.withColumn("role", F.get(F.array(*[F.lit(r) for r in ROLES]), best.cast("int"))).withColumn("id", F.monotonically_increasing_id()))
    said = tokens.join(vec.select("buckets", "role", "id"), "buckets").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "id"))).alias("w"))
    said = cut(said.select("query_id", F.transform("w", lambda s: s["role"]).alias("roles"), F.sort_array(F.transform("w", lambda s: s["id"])).alias("ids")))
    sent = mean(said.select("ids").distinct().withColumn("id", F.explode("ids")).join(vec.select("id", "v"), "id"), "ids")
    sent = sent.select("ids", score(head["cat_w"], head["cat_b"], F.col("v")).alias("cs"))
    q = queries.join(said, "query_id").join(sent, "ids")
    ex = F.transform("cs", lambda x: F.exp(x - F.array_max("cs")))
    q = q.withColumn("_e", ex).withColumn("cats", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, b: a + b)))
    return assemble(q.drop("ids", "cs", "_e"))
