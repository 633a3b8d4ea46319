"""Building the place gazetteer from map elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions import text as X

from fellwalk.functions.trails import tag
from fellwalk.operators.cells import box_cells, nearest_points
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.graphs import connected_components
from fellwalk.operators.spatial import line_bbox, line_midpoint, points_in_polygons

# Category rules in order (category, [(key, values or None for any)]), base importance, name keys.
RULES = [
    ("city", [("place", "city")]), ("town", [("place", "town")]), ("village", [("place", "village hamlet")]),
    ("district", [("place", "suburb neighbourhood quarter borough city_block")]), ("peak", [("natural", "peak volcano hill rock stone")]),
    ("saddle", [("natural", "saddle"), ("mountain_pass", "yes")]), ("ridge", [("natural", "ridge arete cliff mountain_range")]),
    ("lake", [("natural", "water"), ("water", None), ("landuse", "reservoir")]), ("waterfall", [("waterway", "waterfall"), ("natural", "waterfall")]),
    ("river", [("waterway", "river stream canal")]), ("spring", [("natural", "spring"), ("amenity", "drinking_water")]), ("cave", [("natural", "cave_entrance cave")]),
    ("gorge", [("natural", "gorge canyon"), ("geological", "gorge")]), ("valley", [("natural", "valley")]), ("forest", [("natural", "wood"), ("landuse", "forest")]),
    ("meadow", [("natural", "grassland heath meadow"), ("landuse", "meadow")]), ("hut", [("tourism", "alpine_hut wilderness_hut"), ("amenity", "shelter"), ("building+name", "cabin")]),
    ("camp", [("tourism", "camp_site caravan_site picnic_site")]), ("lodging", [("tourism", "hotel guest_house hostel motel chalet apartment")]), ("viewpoint", [("tourism", "viewpoint")]),
    ("castle", [("historic", "castle fort fortress citadel city_gate tower"), ("castle_type", None)]),
    ("monument", [("historic", "ruins archaeological_site monument memorial battlefield manor")]),
    ("attraction", [("tourism", "attraction museum zoo theme_park gallery aquarium"), ("leisure", "water_park")]),
    ("church", [("amenity", "place_of_worship monastery"), ("building", "church cathedral monastery")]),
    ("park", [("leisure", "park garden nature_reserve"), ("boundary", "national_park protected_area")]),
    ("ski", [("piste:type", None), ("aerialway", "station cable_car gondola chair_lift"), ("landuse", "winter_sports")]),
    ("food", [("amenity", "restaurant cafe fast_food pub bar biergarten ice_cream")]),
    ("station", [("railway", "station halt"), ("amenity", "bus_station"), ("public_transport", "station")]), ("parking", [("amenity", "parking")]),
    ("shop", [("shop", "supermarket mall department_store outdoor sports bicycle convenience")]),
    ("health", [("amenity", "hospital pharmacy clinic doctors mountain_rescue"), ("emergency", "mountain_rescue")]),
    ("sport", [("leisure", "stadium sports_centre swimming_pool climbing ice_rink"), ("sport", "climbing")]),
    ("other", [("amenity", "university fuel townhall police"), ("office", "government")]),
]
IMPORTANCE = {"city": 80, "town": 62, "village": 40, "district": 45, "peak": 44, "saddle": 30, "ridge": 32, "lake": 42, "river": 30, "waterfall": 44, "spring": 22, "cave": 42,
              "gorge": 46, "valley": 30, "forest": 26, "meadow": 26, "hut": 46, "camp": 30, "lodging": 22, "viewpoint": 34, "attraction": 40, "castle": 56, "monument": 26,
              "church": 28, "park": 34, "ski": 34, "food": 16, "station": 34, "parking": 12, "shop": 16, "health": 22, "sport": 22, "trail": 40, "path": 18, "street": 10, "other": 14}
NAME_KEYS = ["name:ro", "alt_name", "old_name", "short_name", "loc_name", "official_name", "name:hu", "name:de", "name:en", "alt_name:ro"]
AREA_KINDS = ["park", "forest", "lake", "ridge", "valley", "ski", "river"]


def gazetteer_category() -> Column:
    """First matching rule; null when none matches."""
    out = None
    for cat, conds in RULES:
        any_ = F.lit(False)
        for key, values in conds:
            k, _, extra = key.partition("+")
            c = (F.coalesce(tag(k), F.lit("")) != "") if values is None else F.coalesce(tag(k).isin(*values.split()), F.lit(False))
            if extra:
                c = c & (F.coalesce(tag(extra), F.lit("")) != "")
            any_ = any_ | c
        out = F.when(any_, cat) if out is None else out.when(any_, cat)
    return out


def importance(cat: Column) -> Column:
    """1..100 from the category's base plus references, population, height and web presence."""
    base = F.try_element_at(X.literal_map(IMPORTANCE), cat).cast("double")
    has = lambda *k: F.coalesce(*[F.nullif(tag(x), F.lit("")) for x in k]).isNotNull()
    pop = F.regexp_replace(tag("population"), " ", "")
    people = F.when(pop.rlike(r"^\d+$"), F.least(F.lit(20.0), 3 * F.log10(F.greatest(F.lit(1), pop.try_cast("bigint"))))).otherwise(0.0)
    ele = F.replace(F.get(F.split(F.trim(tag("ele")), " "), F.lit(0)), F.lit(","), F.lit(".")).try_cast("double")
    height = F.when((cat == "peak") & ele.isNotNull(), F.least(F.lit(14.0), F.greatest(F.lit(0.0), (ele - 800) / 120))).otherwise(0.0)
    pts = lambda c, p: F.when(c, p).otherwise(0)
    total = base + pts(has("wikidata", "wikipedia"), 18) + people + height + pts(has("tourism", "historic"), 3) + pts(has("website", "contact:website"), 3)
    return F.floor(F.greatest(F.lit(1.0), F.least(F.lit(100.0), total))).cast("int")


def names() -> tuple[Column, Column]:
    """Primary name and distinct alternatives in key order."""
    e = F.lit("")
    name = F.coalesce(F.nullif(tag("name"), e), tag("name:ro"), e)
    parts = F.flatten(F.array(*[F.split(F.coalesce(tag(k), e), ";") for k in NAME_KEYS]))
    alt = F.array_distinct(F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: (v != "") & (v != name)))
    return name, alt


def element_entries(elements: DataFrame) -> DataFrame:
    """Named, categorised elements(id, lng, lat, tags) with importance."""
    name, alt = names()
    e = elements.withColumns({"cat": gazetteer_category(), "name": name, "alt": alt}).where(F.col("cat").isNotNull() & (F.col("name") != ""))
    return e.withColumn("imp", importance(F.col("cat")))


def relation_features(members: DataFrame, vertices: DataFrame, relations: DataFrame) -> DataFrame:
    """Extent and midpoint per relation from its member ways; importance grows with members (routes) or by 4 (areas)."""
    b = line_bbox(vertices, "way_id")
    mid = line_midpoint(vertices, "way_id")
    m = members.select("rel_id", "way_id").distinct().join(b, "way_id").join(mid, "way_id")
    g = m.groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("nn"),
                                F.min(F.struct("way_id", "mid_lng", "mid_lat")).alias("m"))
    r = g.join(relations, "rel_id")
    imp = F.when(F.col("is_route"), F.least(F.lit(12), F.floor(F.col("n") / 4))).otherwise(4)
    return r.select("rel_id", "name", "n", "w", "s", "e", F.col("nn").alias("north"), F.col("m.mid_lng").alias("lng"), F.col("m.mid_lat").alias("lat"), imp.cast("int").alias("imp_extra"))


def way_features(vertices: DataFrame) -> DataFrame:
    """Closed ways sit at their bbox centre, open ones at the middle vertex."""
    ends = vertices.groupBy("way_id").agg(F.min_by("node_id", "seq").alias("a"), F.max_by("node_id", "seq").alias("b"), F.count(F.lit(1)).alias("n"))
    w = ends.join(line_bbox(vertices, "way_id").withColumnRenamed("n", "north"), "way_id").join(line_midpoint(vertices, "way_id"), "way_id")
    closed = (F.col("a") == F.col("b")) & (F.col("n") > 2)
    return w.select("way_id", closed.alias("closed"), F.when(closed, (F.col("w") + F.col("e")) / 2).otherwise(F.col("mid_lng")).alias("lng"),
                    F.when(closed, (F.col("s") + F.col("north")) / 2).otherwise(F.col("mid_lat")).alias("lat"))


def settlement_bbox(places: DataFrame, admin: DataFrame) -> DataFrame:
    """Outline box of a settlement: same folded name, contains its point, narrower than 0.6 degrees; the smallest id wins."""
    a = admin.where(F.col("e") - F.col("w") < 0.6).select(X.fold(F.col("name")).alias("k"), F.col("admin_id"), "w", "s", "e", "n")
    p = places.select("id", X.fold(F.col("name")).alias("k"), "lng", "lat")
    hit = p.join(a, "k").where("lng between w and e and lat between s and n")
    return hit.groupBy("id").agg(F.min(F.struct("admin_id", "w", "s", "e", "n")).alias("b")).select("id", "b.*")


def merge_linear(entries: DataFrame, pad: float = 0.03) -> DataFrame:
    """Same-name pieces whose padded boxes touch become one entry. entries(id, name, imp, w, s, e, n) -> label, pieces and box.

    Pieces are grouped by connected components, so the result does not depend on their order. A piece meets the
    others of its name in shared cells only.
    """
    e = entries.select("id", X.fold(F.col("name")).alias("k"), "imp", "w", "s", "e", "n")
    c = box_cells(e, F.col("w") - pad, F.col("s") - pad, F.col("e") + pad, F.col("n") + pad, 2 * pad)
    a, b = c.alias("a"), c.alias("b").hint("merge")
    touch = ((F.col("a.w") - pad <= F.col("b.e")) & (F.col("b.w") <= F.col("a.e") + pad) & (F.col("a.s") - pad <= F.col("b.n")) & (F.col("b.s") <= F.col("a.n") + pad))
    edges = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a._cx") == F.col("b._cx")) & (F.col("a._cy") == F.col("b._cy")) & (F.col("a.id") < F.col("b.id"))).where(touch)
    edges = edges.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    lab = connected_components(e.select("id"), edges)
    g = e.join(lab.hint("merge"), "id").groupBy("label").agg(F.count(F.lit(1)).alias("pieces"), F.max("imp").alias("imp"), F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("n").alias("n"))
    span = F.hypot(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    return g.withColumn("imp", F.least(F.lit(100), F.col("imp") + F.least(F.lit(10), F.floor(span * 10)).cast("int")))


def attach_context(entries: DataFrame, towns: DataFrame, settlements: DataFrame, counties: DataFrame) -> DataFrame:
    """Locality (smallest containing town box, else the nearest settlement within 12 km, villages 5 km) and county.

    towns(town_id, w, s, e, n), settlements(sid, kind, lng, lat), counties = polygon rings.
    """
    size = 0.1
    t = box_cells(towns, "w", "s", "e", "n", size)
    p = entries.select("id", "lng", "lat", F.floor(F.col("lng") / size).alias("_cx"), F.floor(F.col("lat") / size).alias("_cy"))
    inside = p.join(t, ["_cx", "_cy"]).where("lng between w and e and lat between s and n")
    box = inside.groupBy("id").agg(F.min(F.struct(((F.col("e") - F.col("w")) * (F.col("n") - F.col("s"))).alias("area"), "town_id")).alias("b")).select("id", F.col("b.town_id").alias("town_id"))
    big = nearest_points(entries, "id", settlements.where("kind <> 'village'"), "sid", 12000.0).select("id", F.col("sid").alias("s1"), F.col("dist_m").alias("d1"))
    small = nearest_points(entries, "id", settlements.where("kind = 'village'"), "sid", 5000.0).select("id", F.col("sid").alias("s2"), F.col("dist_m").alias("d2"))
    county = points_in_polygons(entries, "id", counties).groupBy("id").agg(F.min("poly_id").alias("county"))
    out = entries.join(box, "id", "left").join(big, "id", "left").join(small, "id", "left").join(county, "id", "left")
    near = F.when(F.col("d2").isNull() | (F.col("d1") <= F.col("d2")), F.col("s1")).otherwise(F.col("s2"))
    return out.withColumn("locality", F.coalesce("town_id", near, "s2", "s1")).drop("town_id", "s1", "s2", "d1", "d2")


def dedupe_entries(entries: DataFrame, dx: float = 0.004, dy: float = 0.003, max_rounds: int = 100) -> DataFrame:
    """Greedy duplicate removal by importance: an entry stays unless a better kept one has its name and category nearby.

    Settled round by round: entries without an undecided better neighbour stay, their worse neighbours go. Entries of
    one name at one position collapse first, so a heap of copies never meets itself.
    """
    k = F.concat_ws("|", X.fold(F.col("name")), F.when(F.col("cat") == "lodging", "hut").otherwise(F.col("cat")))
    e = entries.select("id", "imp", "lng", "lat", k.alias("k"))
    order = F.struct((-F.col("imp")).alias("i"), "id")
    e = cut(e.groupBy("k", "lng", "lat").agg(F.min(order).alias("o")).select("k", "lng", "lat", "o"))
    c = e.withColumns({"cx": F.floor(F.col("lng") / dx), "cy": F.floor(F.col("lat") / dy)})
    nb = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)]))
    r = c.withColumn("f", nb).select("k", (F.col("cx") + F.col("f.x")).alias("cx"), (F.col("cy") + F.col("f.y")).alias("cy"), F.col("lng").alias("x2"), F.col("lat").alias("y2"), F.col("o").alias("o2"))
    pairs = c.join(r, ["k", "cx", "cy"]).where((F.col("o2") < F.col("o")) & (F.abs(F.col("lng") - F.col("x2")) < dx) & (F.abs(F.col("lat") - F.col("y2")) < dy))
    pairs = cut(pairs.select(F.col("o.id").alias("id"), F.col("o2.id").alias("better")))
    state = cut(e.select(F.col("o.id").alias("id"), F.lit(None).cast("boolean").alias("keep")))
    for _ in range(max_rounds):
        b = pairs.join(state.withColumnRenamed("id", "better"), "better").groupBy("id").agg(F.bool_or("keep").alias("beaten"), F.count(F.when(F.col("keep").isNull(), 1)).alias("open"))
        new = state.join(b, "id", "left").select("id", F.coalesce("keep", F.when(F.coalesce("beaten", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)).alias("keep"))
        state = cut(new)
        if state.where("keep is null").isEmpty():
            return entries.join(state.where("keep").select("id"), "id", "left_semi")
    raise RuntimeError("deduplication did not settle")


def collapse_streets(streets: DataFrame, settlements: DataFrame, max_km: float = 6.0) -> DataFrame:
    """One row per street name and nearest settlement: the middle segment, importance by class plus count. streets(id, name, rank, lng, lat)."""
    near = nearest_points(streets, "id", settlements, "sid", max_km * 1000).select("id", "sid")
    s = streets.join(near, "id", "left").withColumn("k", X.fold(F.col("name")))
    g = s.groupBy("k", "sid").agg(F.count(F.lit(1)).alias("segments"), F.max("rank").alias("rank"))
    w = W.partitionBy("k", "sid").orderBy("lng", "lat", "id")
    mid = s.withColumn("_r", F.row_number().over(w)).select("k", "sid", "_r", "id", "lng", "lat")
    same = F.col("g.k").eqNullSafe(F.col("m.k")) & F.col("g.sid").eqNullSafe(F.col("m.sid"))
    j = g.alias("g").join(mid.alias("m"), same & (F.col("m._r") == F.floor(F.col("g.segments") / 2) + 1))
    return j.select("m.id", "g.k", "g.sid", "g.segments", (F.col("g.rank") + F.least(F.lit(10), F.col("g.segments"))).alias("imp"), "m.lng", "m.lat")


TEMPLATES = [("{n}", 5), ("where is {n}", 1), ("{c} {n}", 2), ("{n} near {a}", 1), ("{c} near {a}", 2), ("{c} near me", 1)]  # fixed weights of query shapes


def synthesise_queries(entries: DataFrame, n: int, seed: int) -> DataFrame:
    """n labelled queries: importance-weighted entries, weighted templates, typos and truncation, all from hashed uniforms.

    Each entry gets a share of the queries by its weight, with hashed rounding, so no global order is needed.
    """
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "id", "rep"), F.lit(1 << 30)) / float(1 << 30)
    total = entries.agg(F.sum(F.col("imp") + 1)).scalar()
    share = (F.col("imp") + 1) * n / total
    e = entries.withColumn("rep", F.lit(-1)).withColumn("times", F.floor(share + u(0)).cast("int")).where("times > 0").drop("rep")
    e = e.withColumn("rep", F.explode(F.sequence(F.lit(1), F.col("times"))))
    weight, shape, acc = float(sum(w for _, w in TEMPLATES)), None, 0.0
    for i, (_, w) in enumerate(TEMPLATES):
        acc += w / weight
        shape = F.when(u(1) < acc, i) if shape is None else shape.when(u(1) < acc, i)
    nm = X.fold(F.col("name"))
    pos = F.floor(u(3) * F.greatest(F.length(nm) - 2, F.lit(1))).cast("int") + 1
    typo = F.concat(F.left(nm, pos - 1), F.substring(nm, pos + 1, F.lit(1)), F.substring(nm, pos, F.lit(1)), F.substring(nm, pos + 2, F.length(nm)))
    shown = F.when(u(2) < 0.15, typo).when(u(2) < 0.3, F.left(nm, F.greatest(F.lit(3), F.floor(F.length(nm) * 0.7).cast("int")))).otherwise(nm)
    e = e.withColumns({"template": shape.otherwise(0), "_n": shown})
    text = None
    for i, (t, _) in enumerate(TEMPLATES):
        filled = F.replace(F.replace(F.replace(F.lit(t), F.lit("{n}"), F.col("_n")), F.lit("{c}"), F.col("cat")), F.lit("{a}"), F.col("locality"))
        text = F.when(F.col("template") == i, filled) if text is None else text.when(F.col("template") == i, filled)
    return e.select("id", "rep", "template", "cat", text.alias("query"))


def ranker_lists(features: DataFrame, truth: DataFrame, keep: int | None = None) -> DataFrame:
    """Per query the candidates (with `keep` the hardest so many, plus positives), with normalised targets. features(query_id, id, score), truth(query_id, id)."""
    f = features.join(truth.withColumn("pos", F.lit(1.0)), ["query_id", "id"], "left").na.fill(0.0, ["pos"])
    if keep:
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
        f = f.withColumn("r", F.row_number().over(w)).where((F.col("r") <= keep) | (F.col("pos") > 0)).drop("r")
    return f.withColumn("target", F.col("pos") / F.nullif(F.sum("pos").over(W.partitionBy("query_id")), F.lit(0.0)))


