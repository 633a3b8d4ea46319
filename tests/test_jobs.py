"""Set-based jobs against brute force on small inputs, and small exact vectors."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from fellwalk import plans
from fellwalk.functions import risk, text, trails
from fellwalk.functions.geo import haversine_m, utm
from fellwalk.operators import density, detect, gazetteer, graphs, nav, routing, spatial
from fellwalk.operators.ordered import running_sums, with_neighbour


SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_distance_and_unknown_positions(spark):
    r = one(spark, haversine_m(F.lit(25.0), F.lit(45.0), F.lit(25.0), F.lit(46.0)).alias("d"), haversine_m(F.lit(None).cast("double"), F.lit(45.0), F.lit(25.0), F.lit(46.0)).alias("n"))
    assert abs(r.d - math.radians(1) * 6371008.8) < 1e-3 and r.n is None


def test_utm_central_meridian(spark):
    e, n = utm(F.lit(27.0), F.lit(45.0), F.lit(32635))
    r = one(spark, e.alias("e"), n.alias("n"))
    assert abs(r.e - 500000) < 1e-6 and abs(r.n - 4982950.4) < 1.0
    with pytest.raises(Exception):
        one(spark, utm(F.lit(27.0), F.lit(45.0), F.lit(4326))[0])


def test_risk_scale(spark):
    r = one(spark, *[risk.risk_index(F.lit(v)).alias(n) for n, v in (("a", 0.002), ("b", 3.0), ("c", 0.3), ("z", 0.0))])
    assert (r.a, r.b, r.z) == (1, 100, 1) and r.c < 70


def test_sunset_close_to_almanac(spark):
    ms = F.unix_millis(F.lit("2025-06-21 12:00:00").cast("timestamp"))
    got = one(spark, risk.next_sunset_ms(ms, F.lit(25.6), F.lit(45.65)).alias("s")).s
    want = one(spark, F.unix_millis(F.lit("2025-06-21 18:05:00").cast("timestamp")).alias("t")).t
    assert abs(got - want) < 8 * 60000


def test_markings_and_access(spark):
    m = one(spark, trails.marking_color(F.lit("red:white:red_stripe"), F.lit(None).cast("string")).alias("c"), trails.marking_shape(F.lit("red:white:red_stripe")).alias("s"))
    assert (m.c, m.s) == ("#d7263d", "stripe")
    df = spark.createDataFrame([({"highway": "track", "motor_vehicle": "forestry"},), ({"highway": "path"},), ({"highway": "tertiary", "access": "no", "motorcycle": "yes"},)], "tags map<string,string>")
    assert [r[0] for r in df.select(trails.access("moto")).collect()] == ["no", "no", "yes"]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(40)] + ["ca", "abc"]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text.edit_distance(F.col("a"), F.col("b"), 2).alias("d"), text.within_one(F.col("a"), F.col("b")).alias("o")).collect():
        want = osa(r.a, r.b)
        assert r.d == min(want, 3) and r.o == (want <= 1), (r, want)


def test_fold_and_stem(spark):
    r = one(spark, text.fold(F.lit("  Șaua  Țigănești, Straße-É ")).alias("f"), text.stem(F.lit("lacului")).alias("a"), text.stem(F.lit("postavarului")).alias("b"))
    assert r.f == "saua tiganesti strasse e" and r.a == "lac" and r.b == "postavaru"


def random_cells(seed, w, h, p):
    rnd = random.Random(seed)
    return {(x, y) for x in range(w) for y in range(h) if rnd.random() < p}


def cells_df(spark, cells):
    return spark.createDataFrame([(1, x, y) for x, y in sorted(cells)], "scan_id int, cx int, cy int")


def brute_components(cells):
    left, out = set(cells), []
    while left:
        stack, comp = [left.pop()], set()
        while stack:
            x, y = stack.pop()
            comp.add((x, y))
            for q in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    stack.append(q)
        out.append(frozenset(comp))
    return set(out)


def test_components(spark):
    cells = random_cells(1, 15, 12, 0.35)
    got = {}
    for r in detect.components(cells_df(spark, cells)).collect():
        got.setdefault(tuple(r.label), set()).add((r.cx, r.cy))
    assert {frozenset(v) for v in got.values()} == brute_components(cells)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(300).select("id")
    lab = graphs.connected_components(nodes, nodes.where("id < 299").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert lab.select("label").distinct().collect()[0][0] == 0


def brute_thin(cells, w, h):
    m = set(cells)
    while True:
        before = set(m)
        for second in (False, True):
            gone = set()
            for x, y in m:
                if not (0 < x < w - 1 and 0 < y < h - 1):
                    continue
                p = [int((x + i, y + j) in m) for i, j in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
                turns = sum(not a and b for a, b in zip(p, p[1:] + p[:1]))
                n, e, s, we = p[0], p[2], p[4], p[6]
                stop = (n and e and we) or (n and s and we) if second else (n and e and s) or (e and s and we)
                if 2 <= sum(p) <= 6 and turns == 1 and not stop:
                    gone.add((x, y))
            m -= gone
        if m == before:
            return m


def test_thinning_and_chains(spark):
    cells = {(x, y) for x in range(2, 22) for y in range(3, 8)} | {(x, y) for x in range(9, 13) for y in range(3, 14)}
    grid = spark.createDataFrame([(1, 26, 16)], "scan_id int, width int, height int")
    sk = detect.skeletonize(cells_df(spark, cells), grid)
    got = {(r.cx, r.cy) for r in sk.collect()}
    assert got == brute_thin(cells, 26, 16)
    edges = {frozenset((a, b)) for a in got for b in got if a < b and abs(a[0] - b[0]) <= 1 and abs(a[1] - b[1]) <= 1}
    rows = detect.trace_skeleton(sk).orderBy("chain", "seq").collect()
    seen = []
    for a, b in zip(rows, rows[1:]):
        if a.chain == b.chain:
            seen.append(frozenset(((a.cx, a.cy), (b.cx, b.cy))))
    assert len(seen) == len(set(seen)) and set(seen) == edges


def test_loop_is_one_chain(spark):
    ring = {(1, 0), (2, 0), (3, 1), (3, 2), (2, 3), (1, 3), (0, 2), (0, 1)}
    rows = detect.trace_skeleton(cells_df(spark, ring)).collect()
    assert len({r.chain for r in rows}) == 1 and len(rows) == 9


def brute_simplify(p, tol):
    if len(p) < 3:
        return list(p)
    (ax, ay), (bx, by) = p[0], p[-1]
    norm = math.hypot(bx - ax, by - ay) or 1
    d = [abs((by - ay) * x - (bx - ax) * y + bx * ay - by * ax) / norm for x, y in p[1:-1]]
    i = max(range(len(d)), key=lambda k: d[k])
    if d[i] <= tol:
        return [p[0], p[-1]]
    return brute_simplify(p[: i + 2], tol)[:-1] + brute_simplify(p[i + 1:], tol)


def test_simplify(spark):
    rnd = random.Random(5)
    lines = {k: [(float(i), rnd.random() * 3) for i in range(n)] for k, n in ((1, 2), (2, 9), (3, 40))}
    df = spark.createDataFrame([(k, i, x, y) for k, v in lines.items() for i, (x, y) in enumerate(v)], "line int, seq int, lng double, lat double")
    got = {}
    for r in spatial.simplify_lines(df, "line", 0.7).orderBy("line", "seq").collect():
        got.setdefault(r.line, []).append((r.lng, r.lat))
    assert got == {k: brute_simplify(v, 0.7) for k, v in lines.items()}


def test_shortest_paths(spark):
    rnd = random.Random(2)
    edges = {(a, b): round(rnd.random() * 10 + 0.1, 3) for a in range(30) for b in rnd.sample(range(30), 3) if a != b}
    reqs = [(i, rnd.randrange(5), rnd.randrange(30)) for i in range(20)]
    e = spark.createDataFrame([(a, b, a * 100 + b, c) for (a, b), c in edges.items()], "src bigint, dst bigint, way_id bigint, cost double")
    q = spark.createDataFrame(reqs, "req int, source bigint, target bigint")
    costs, tree = routing.shortest_paths(q, e)
    got = {r.req: r.cost for r in costs.collect()}
    for req, s, t in reqs:
        dist, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, u = heapq.heappop(heap)
            for (a, b), c in edges.items():
                if a == u and d + c < dist.get(b, math.inf):
                    dist[b] = d + c
                    heapq.heappush(heap, (d + c, b))
        assert (req in got) == (t in dist)
        if t in dist:
            assert abs(got[req] - dist[t]) < 1e-9
    path = routing.backtrack(q.where("req = 0"), tree).collect()
    assert all((r.prev, r.node) in edges for r in path if r.prev is not None)


def test_dedupe_is_greedy(spark):
    rnd = random.Random(4)
    rows = [(i, "a" if i % 2 else "b", "peak", rnd.randrange(9), 25 + rnd.randrange(30) / 1000, 45 + rnd.randrange(30) / 1000) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, name string, cat string, imp int, lng double, lat double")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        if not any(k[1] == r[1] and abs(k[4] - r[4]) < 0.004 and abs(k[5] - r[5]) < 0.003 for k in kept):
            kept.append(r)
    assert {r.id for r in gazetteer.dedupe_entries(df).collect()} == {r[0] for r in kept}


def test_long_groups_are_split(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    prev = with_neighbour(df, ["k"], "seq", {"v": "p"}, chunk=64).orderBy("seq").collect()
    assert len(prev) == 1000 and prev[0].p is None and all(r.p == (r.seq - 1) % 7 for r in prev[1:])
    sums = running_sums(df, ["k"], ["seq"], {"v": "s"}, F.floor(F.col("seq") / 64)).orderBy("seq").collect()
    total = 0
    for r in sums:
        total += r.v
        assert r.s == total


def test_recording_keeps_distance(spark):
    rows = [(1, i, 25.0 + i * 2e-5, 45.0, 10.0 if i != 3 else 80.0, i) for i in range(20)]
    got = nav.record_tracks(spark.createDataFrame(rows, "session_id bigint, seq int, lng double, lat double, accuracy double, t_s int")).orderBy("seq").collect()
    assert got[0].seq == 0 and all(r.dist_m >= 5 for r in got[1:]) and all(r.seq != 3 for r in got)


def test_fold_covers_additional_latin_letters(spark):
    from fellwalk.functions import text as X
    rows = spark.createDataFrame([("Phố Huế",), ("Ḥamā",), ("Großer Ḇ-ẞ",), ("Țara Bârsei",)], "t string").select(X.fold(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in rows][:2] == ["pho hue", "hama"] and rows[3]["f"] == "tara barsei"


def test_every_cue_word_votes_for_its_categories(spark):
    from fellwalk.operators import search as S
    words = sorted({(w, c) for c, cues in S.CUES.items() for w in cues if " " not in w})
    q = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(words)], "query_id long, query string")
    got = {r["query"]: (r["roles"], r["cats"]) for r in S.rule_parse(q).collect()}
    for w, c in words:
        roles, cats = got[w]
        assert roles == ["cue"] and cats[S.CATS.index(c)] > 0, w
    for w in ("fallses", "cheis", "parties", "lakeses"):
        assert w not in S.CUE_CATS


def test_long_posting_lists_are_searched(spark):
    from fellwalk.operators import search as S
    entries = spark.range(25_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("Varna Gradec "), F.col("id").cast("string")).alias("name"), F.array().cast("array<string>").alias("alt"), F.lit(2).alias("cat"), F.lit(1.0).alias("imp"))
    ix = S.build_search_index(entries)
    words = spark.createDataFrame([(1, 0, "gradec", True)], "query_id long, pos int, word string, last boolean")
    assert S.retrieve(words, ix, entries).count() == 25_000


def test_follow_route_keeps_to_its_leg(spark):
    """Out and back 20 m apart: fixes between the legs stay on the leg they came along."""
    north, dy = 45.0, 100 / 111320.0
    k = math.cos(math.radians(north)) * 111320.0
    out = [(25.0, north + i * dy) for i in range(101)]
    line = out + [(25.0 + 20 / k, y) for _, y in reversed(out)]
    route = spark.createDataFrame([(1, i, x, y, 0.0) for i, (x, y) in enumerate(line)], "route_id bigint, seq int, lng double, lat double, ele double")
    track = [(25.0 + 12 / k, north + (i + 0.4) * dy) for i in range(0, 100, 5)] + [(25.0 + 8 / k, north + (i + 0.6) * dy) for i in range(95, -1, -5)]
    far = (25.0 + 3000 / k, north + 30.2 * dy)
    fixes = spark.createDataFrame([(7, i, 1, x, y, 10.0) for i, (x, y) in enumerate(track[:22] + [far] + track[22:])] + [(8, 0, 1, *track[3], None)],
                                  "session_id bigint, seq int, route_id bigint, lng double, lat double, accuracy double")
    progress = nav.route_progress_tables(route).withColumn("duration_s", F.lit(3600.0))
    got = {(r.session_id, r.seq): r for r in nav.follow_route(fixes, progress).collect()}

    def place(x, y, last):
        m = 111320 * math.cos(math.radians(y))
        ds = []
        for s, ((ax, ay), (bx, by)) in enumerate(zip(line, line[1:])):
            ux, uy, px, py = (bx - ax) * m, (by - ay) * 110540, (x - ax) * m, (y - ay) * 110540
            t = max(0.0, min(1.0, (px * ux + py * uy) / (ux * ux + uy * uy)))
            ds.append((round(math.hypot(px - t * ux, py - t * uy), 6), s, t))
        best = min(ds[max(0, last - 20):last + 60])
        return best if best[0] <= 45 else min(ds)

    for session in (7, 8):
        last = 0
        for r in sorted((r for r in fixes.collect() if r.session_id == session), key=lambda r: r.seq):
            off, last, t = place(r.lng, r.lat, last)
            g = got[session, r.seq]
            assert abs(g.offset - off) < 1e-5 and abs(g.along - (100 * min(last, 100) + 20 * (last > 100) + 100 * max(0, last - 101) + t * (20 if last == 100 else 100))) < 40, (session, r.seq)
            assert abs(g.remaining_s - 3600 * g.remaining / g.length_m) < 1e-6
    assert len(got) == 42 and got[7, 0].remaining > 19000 and got[8, 0].accuracy is None


def test_streams_keep_every_fix(spark):
    plans.load()
    q = plans.all_queries()
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert q["sessionize_stream"](spark, SF).agg(F.sum("fixes")).first()[0] == n
    assert q["live_heat_stream"](spark, SF).agg(F.sum("fixes")).first()[0] == n


def test_snap_positions_skips_sidewalks(spark):
    seg = spark.createDataFrame([(1, 0, 25.0, 45.0, 25.01, 45.0, "sidewalk"), (2, 0, 25.0, 45.001, 25.01, 45.001, None)], "line_id bigint, seq int, ax double, ay double, bx double, by double, footway string")
    p = spark.createDataFrame([("a", 25.005, 45.0), ("b", 25.005, 44.9)], "id string, lng double, lat double")
    (r,) = nav.snap_positions(p, "id", seg, 200.0).collect()
    assert r.id == "a" and r.line_id == 2 and abs(r.dist_m - 111.32) < 1e-3


def test_search_finds_places_by_name_type_and_typos(spark):
    from fellwalk.operators import search
    from fellwalk.operators.fixpoint import cut
    rows = [("w1", "Lacul Noua", 7, 25.637, 45.613, 42), ("w2", "Parc Lacul Noua", 24, 25.6395, 45.6135, 34), ("n3", "Tâmpa", 4, 25.597, 45.635, 66), ("n4", "Postăvaru", 4, 25.55, 45.58, 70),
            ("n5", "Cabana Postăvaru", 16, 25.551, 45.581, 52), ("w6", "Bastionul Postăvarilor", 21, 25.589, 45.64, 77), ("n7", "Cabana Babele", 16, 25.464, 45.405, 60), ("w8", "Lacul Bâlea", 7, 24.617, 45.603, 60)]
    e = cut(spark.createDataFrame(rows, "id string, name string, cat int, lng double, lat double, imp int").withColumn("alt", F.array().cast("array<string>")))
    ix = {k: cut(v) for k, v in search.build_search_index(e).items()}
    want = {"lacul noua": "Lacul Noua", "tampa": "Tâmpa", "tamap": "Tâmpa", "cabana postavaru": "Cabana Postăvaru", "balea lake": "Lacul Bâlea"}
    q = spark.createDataFrame([(i, t, 25.5887, 45.6427) for i, t in enumerate(want)], "query_id long, query string, focus_lng double, focus_lat double")
    got = {r.query_id: r.name for r in search.search(q, ix, e).where("rank = 1").collect()}
    assert got == dict(enumerate(want.values()))


def test_ranks_of_hot_groups(spark):
    """Exact medians and areas with ties, where one group holds nearly all rows; no window takes a whole group."""
    rnd = random.Random(3)
    rows = [("hot", round(rnd.random(), 2), int(rnd.random() < 0.3)) for _ in range(5000)] + [("one", 0.5, 1), ("two", 0.1, 0), ("two", 0.4, 1), ("none", None, 0)]
    df = spark.createDataFrame(rows, "mode string, v double, y int").repartition(4)
    got = {r["mode"]: r["m"] for r in routing.upper_median(df, ["mode"], "v", "m").collect()}
    by = {}
    for m, v, _ in rows:
        if v is not None:
            by.setdefault(m, []).append(v)
    assert got == {m: sorted(v)[len(v) // 2] for m, v in by.items()}
    hot = [(v, y) for m, v, y in rows if m == "hot"]
    pos, neg = [v for v, y in hot if y], [v for v, y in hot if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    r = density.auc(df.where("mode = 'hot'"), "v", "y").first()
    assert abs(r.auc - want) < 1e-9 and (r.positives, r.negatives) == (len(pos), len(neg))
    assert density.auc(df.where("mode = 'one'"), "v", "y").first().auc is None
