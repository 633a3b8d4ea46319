"""Routes over the overlay graph."""

import heapq
import math
import random

import pytest

from fellwalk.operators import overlay, routing

EDGES = "src bigint, dst bigint, way_id bigint, cost double"


def dijkstra(edges, start):
    out = {}
    for (a, b), (c, _) in edges.items():
        out.setdefault(a, []).append((b, c))
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        for b, c in out.get(u, []) if d == dist[u] else []:
            if d + c < dist.get(b, math.inf):
                dist[b] = d + c
                heapq.heappush(heap, (d + c, b))
    return dist


def checked(spark, edges, reqs):
    e = spark.createDataFrame([(a, b, w, c) for (a, b), (c, w) in edges.items()], EDGES)
    q = spark.createDataFrame(reqs, "req int, source bigint, target bigint")
    costs, tree = routing.shortest_paths(q, e)
    got = {r.req: r.cost for r in costs.collect()}
    paths = {}
    for r in routing.backtrack(q, tree).collect():
        paths.setdefault(r.req, {})[r.back] = r
    for req, s, t in reqs:
        dist = dijkstra(edges, s)
        assert (req in got) == (req in paths) == (t in dist)
        if t not in dist:
            continue
        assert got[req] == pytest.approx(dist[t], abs=1e-9)
        rows = [paths[req][k] for k in range(len(paths[req]))]  # no gap and no repeat
        assert rows[0].node == t and rows[-1].node == s and rows[-1].prev is None
        assert all(a.prev == b.node for a, b in zip(rows, rows[1:]))
        assert sum(edges[r.prev, r.node][0] for r in rows[:-1]) == pytest.approx(dist[t], abs=1e-9)
        assert all(edges[r.prev, r.node][1] == r.way_id for r in rows[:-1])
    return paths


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_dead_ends_rings_and_one_way_edges(spark, seed):
    rng = random.Random(seed)
    edges, new = {}, 1000
    for k in range(40):  # chains of 0 to 7 inner nodes between 14 junctions, some one way, some into the void
        a, b = rng.randrange(14), rng.randrange(14)
        nodes = [a, *range(new, new + rng.randrange(8)), b if k % 6 else new + 50]
        new += 100
        for u, v in zip(nodes, nodes[1:]):
            if u != v:
                edges[u, v] = (round(rng.random() * 9 + 0.1, 3), k)
                if rng.random() < 0.93:
                    edges[v, u] = (round(rng.random() * 9 + 0.1, 3), k)
    for u, v in ((7000, 7001), (7001, 7002), (7002, 7000)):  # a ring without a junction
        edges[u, v] = edges[v, u] = (1.0, 99)
    ends = sorted({u for e in edges for u in e})
    reqs = [(i, rng.choice(ends), rng.choice(ends)) for i in range(40)] + [(90, 3, 3), (91, 7000, 7002), (92, 7000, 1)]
    checked(spark, edges, reqs)


def test_long_route_takes_few_rounds(spark, monkeypatch):
    rounds = []
    for m in (routing, overlay):
        monkeypatch.setattr(m, "cut", lambda df, f=m.cut: rounds.append(1) or f(df))
    edges = {}
    for k in range(5000):
        edges[k, k + 1] = edges[k + 1, k] = (1.0 + k % 3, 1)
    for k in range(0, 5000, 500):  # a few junctions on the way
        edges[k, 9000 + k] = edges[9000 + k, k] = (5.0, 2)
        edges[9000 + k, k + 500] = edges[k + 500, 9000 + k] = (9000.0, 2)
    paths = checked(spark, edges, [(1, 0, 5000)])
    assert len(paths[1]) == 5001 and len(rounds) < 100


def test_parallel_chains_keep_the_cheaper(spark):
    edges = {(0, 1): (1.0, 1), (1, 2): (1.0, 1), (0, 3): (1.0, 2), (3, 2): (0.5, 2), (2, 4): (1.0, 3), (4, 0): (1.0, 3)}
    checked(spark, edges, [(1, 0, 2), (2, 2, 0), (3, 1, 3), (4, 4, 4)])


def test_no_edges_and_no_requests(spark):
    checked(spark, {(1, 2): (1.0, 1)}, [(1, 5, 6), (2, 5, 5)])
    none = spark.createDataFrame([], "req int, source bigint, target bigint")
    costs, tree = routing.shortest_paths(none, spark.createDataFrame([], EDGES))
    assert costs.count() == 0 and routing.backtrack(none, tree).count() == 0


def test_reroute_survives_a_restart(spark, tmp_path):
    """An epoch whose planning fails once is run again after the restart; every departure is planned once."""
    from pyspark.sql import functions as F

    from fellwalk.streaming import fixes as L

    rows = [(s, k, 25.0, 45.0, 200.0 if (k // 4 + s) % 2 else 1.0, 5.0, 1700000000 + 10 * k) for s in range(3) for k in range(16)]
    df = spark.createDataFrame(rows, "session_id bigint, seq int, lng double, lat double, offset double, accuracy double, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(4):
        df.where(F.floor(F.col("seq") / 4) == k).coalesce(1).write.mode("append").parquet(src)
    failed = []

    def plan(left):
        if left.count() and not failed:
            failed.append(1)
            raise RuntimeError("the planner was lost")
        return left.select("session_id", "seq")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        L.reroute(L.off_route(stream), plan, out, ck).awaitTermination()

    with pytest.raises(Exception, match="planner was lost"):
        run()
    run()
    got = sorted(map(tuple, spark.read.parquet(out).select("session_id", "seq").collect()))
    assert failed and got == sorted((s, k) for s in range(3) for k in range(16) if k % 4 == 2 and (k // 4 + s) % 2)


def test_scan_requests_wait_a_minute(spark, tmp_path):
    from pyspark.sql import functions as F

    from fellwalk.streaming import fixes as L

    track = [(0, 0.0), (30, 0.01), (59, 0.02), (61, 0.02), (100, 0.03), (125, 0.0), (130, 0.03), (300, 0.02), (400, 0.04)]  # second, longitude
    df = spark.createDataFrame([(1, k, 25.0 + x, 45.0, 5.0, 1.0, 1700000000 + t) for k, (t, x) in enumerate(track)], "session_id bigint, seq int, lng double, lat double, accuracy double, speed double, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    src = str(tmp_path / "in")
    for lo, hi in ((0, 3), (3, 6), (6, 9)):
        df.where(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(src)
    q = L.write_table(L.scan_requests(L.read_fix_stream(spark, src, 1)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [0, 3, 6, 8]  # 30 s and 59 s are too soon, so is 100 s; the box of 125 s was asked for at 0 s
