"""Queries against their SQL twins on small tables with what only larger tables hold."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from fellwalk import plans
from fellwalk.operators import density as D
from fellwalk.operators import detect as X
from fellwalk.operators import search
from fellwalk.operators import spatial as S
from fellwalk.operators import trails as T
from fellwalk.plans.data import TABLES

SF = "/root/testdata/sf0.001"
plans.load()


def tables(folder, **changed):
    """The smallest tables, some replaced by a SELECT over them, as files in `folder`."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for t in TABLES:
        con.execute(f"COPY ({changed.get(t, f'SELECT * FROM {t}')}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


def same_rows(spark, folder, name):
    """Rows of the query, after they have been compared with its twin."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = plans.all_queries()[name](spark, folder)
    cols = sorted(got.columns)
    rows = sorted(tuple(r) for r in got.select(cols).collect())
    assert rows == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({plans.all_oracles()[name]})").fetchall())
    return rows


@pytest.fixture(scope="module")
def stacked(tmp_path_factory):
    """Parts 60,000 keys apart are nodes at one position; here both are on the same ways."""
    return tables(tmp_path_factory.mktemp("stacked"), part="SELECT * FROM part UNION ALL SELECT * REPLACE (p_partkey + 60000 AS p_partkey) FROM part",
                  lineitem="SELECT * REPLACE (l_partkey + l_linenumber % 2 * 60000 AS l_partkey) FROM lineitem")


@pytest.mark.parametrize("name", ["edge_slope", "edge_time", "expert_speed", "learned_speed", "route_features"])
def test_edges_without_length_have_no_slope(spark, stacked, name):
    rows = same_rows(spark, stacked, name)
    if name == "edge_slope":  # columns dst, slope, src, way_id
        assert {s for dst, s, src, _ in rows if abs(dst - src) == 60000} == {0.0}


@pytest.mark.parametrize("name", ["best_scenes_per_grid", "paint_order"])
def test_scenes_apart_in_the_last_bit(spark, tmp_path, name):
    # scores of 14.24: the order of the operations decides which of the two is smaller
    order = "SELECT * REPLACE ({key} AS o_orderkey, 0 AS o_custkey, 100.0 AS o_totalprice, DATE '1999-01-01' - {days} AS o_orderdate) FROM (SELECT * FROM orders LIMIT 1)"
    folder = tables(tmp_path, orders=f"{order.format(key=1000, days=178)} UNION ALL {order.format(key=2004, days=163)}")
    assert same_rows(spark, folder, name)


def test_slices_of_many_files_lose_no_request(spark, tmp_path):
    # long sessions, so that a slice is longer than the lateness that the stream allows, in several files
    folder = tables(tmp_path, events="SELECT * REPLACE (user_id % 6 AS user_id) FROM events")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert same_rows(spark, folder, "scan_requests_stream")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)


@pytest.mark.parametrize("name", ["announcements", "arrived", "elevation_lookup", "follow_route", "maneuvers", "merge_linear", "nearest_point_on_lines", "snap_positions"])
def test_nothing_that_grows_is_broadcast(spark, name):
    plan = plans.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["clearest_summer_scene", "seasonal_scenes"])
def test_scenes_of_one_extent_are_reduced_before_boxes(spark, name):
    plan = plans.all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Join Inner")[1]
    assert same_rows(spark, SF, name)


@pytest.mark.parametrize("name", ["recent_sightings", "sighting_weights", "assess_risk"])
def test_samples_are_taken_once_per_cell(spark, tmp_path, name):
    # many sightings in each cell, and parts at one position
    folder = tables(tmp_path, customer="SELECT c.* REPLACE (c_custkey + i * 300000 AS c_custkey) FROM customer c, range(5) r(i)",
                    part="SELECT p.* REPLACE (p_partkey + i * 300000 AS p_partkey) FROM part p, range(2) r(i)")
    plan = plans.all_queries()[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("share("):]  # what the samples are taken of: points and cells, without ids of sightings
    assert "Aggregate [x0" in before
    assert same_rows(spark, folder, name)


def test_sun_positions_are_worked_out_in_batches(spark):
    plan = plans.all_queries()["daylight"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "aggregate(sequence" not in plan
    assert same_rows(spark, SF, "daylight")


def test_views_over_the_same_tiles_are_counted_once(spark, tmp_path):
    # ways and views come many times, at the same tiles; before, every view met every way
    folder = tables(tmp_path, part="SELECT p.* REPLACE (p_partkey + i * 60000 AS p_partkey) FROM part p, range(3) r(i)",
                    lineitem="SELECT l.* REPLACE (l_orderkey + i * 6000000 AS l_orderkey, l_partkey + i % 3 * 60000 AS l_partkey) FROM lineitem l, range(3) r(i)",
                    orders="SELECT o.* REPLACE (o_orderkey + i * 6000000 AS o_orderkey) FROM orders o, range(3) r(i)")
    plan = plans.all_queries()["trails_in_view"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [kind" in plan  # the ways, before they meet views
    assert same_rows(spark, folder, "trails_in_view")
    views = spark.createDataFrame([(k, 25.0 + k % 3 * 0.004, 45.0, 25.001 + k * 0.002, 45.002 + k % 2 * 0.006) for k in range(9)], "view_id long, w double, s double, e double, n double")
    points = spark.createDataFrame([(w, i, 25.0 + w % 5 * 0.003 + i * 0.004, 45.0 + w * i % 4 * 0.003) for w in range(12) for i in range(2)], "way_id long, seq int, lng double, lat double")
    shown = spark.createDataFrame([(w, ("marked", "hidden", "road")[w % 3]) for w in range(12)], "way_id long, kind string")
    pairs = T.trails_in_view(shown, T.assign_cells(points, 16), views, ["marked", "hidden"], 6, 16)
    want = {(r.view_id, r.kind): r["count"] for r in pairs.groupBy("view_id", "kind").count().collect()}
    got = {(r.view_id, r.kind): r.trails for r in T.trails_per_view(shown, T.tile_boxes(points, 16), views, ["marked", "hidden"], 6, 16).collect()}
    assert want and got == want


@pytest.mark.parametrize("name", ["trace_heat", "candidate_cells"])
@pytest.mark.parametrize("block", [64, 3])
def test_bands_of_traces_are_not_shuffled(spark, monkeypatch, name, block):
    monkeypatch.setattr(X, "BLOCK", block)  # small blocks: discs reach over several
    plan = plans.all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not [keys for keys in dealt if "trace_id" in keys and re.search(r"\bcx#", keys)]
    assert same_rows(spark, SF, name)


def test_covered_cells_need_no_spots(spark):
    rings = spark.createDataFrame([(1, 0, 0, 25.0, 45.0), (1, 0, 1, 25.1, 45.0), (1, 0, 2, 25.1, 45.1), (1, 0, 3, 25.0, 45.1),
                                   (1, 1, 0, 25.041, 45.041), (1, 1, 1, 25.059, 45.041), (1, 1, 2, 25.059, 45.059), (1, 1, 3, 25.041, 45.059),
                                   (2, 0, 0, 25.15, 45.0), (2, 0, 1, 25.33, 45.0), (2, 0, 2, 25.15, 45.18)], "poly_id long, ring int, seq int, lng double, lat double")
    cells = {(c._cx, c._cy) for c in S.covered_cells(rings, 0.02).collect()}
    # the hole's cell (1252, 2252) and cells on the rims are not covered
    assert {(1251, 2251), (1253, 2253), (1259, 2252)} <= cells and not cells & {(1252, 2252), (1250, 2251), (1255, 2251), (1262, 2256), (1257, 2252)}
    at = spark.createDataFrame([(0, 25.05, 45.02), (1, 25.2, 45.05), (2, 25.05, 45.05), (3, 25.0, 45.2)], "id long, lng double, lat double")
    found = lambda: sorted(tuple(r) for r in D.habitat_factor(at, "id", rings, rings.where("poly_id = 2")).collect())
    with pytest.MonkeyPatch.context() as m:
        m.setattr(D, "covered_cells", lambda polys, size: S.covered_cells(polys, size).limit(0))  # every spot is tested
        tested = found()
    assert found() == tested and any(0 < r[2] < 1 for r in tested)
    plan = plans.all_queries()["habitat_factor"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan  # spots come from the cells that are left


def test_vectors_meet_distinct_tokens_once(spark):
    # query 3 repeats query 1 and query 4 has the tokens of query 2 turned round
    features = spark.createDataFrame([(q, p, b) for q, ps in ((1, ([0, 1, 1], [2])), (2, ([1, 2], [0, 9], [2])), (3, ([1, 0, 1], [2])), (4, ([2], [0, 9], [2, 1]))) for p, bs in enumerate(ps) for b in bs], "query_id long, pos int, bucket int")
    vectors = {0: [1.0, 0.0], 1: [0.0, 2.0], 2: [-1.0, 0.5]}
    embedding = spark.createDataFrame(list(vectors.items()), "bucket int, v array<double>")
    queries = spark.createDataFrame([(q, ["w"] * 3) for q in (1, 2, 3, 4, 5)], "query_id long, tokens array<string>")
    row = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    role_w, cat_w = [[1, 0], [0, 1], [-1, 0], [0, -1], [1, 1], [-1, 1]], [[k % 3 - 1, k % 5 - 2] for k in range(37)]
    head = F.struct(F.array(*[row(*w) for w in role_w]).alias("role_w"), row(*[0] * 6).alias("role_b"), F.array(*[row(*w) for w in cat_w]).alias("cat_w"), row(*[0] * 37).alias("cat_b"))
    got = {r.query_id: r for r in search.model_parse(queries, features, embedding, head, 1.0).collect()}
    words = {}
    for r in features.collect():
        if r.bucket in vectors:
            words.setdefault((r.query_id, r.pos), []).append(vectors[r.bucket])
    mean = lambda vs: [sum(c) / len(vs) for c in zip(*vs)]
    assert sorted(got) == [1, 2, 3, 4]
    for q, r in got.items():
        each = [mean(words[k]) for k in sorted(words) if k[0] == q]
        scores = [[w[0] * v[0] + w[1] * v[1] for w in role_w] for v in each]
        assert r.roles == [search.ROLES[s.index(max(s))] for s in scores]
        said = mean(each)
        e = [math.exp(w[0] * said[0] + w[1] * said[1]) for w in cat_w]
        assert r.cats == pytest.approx([x / sum(e) for x in e])
    plan = search.model_parse(queries, features, embedding, head, 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # vectors are not taken apart into rows


@pytest.mark.parametrize("name", ["missing_tiles", "plan_packs"])
def test_outline_is_tested_once_per_tile(spark, name):
    plan = plans.all_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan  # the samples have met distinct tiles before, not every pack's copy of them
    assert same_rows(spark, SF, name)
