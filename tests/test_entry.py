"""The driver contract and plan shapes."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal
from fellwalk.plans.data import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["trail_length_by_cell", "points_in_polygons", "nearest_nodes", "trace_heat", "area_stats", "best_scenes_per_grid", "off_route", "plan_packs", "rule_parse", "gpx_round_trip"]


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    exp = con.sql(entry.oracle_sql()[name]).df()
    assert normal(got) == normal(exp)


@pytest.mark.parametrize("name", ["bbox_join", "points_in_polygons", "nearest_nodes", "nearest_point_on_lines", "map_match", "browse", "removable_tiles"])
def test_no_theta_joins(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_stream_equals_batch(spark):
    q = entry.queries()
    a = {tuple(r) for r in q["record_tracks_stream"](spark, SF).where("points > 1").select("session_id", "points", "distance_m").collect()}
    b = {(r.session_id, r.points, r.distance_m) for r in q["record_tracks"](spark, SF).collect()}
    assert a == b
