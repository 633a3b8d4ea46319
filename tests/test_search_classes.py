"""Equal word lists and entries of equal names are met once; what they give is what all pairs give."""

from pyspark.sql import functions as F

from fellwalk.operators import search


def places(spark):
    """Forty places of five names, at different positions and of different importance."""
    names = ["blue anvil 3", "blue ring 3", "old ring 7", "Lacul old plate", "blue anvil 4"]
    rows = [(f"p{i}", names[i % 5], ["Lacul " + names[i % 5]] if i % 10 == 0 else [], i % 36, 25 + i * 37 % 40 / 20, 44 + i * 17 % 40 / 20, i * 7 % 50) for i in range(40)]
    e = spark.createDataFrame(rows, "id string, name string, alt array<string>, cat int, lng double, lat double, imp int")
    return e, search.build_search_index(e)


def log(spark):
    said = ["lake near blue anvil 3", "lake near old ring", "lake near blue anvil 3", "lake near plate", "blue anvil 3", "lake near blue anvil 3"]
    return spark.createDataFrame([(i, t, 24.9 + i / 2, 44.1 + i / 3) for i, t in enumerate(said)], "query_id long, query string, focus_lng double, focus_lat double")


def test_anchor_is_that_of_all_pairs(spark):
    e, ix = places(spark)
    parsed = search.rule_parse(log(spark))
    none = F.array().cast("array<string>")
    p, lists, _ = search.prepared(parsed.withColumns({"match": none, "content": none, "typing": F.lit(False)}), ix, e)
    hits = lists.where("list = 'anchor'")
    want = {tuple(r) for r in search.resolve_anchor(p, ix, e, hits).collect()}
    assert {tuple(r) for r in search.resolve_anchor(parsed, ix, e).collect()} == want and len(want) == 5
    assert search.anchor_candidates(parsed, ix, e).count() < hits.count() / 2


def test_totals_are_those_of_all_pairs(spark):
    e, ix = places(spark)
    w = log(spark).select("query_id", F.split("query", " ").alias("t")).select("query_id", F.posexplode("t").alias("pos", "word"), (F.size("t") - 1).alias("n"))
    w = w.select("query_id", "pos", "word", (F.col("pos") == F.col("n")).alias("last"))
    pairs = search.retrieve(w, ix, e)
    want = {tuple(r) for r in pairs.groupBy("query_id").agg(F.count("id"), F.max("retrieval")).collect()}
    assert {tuple(r) for r in search.retrieve_totals(w, ix, e).collect()} == want and len(want) == 6
    # a word that is in one name only reaches the entries of this name, and each of them
    assert {r.id for r in pairs.where("query_id = 3").collect()} >= {f"p{i}" for i in range(40) if i % 5 == 3}


def test_counts_are_those_of_all_places_around(spark):
    e, _ = places(spark)
    rows = [(i % 25, 24.5 + i * 13 % 50 / 20, 43.5 + i * 29 % 60 / 20) for i in range(30)] + [(7, -0.05, 44.0), (99, 80.0, 10.0)]
    points = spark.createDataFrame(rows, "k long, lng double, lat double")
    want = {tuple(r) for r in search.near(points, "k", e, 20).groupBy("k").agg(F.count(F.lit(1))).collect()}
    got = search.near_counts(points, "k", e, 20)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
