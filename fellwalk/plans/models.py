"""Queries over model fitting and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fellwalk.functions import text as X
from fellwalk.operators import density as D
from fellwalk.operators import gazetteer as G
from fellwalk.operators import models as M
from fellwalk.operators import search as S
from fellwalk.operators.fixpoint import cut
from fellwalk.plans.density import land
from fellwalk.plans.geo import supplier_points
from fellwalk.plans.registry import query
from fellwalk.plans.routing import training_rows
from fellwalk.plans.search import queries

GRID = D.Grid(25.0, 47.0, 0.06)
BASIC = ["tree", "shrub", "grass", "crop", "built", "elev"]


def _rows(d):
    return D.presence_background(supplier_points(d), land(d), GRID, 30000)


@query("presence_background")
def _(d):
    return _rows(d).select("cx", "cy", "label", F.round("weight", 6).alias("weight"), "block")


@query("fit_habitat_model")
def _(d):
    rows = _rows(d).withColumn("block", F.floor(F.col("cy") / 5) * 1000 + F.floor(F.col("cx") / 5))
    return M.fit_habitat_model(rows, BASIC, trees=5, folds=2)[1].select("fold", "model", F.round("auc", 3).alias("auc"))


def _speed_rows(d):
    return cut(training_rows(d).withColumn("region", F.concat(F.lit("r"), (F.col("trace_id") % 12).cast("string"))))


@query("holdout_eval")
def _(d):
    return M.holdout_eval(_speed_rows(d), 30, 10).select("mode", "train", "test", F.round("mae_expert", 4).alias("mae_expert"), F.round("mae_learned", 4).alias("mae_learned"), "ship")


@query("train_query_parser")
def _(d):
    p = S.rule_parse(queries(d))
    roles = F.array(*[F.lit(r) for r in S.ROLES])
    lab = p.select("query_id", F.posexplode("roles").alias("pos", "role")).select("query_id", "pos", (F.array_position(roles, F.col("role")) - 1).cast("int").alias("role_id"))
    cat = p.select("query_id", (F.array_position("cats", F.array_max("cats")) - 1).cast("int").alias("cat"))
    f = S.token_features(p.select("query_id", X.tokens(F.col("query")).alias("tokens")))
    share = lambda c: F.round(c, 4).alias(c)
    r = M.train_query_parser(lab, f.select("query_id", "pos", "bucket"), cat, len(S.ROLES), len(S.CATS) + 1)[1]
    return r.select("words", share("role_accuracy"), share("name_recall"), "queries", share("category_accuracy"))


@query("train_ranker")
def _(d):
    k = F.substring("id", 2, 20).cast("long")
    f = d.places.select((k % 40).alias("query_id"), k.alias("id"), (k * 37 % 1009 / 100).alias("score"), F.col("imp").cast("double").alias("imp"))
    lists = G.ranker_lists(f, f.where("id % 11 = 0 or imp > 45").select("query_id", "id"), 80).na.fill(0.0, ["target"])
    return M.train_ranker(lists, ["score", "imp"])[1].select("queries", F.round("top1", 4).alias("top1"), F.round("top3", 4).alias("top3"), F.round("mrr", 4).alias("mrr"))
