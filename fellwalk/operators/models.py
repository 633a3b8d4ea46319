"""Model fitting and evaluation with Spark ML."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from fellwalk.functions.geo import clamp
from fellwalk.functions.speed import LEARNED_CLAMP
from fellwalk.operators import querynet as Q
from fellwalk.operators.density import auc
from fellwalk.operators.fixpoint import cut
from fellwalk.operators.routing import upper_median

FOLDS, MIN_PRESENCES = 5, 5
MIN_TRAIN, MIN_TEST = 150, 30  # fixed values: rows needed per mode


def fit_habitat_model(rows: DataFrame, features: list[str], trees: int = 20, folds: int = FOLDS) -> tuple[object, DataFrame]:
    """Boosted trees on all rows, and spatial-block AUC per fold and model. rows(label, weight, block, features)."""
    df = VectorAssembler(inputCols=features, outputCol="x").transform(rows).withColumn("fold", F.pmod(F.xxhash64("block"), F.lit(folds)))
    df = df.select("label", "weight", "fold", "x").cache()
    gbt = GBTClassifier(featuresCol="x", weightCol="weight", maxIter=trees, stepSize=0.1, maxDepth=4, minInstancesPerNode=5, seed=7)
    out = None
    presences = {r["fold"]: r["n"] for r in df.where("label = 1").groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k in range(folds):
        if presences.get(k, 0) < MIN_PRESENCES or len(presences) < 2:
            continue
        tr, te = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(tr)
        lr = LogisticRegression(featuresCol="z", weightCol="weight", regParam=1e-3).fit(scaler.transform(tr))
        for name, scored in (("gbm", gbt.fit(tr).transform(te)), ("logistic", lr.transform(scaler.transform(te)))):
            s = scored.select("label", vector_to_array("probability")[1].alias("p"))
            r = auc(s, "p", "label").select(F.lit(k).alias("fold"), F.lit(name).alias("model"), "auc")
            out = r if out is None else out.unionByName(r)
    return gbt.fit(df), out


def train_speed_model(rows: DataFrame):
    """Robust weighted regression of the log speed residual on the 21 features. rows(x array, y, w)."""
    return LinearRegression(featuresCol="v", labelCol="y", weightCol="w", loss="huber", regParam=2e-3, maxIter=100).fit(rows.withColumn("v", array_to_vector("x")))


def holdout_eval(rows: DataFrame, min_train: int = MIN_TRAIN, min_test: int = MIN_TEST) -> DataFrame:
    """Per mode: weighted MAE of log speed and upper-median time error on whole held-out regions, expert against learned, and whether to ship.

    Every fourth region (second of each four, in name order) is held out. rows(region, mode, x, y, w, v_obs, v_expert).
    """
    # the ranking runs over region names only
    reg = rows.select("region").distinct().withColumn("_i", F.row_number().over(W.orderBy("region")) - 1)
    r = rows.join(reg, "region").withColumn("test", F.col("_i") % 4 == 1).cache()
    out = None
    counts = {(c["mode"], c["test"]): c["n"] for c in r.groupBy("mode", "test").agg(F.count(F.lit(1)).alias("n")).collect()}
    for mode in sorted({m for m, _ in counts}):
        n_tr, n_te = counts.get((mode, False), 0), counts.get((mode, True), 0)
        te = r.where((F.col("mode") == mode) & F.col("test"))
        if n_tr < min_train or n_te < min_test:
            e = te.sparkSession.range(1).select(F.lit(mode).alias("mode"), *[F.lit(None).cast("double").alias(c) for c in ("mae_expert", "mae_learned", "time_error_expert", "time_error_learned")])
        else:
            model = train_speed_model(r.where((F.col("mode") == mode) & ~F.col("test")))
            s = model.transform(te.withColumn("v", array_to_vector("x"))).withColumn("pred", clamp("prediction", *LEARNED_CLAMP))
            truth = F.log(F.col("v_obs") / F.col("v_expert"))
            err = lambda p: p - truth
            s = s.withColumns({"e0": err(F.lit(0.0)), "e1": err(F.col("pred"))}).withColumns({"t0": F.abs(F.exp(-F.col("e0")) - 1), "t1": F.abs(F.exp(-F.col("e1")) - 1)})
            m = s.groupBy("mode").agg((F.sum(F.abs("e0") * F.col("w")) / F.sum("w")).alias("mae_expert"), (F.sum(F.abs("e1") * F.col("w")) / F.sum("w")).alias("mae_learned"))
            e = m.join(upper_median(s, ["mode"], "t0", "time_error_expert"), "mode").join(upper_median(s, ["mode"], "t1", "time_error_learned"), "mode")
        e = e.withColumns({"train": F.lit(n_tr), "test": F.lit(n_te)})
        out = e if out is None else out.unionByName(e)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "mode string, mae_expert double, mae_learned double, time_error_expert double, time_error_learned double, train int, test int")
    return out.withColumn("ship", F.coalesce(F.col("mae_learned") < F.col("mae_expert"), F.lit(False)))


def train_query_parser(labelled: DataFrame, features: DataFrame, categories: DataFrame, roles: int, cats: int, buckets: int = Q.BUCKETS, epochs: int = Q.EPOCHS) -> tuple[Q.QueryNet, DataFrame]:
    """Role per word and category per query from hashed features, through embeddings that both heads share.

    labelled(query_id, pos, role_id), features(query_id, pos, bucket), categories(query_id, cat). Role weights are square-root
    balanced; every twentieth query validates. Returns the model, with int8 embeddings, and its accuracy.
    """
    words = features.groupBy("query_id", "pos").agg(F.sort_array(F.collect_list("bucket")).alias("fs")).join(labelled, ["query_id", "pos"])
    rows = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "fs", "role_id"))).alias("w")).join(categories, "query_id")
    rows = rows.select("query_id", F.col("w.fs").alias("features"), F.col("w.role_id").cast("array<int>").alias("roles"), F.col("cat").cast("int").alias("cat"))
    parts = min(max(-(-categories.count() // Q.PART), 1), Q.PARTS)
    rows = cut(rows.repartition(parts, "query_id").sortWithinPartitions("query_id"))
    val = F.pmod(F.xxhash64("query_id"), F.lit(20)) == 0
    train = rows.where(~val)
    n = {r["role"]: r["n"] for r in train.select(F.explode("roles").alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = [(sum(n.values()) / (roles * max(n.get(k, 0), 1))) ** 0.5 for k in range(roles)]
    model = Q.fit(train, weights, cats, buckets, epochs=epochs)
    return model, Q.evaluate(model, rows.where(val))


def train_ranker(lists: DataFrame, features: list[str], max_iter: int = 30) -> tuple[object, DataFrame]:
    """Pairwise correction of the hand-set score: differences of a positive and its query's mean negative. lists(query_id, id, target, features).

    A query's negatives enter through their mean, so pairs grow with the positives only. Returns the model and top1, top3, MRR.
    """
    neg = lists.where("target = 0").groupBy("query_id").agg(*[F.avg(f).alias(f"n_{f}") for f in features])
    d = lists.where("target > 0").join(neg, "query_id").select(*[(F.col(f) - F.col(f"n_{f}")).alias(f) for f in features])
    sign = F.explode(F.array(F.lit(1.0), F.lit(-1.0)))
    d = d.withColumn("label_s", sign).select(*[(F.col(f) * F.col("label_s")).alias(f) for f in features], F.when(F.col("label_s") > 0, 1.0).otherwise(0.0).alias("label"))
    va = VectorAssembler(inputCols=features, outputCol="x")
    model = LogisticRegression(featuresCol="x", fitIntercept=False, regParam=1e-3, maxIter=max_iter).fit(va.transform(d))
    score = F.lit(0.0)
    for f, c in zip(features, model.coefficients):
        score = score + float(c) * F.col(f)
    r = lists.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(score.desc(), "id")))
    first = r.groupBy("query_id").agg(F.min(F.when(F.col("target") > 0, F.col("rank"))).alias("f"))
    return model, first.agg(F.count("f").alias("queries"), F.avg((F.col("f") <= 1).cast("double")).alias("top1"), F.avg((F.col("f") <= 3).cast("double")).alias("top3"), F.avg(1 / F.col("f")).alias("mrr"))
