"""The query parser: both heads are trained on shared embeddings, and the model is the one that model_parse reads."""

import numpy as np
from pyspark.sql import functions as F

from fellwalk.operators import models, querynet, search


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    model = rng.standard_normal((7 + 3 + 4, 3))
    model[:7, 2] = 0
    x = querynet.Packed(np.array([1, 2, 2, 5, 6, 0, 1]), np.array([3, 2, 2]), np.array([2, 1]), np.array([0, 2, 1]), np.array([3, 1]))
    w = np.array([0.5, 1.0, 2.0])

    def loss(m):
        _, _, pr, pc = querynet.forward(m, x, 7, 3)
        return -(np.log(pr[np.arange(3), x.roles]) * w[x.roles]).sum() - querynet.CAT_WEIGHT * np.log(pc[np.arange(2), x.cats]).sum()

    rows, g = querynet.gradient(model, x, w, 7)
    for i, r in enumerate(rows):
        for k in range(3 if r >= 7 else 2):
            step = np.zeros_like(model)
            step[r, k] = 1e-5
            assert abs((loss(model + step) - loss(model - step)) / 2e-5 - g[i, k]) < 1e-4


def test_trains_roles_and_categories(spark, monkeypatch):
    monkeypatch.setattr(querynet, "PART", 400)  # several parts, so that models are averaged
    kinds = [("lake near oak", ["cue", "near", "anchor"], 7), ("cabana near me", ["cue", "near", "me"], 16), ("where is oak", ["fill", "fill", "name"], 36)]
    rows = [(i, *kinds[i % 3]) for i in range(1500)]
    q = spark.createDataFrame([(i, t, t.split()) for i, t, _, _ in rows], "query_id long, query string, tokens array<string>")
    lab = spark.createDataFrame([(i, p, search.ROLES.index(r)) for i, _, rs, _ in rows for p, r in enumerate(rs)], "query_id long, pos int, role_id int")
    cat = spark.createDataFrame([(i, c) for i, _, _, c in rows], "query_id long, cat int")
    f = search.token_features(q)
    net, report = models.train_query_parser(lab, f.select("query_id", "pos", "bucket"), cat, 6, 37)
    r = report.first()
    assert r.queries > 0 and r.words == 3 * r.queries
    assert (r.role_accuracy, r.name_recall, r.category_accuracy) == (1.0, 1.0, 1.0)
    read = search.model_parse(q.where("query_id < 3"), f, net.table(spark), net.head(), net.scale)
    got = {x.query_id: (x.roles, max(range(37), key=x.cats.__getitem__)) for x in read.select("query_id", "roles", "cats").collect()}
    assert got == {i: (rs, c) for i, _, rs, c in rows[:3]}
