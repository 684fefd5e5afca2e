"""Passes in row space: what moves, what is made and what is built only once."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from newsprism.operators import linear as LN
from newsprism.operators import models as MD
from newsprism.plans import learning as L


def sparse_rows(spark, n=60, size=400):
    rng = np.random.default_rng(8)
    X = np.where(rng.random((n, size)) < 0.05, rng.random((n, size)), 0.0)
    y = np.where(X[:, 1:9].sum(axis=1) + 0.3 * rng.random(n) > 0.4, 1.0, 0.0)
    rows = [(i, Vectors.sparse(size, np.flatnonzero(x).tolist(), x[x != 0].tolist()), float(t)) for i, (x, t) in enumerate(zip(X, y))]
    return spark.createDataFrame(rows, ["article_id", "features", "label"]), X, y


def test_a_pass_moves_one_set_of_sums_a_core_however_many_files(spark, monkeypatch):
    rows, X, _ = sparse_rows(spark)
    monkeypatch.setattr(LN, "FEATURE_BLOCK", 8)
    data = MD.TrainingRows(rows.repartition(3), 3, "article_id")
    space = data.by_feature
    assert space.blocks.count() > 8 * spark.sparkContext.defaultParallelism
    sent, added = [], LN.BL.added
    monkeypatch.setattr(LN.BL, "added", lambda parts, *a: sent.append(parts.groupBy("at").count().first()["count"]) or added(parts, *a))
    monkeypatch.setattr(LN, "_summed", None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = space.gram(np.ones((60, 1)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sent == [spark.sparkContext.defaultParallelism]
    assert np.allclose(np.sort(got[:, 0]), np.sort(X @ X.sum(axis=0)))


def test_a_grid_in_row_space_makes_the_weights_of_the_chosen_model_only(spark, monkeypatch):
    rows, X, y = sparse_rows(spark)
    monkeypatch.setattr(LN, "FEW", 0)
    made, fits = [], []
    weights, minimise = LN.RowSpace.weights, LN.RowSpace.minimise
    monkeypatch.setattr(LN.RowSpace, "weights", lambda self, a: made.append(a.shape[1]) or weights(self, a))
    monkeypatch.setattr(LN.RowSpace, "minimise", lambda self, kind, C, left_out, *a: fits.append(len(C)) or minimise(self, kind, C, left_out, *a))
    data = MD.TrainingRows(rows.repartition(3), 3, "article_id")
    model, share, parts = MD._best_of(data, LN.LinearLearner("logistic", 0.0, 300), {"C": [0.1, 100]})
    assert fits == [8] and made == []  # both settings on every fold and on all rows in common passes
    fold = {r.article_id: r.fold for r in data.rows.collect()}
    k = np.array([fold[i] for i in range(60)])
    want = np.mean([np.mean((X[k == j] @ parts[j].weights + parts[j].intercept > 0) == (y[k == j] > 0)) for j in range(3)])
    assert abs(share - want) < 1e-12
    made.clear()
    z = X @ model.weights + model.intercept
    gradient = model.weights + model.C * X.T @ (1 / (1 + np.exp(-z)) - y)
    assert made == [1] and np.linalg.norm(gradient) < 2e-3


def test_modes_share_one_table_of_vectors_and_windows_one_dictionary(spark, monkeypatch):
    built, dictionaries = [], []
    monkeypatch.setattr(L, "vectors", lambda spark, sf, opts=None: built.append(sf) or (spark.range(4).select(
        F.col("id").alias("article_id"), F.lit(1).alias("label"), F.lit("articles").alias("origin")), None))
    monkeypatch.setattr(MD, "train_model", lambda train, test, spec: (None, {"learner": "", "params": "", "val_accuracy": 0.0, "test_accuracy": 0.0,
                        "tp": 0, "fn": 0, "fp": 0, "tn": 0, "n_train": train.count(), "n_test": test.count()}, None))
    reps = L.train_eval_modes(spark, "x").collect()
    assert built == ["x"] and sorted(r.learner for r in reps) == ["Logistic Regression [ground_truth]", "Logistic Regression [split]"]
    from newsprism.operators import features as FT
    make = FT.corpus_dictionary
    monkeypatch.setattr(FT, "corpus_dictionary", lambda *a: dictionaries.append(1) or make(*a))
    assert len(L.time_slices(spark, "/root/testdata/sf0.001").collect()) == 5 and dictionaries == [1]
