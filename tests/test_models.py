"""Learners on a planted-signal table: SQL-form naive Bayes and
an MLlib learner must beat the majority share."""

import pytest
from pyspark.sql import functions as F

from newsprism.operators import nbayes as NB


def planted(spark, n=200):
    rows = []
    for i in range(n):
        label = i % 2
        words = ["good", "fine", "true"] if label == 0 else ["fake", "hoax", "false"]
        rows += [(i, w, 1.0 + (i % 3)) for w in words]
        rows.append((i, "common", 1.0))
    feats = spark.createDataFrame(rows, "article_id INT, feature STRING, value DOUBLE")
    labels = spark.createDataFrame([(i, i % 2, "train" if i % 5 else "test") for i in range(n)],
                                   "article_id INT, label INT, split STRING")
    return feats, labels


def test_sql_naive_bayes_planted(spark):
    feats, labels = planted(spark)
    model = NB.train(feats, labels.where("split = 'train'").select("article_id", "label"), alpha=1.0)
    pred = NB.predict(feats, labels.where("split = 'test'").select("article_id", "label"), model)
    acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).collect()[0][0]
    assert acc == 1.0


def test_grouped_naive_bayes_equals_separate(spark):
    feats, labels = planted(spark)
    tr = labels.where("split = 'train'").select("article_id", "label")
    te = labels.where("split = 'test'").select("article_id", "label")
    single = {r.article_id: round(r.prob_1, 9) for r in NB.predict(feats, te, NB.train(feats, tr)).collect()}
    g = F.lit(7).alias("g")
    gf, gtr, gte = feats.select("*", g), tr.select("*", g), te.select("*", g)
    grouped = {r.article_id: round(r.prob_1, 9) for r in
               NB.predict(gf, gte, NB.train(gf, gtr, group=["g"]), group=["g"]).collect()}
    assert single == grouped


def noisy(spark, n=160, m=12, seed=3):
    """(train rows with features, label and fold; dense X, y, fold)."""
    import numpy as np
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql import types as T
    rng = np.random.default_rng(seed)
    X = rng.random((n, m)) * (rng.random((n, m)) < 0.4)
    X[0] = 0
    y = (X @ rng.normal(0, 3, m) + rng.normal(0, 1, n) > 0.2).astype(float)
    fold = np.arange(n) % 3
    schema = T.StructType([T.StructField("article_id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("label", T.DoubleType()), T.StructField("fold", T.IntegerType())])
    rows = [(i, Vectors.sparse(m, np.flatnonzero(X[i]).tolist(), X[i][X[i] != 0].tolist()) if i % 2 else Vectors.dense(X[i]),
             float(y[i]), int(fold[i])) for i in range(n)]
    return spark.createDataFrame(rows, schema).repartition(3), X, y, fold


def objective(kind, X, y, C, w, b):
    """(value, gradient) of 0.5 |w|^2 (squared hinge: and b) + C * loss, in plain numpy."""
    import numpy as np
    s, z = 2 * y - 1, X @ w + b
    if kind == "logistic":
        value, dz = np.log1p(np.exp(-s * z)).sum(), -s / (1 + np.exp(s * z))
        return 0.5 * w @ w + C * value, np.append(w + C * X.T @ dz, C * dz.sum())
    t = np.maximum(0, 1 - s * z)
    return 0.5 * (w @ w + b * b) + C * (t * t).sum(), np.append(w - 2 * C * X.T @ (s * t), b - 2 * C * (s * t).sum())


def brute_minimum(kind, X, y, C):
    """Damped Newton with finite-difference Hessian."""
    import numpy as np
    v = np.zeros(X.shape[1] + 1)
    f = lambda v: objective(kind, X, y, C, v[:-1], v[-1])
    for _ in range(200):
        value, g = f(v)
        if np.linalg.norm(g) < 1e-9:
            break
        H = np.stack([(f(v + 1e-6 * e)[1] - f(v - 1e-6 * e)[1]) / 2e-6 for e in np.eye(len(v))])
        d = np.linalg.solve((H + H.T) / 2 + 1e-10 * np.eye(len(v)), -g)
        t = 1.0
        while f(v + t * d)[0] > value and t > 1e-9:
            t /= 2
        v = v + t * d
    return v


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge"])
def test_linear_learners_against_numpy(spark, kind, monkeypatch):
    import numpy as np
    from newsprism.operators import blocks as BL
    from newsprism.operators import linear as LN
    monkeypatch.setattr(BL, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(BL, "PIECE", 5)
    if kind == "logistic":
        monkeypatch.setattr(BL, "DIRECT_BYTES", 0)
    rows, X, y, fold = noisy(spark)
    packed = LN.pack(rows)
    grid = [(c, k) for c in (0.01, 1.0, 100.0) for k in (-1, 0, 2)]
    models = LN.LinearLearner(kind, 0.0, 600).fit(packed, X.shape[1], grid)
    for m, (c, k) in zip(models, grid):
        at = fold != k
        g = objective(kind, X[at], y[at], c, m.weights, m.intercept)[1]
        assert np.linalg.norm(g) < 1e-3 and m.gradient_norm < 1e-3
        want = brute_minimum(kind, X[at], y[at], c)
        assert np.abs(np.append(m.weights, m.intercept) - want).max() < 1e-4
    got = LN.fold_accuracy(packed, models, [k if k >= 0 else 1 for _, k in grid])
    for m, (c, k), a in zip(models, grid, got):
        at = fold == (k if k >= 0 else 1)
        assert abs(a - ((X[at] @ m.weights + m.intercept > 0) == (y[at] > 0)).mean()) < 1e-12
    monkeypatch.setattr(LN, "STATE_BYTES", (X.shape[1] + 1) * 8 * (2 * LN.HISTORY + 8) * 2)  # two models a group
    again = LN.LinearLearner(kind, 0.0, 600).fit(packed, X.shape[1], grid[:3])
    assert all(np.allclose(a.weights, b.weights, atol=1e-4) for a, b in zip(again, models))
    monkeypatch.setattr(LN, "STATE_BYTES", 10)
    with pytest.raises(ValueError):
        LN.LinearLearner(kind, 0.0, 600).fit(packed, X.shape[1], grid[:1])


@pytest.mark.parametrize("kind", ["logistic", "squared_hinge"])
def test_more_features_than_rows(spark, kind, monkeypatch):
    """The descent on one number a row ends where the one on the weights does, and sends no vector as long as the vocabulary."""
    import numpy as np
    from pyspark.ml.linalg import Vectors
    from newsprism.operators import linear as LN
    rng = np.random.default_rng(3)
    X = np.where(rng.random((60, 400)) < 0.05, rng.random((60, 400)), 0.0)
    X[:, 0] = 1.0
    y, fold = np.where(X[:, 1:9].sum(axis=1) + 0.3 * rng.random(60) > 0.4, 1.0, 0.0), rng.integers(0, 3, 60)
    rows = spark.createDataFrame(
        [(Vectors.sparse(400, np.flatnonzero(x).tolist(), x[x != 0].tolist()), float(t), int(k)) for x, t, k in zip(X, y, fold)], ["features", "label", "fold"])
    packed, grid = LN.pack(rows.repartition(3)), [(c, k) for c in (0.01, 1.0, 100.0) for k in (-1, 0, 2)]
    with monkeypatch.context() as m:
        m.setattr(LN, "FEW", 0)
        m.setattr(LN, "WEIGHT_BYTES", 400 * 8 * 4)  # four models at a time
        m.setattr(LN, "_summed", None)  # no sums as wide as the features
        models = LN.LinearLearner(kind, 0.0, 600).fit(packed, 400, grid)
    for m, (c, k) in zip(models, grid):
        at = fold != k
        assert m.weights.shape == (400,) and m.gradient_norm < 1e-3
        assert np.linalg.norm(objective(kind, X[at], y[at], c, m.weights, m.intercept)[1]) < 2e-3


def test_logistic_regression_agrees_with_mllib(spark):
    import numpy as np
    from pyspark.ml.classification import LogisticRegression
    from newsprism.operators import linear as LN
    rows, X, y, _ = noisy(spark, seed=5)
    for c in (0.1, 10.0):
        own = LN.LinearLearner("logistic", 0.0, 600).fit(LN.pack(rows), X.shape[1], [(c, -1)])[0]
        lib = LogisticRegression(regParam=1 / (c * len(y)), standardization=False, maxIter=500, tol=1e-12).fit(rows)
        assert np.allclose(own.weights, lib.coefficients.toArray(), atol=2e-3) and abs(own.intercept - lib.intercept) < 2e-3


def test_grid_search_on_planted_rows(spark):
    from newsprism.operators import models as MD
    from newsprism.operators import vectors as VEC
    feats, labels = planted(spark, 120)
    index = VEC.fit_index(feats)
    vec = VEC.to_vectors(feats, index, labels)
    train, test = vec.where("split = 'train'"), vec.where("split = 'test'")
    for name in ("Logistic Regression", "Linear SVC"):
        spec = MD.LearnerSpec(name, MD.spec_by_name(name).make, {"C": [0.1, 10]})
        model, rep, pred = MD.train_model(train, test, spec, folds=2)
        assert rep["test_accuracy"] == rep["val_accuracy"] == 1.0 and rep["params"] in ("{'C': 0.1}", "{'C': 10}")
        assert rep["tp"] + rep["fn"] + rep["fp"] + rep["tn"] == rep["n_test"]
        assert {"margin", "prediction", "prob_1", "label"} <= set(pred.columns)


def test_ensemble_has_a_cross_validated_accuracy(spark):
    from newsprism.operators import models as MD
    from newsprism.operators import vectors as VEC
    feats, labels = planted(spark, 90)
    vec = VEC.to_vectors(feats, VEC.fit_index(feats), labels)
    specs = [MD.LearnerSpec("Decision Tree", MD.spec_by_name("Decision Tree", max_depth=3).make),
             MD.LearnerSpec("Logistic Regression", MD.spec_by_name("Logistic Regression").make, {"C": [1]}),
             MD.LearnerSpec("Multinomial NB", MD.spec_by_name("Multinomial NB").make, {"alpha": [1.0]})]
    reports, models = MD.compare_learners(vec.where("split = 'train'"), vec.where("split = 'test'"), specs, folds=2)
    assert [r["learner"] for r in reports] == [s.name for s in specs] + ["Voting Classifier"] and len(models) == 3
    assert reports[-1]["val_accuracy"] == 1.0 and reports[-1]["test_accuracy"] == 1.0


def test_importance_frame_picks_the_largest_weights_before_the_join(spark):
    from types import SimpleNamespace
    from pyspark.ml.linalg import Vectors
    from newsprism.operators import evaluation as EV
    from newsprism.operators import models as MD
    weights = [0.5, 2.0, -3.0, 1.0, 1.0, 1.0, 0.1]
    model = SimpleNamespace(coefficients=Vectors.dense(weights))
    names = spark.createDataFrame([(i, f"f{9 - i}") for i in range(7)], "idx INT, feature STRING")
    cut = MD.importance_frame(spark, model, names, 3)
    assert sorted(r.weight for r in cut.collect()) == [1.0, 1.0, 1.0, 2.0]  # ties at the cut stay
    top = [tuple(r) for r in EV.top_features(cut, 3).collect()]
    assert top == [tuple(r) for r in EV.top_features(MD.importance_frame(spark, model, names), 3).collect()]
    assert top == [("f8", 2.0), ("f4", 1.0), ("f5", 1.0)]
    assert MD.importance_frame(spark, model, names, 50).count() == 7
