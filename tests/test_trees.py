"""Trees on sparse rows: MLlib's rules, bounded by the non-zeros."""
import numpy as np
import pytest


def sparse_rows(spark, n=300, size=40, seed=1):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(seed)
    rows, X = [], np.zeros((n, size))
    for i in range(n):
        at = np.sort(rng.choice(size, 8, replace=False))
        # feature 0 has many values of both signs, 1 has few, some entries are explicit zeros
        values = np.where(at == 0, rng.standard_normal(8), np.where(at % 3 == 1, rng.integers(0, 3, 8), rng.random(8).round(2)))
        X[i, at] = values
        label = int(X[i, 0] + X[i, 1] + 0.5 * X[i, 7] + 0.3 * rng.standard_normal() > 0.4)
        rows.append((i, float(label), i % 3, Vectors.sparse(size, at.tolist(), values.tolist())))
    return spark.createDataFrame(rows, ["article_id", "label", "fold", "features"]), X


@pytest.mark.parametrize("depth", [2, 30])
def test_tree_is_mllibs(spark, depth):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import vector_to_array
    from newsprism.operators import linear as LN
    from newsprism.operators import trees as TR
    rows, X = sparse_rows(spark)
    packed = LN.pack(rows.repartition(3), "article_id")
    models = TR.TreeLearner(depth).fit(TR.TreeSpace(packed, X.shape[1], 3), [0, 1, 2, -1])
    for k, own in zip([0, 1, 2, -1], models):
        lib = DecisionTreeClassifier(maxDepth=depth, seed=0).fit(rows.where(f"fold <> {k}"))
        want = {r.article_id: (r.p, r.prediction) for r in lib.transform(rows).select("article_id", vector_to_array("probability")[1].alias("p"), "prediction").collect()}
        got = {r.article_id: (r.prob_1, r.prediction) for r in own.transform(rows).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
        assert np.allclose(own.featureImportances.toArray(), lib.featureImportances.toArray())
    accuracy = TR.fold_accuracy(packed, models[:3])
    y = np.array([r.label for r in rows.orderBy("article_id").collect()])
    for k in range(3):
        got = {r.article_id: r.prediction for r in models[k].transform(rows).collect()}
        assert accuracy[k] == pytest.approx(np.mean([got[i] == y[i] for i in range(k, 300, 3)]))


def test_forest_learns_and_does_not_depend_on_the_layout(spark, monkeypatch):
    from newsprism.operators import linear as LN
    from newsprism.operators import trees as TR
    rows, X = sparse_rows(spark)
    first = TR.TreeLearner(10, 20).fit(TR.TreeSpace(LN.pack(rows.repartition(1), "article_id"), 40, 3), [-1])[0]
    monkeypatch.setattr(TR, "GROUP_BYTES", 5 * 300 * 7)  # seven trees at a time
    again = TR.TreeLearner(10, 20).fit(TR.TreeSpace(LN.pack(rows.repartition(5), "article_id"), 40, 3), [0, -1])[1]
    a, b = ([(r.article_id, r.prob_1, r.prediction) for r in m.transform(rows).orderBy("article_id").collect()] for m in (first, again))
    assert a == b and len({str(t.counts) for t in first.trees}) == 20
    y = np.array([r.label for r in rows.orderBy("article_id").collect()])
    assert np.mean(np.array([p for _, _, p in a]) == y) > 0.9


def test_wide_rows_keep_the_state_small(spark):
    """MLlib's tree holds rows x features: 400 rows of a million features were 1.6 GB."""
    from pyspark.ml.linalg import Vectors
    from newsprism.operators import models as MD
    size = 1_000_000
    rows = spark.createDataFrame([(i, i % 2, Vectors.sparse(size, sorted({i % 2, 10 + 2003 * i, size - 1}), [1.0] * 3)) for i in range(400)],
                                 ["article_id", "label", "features"])
    for name in ("Decision Tree", "Multinomial NB"):
        model, rep, pred = MD.train_model(rows.where("article_id < 300"), rows.where("article_id >= 300"), MD.spec_by_name(name))
        assert rep["test_accuracy"] == rep["val_accuracy"] == 1.0 and rep["n_train"] == 300 and rep["n_test"] == 100


def test_bayes_is_mllibs(spark):
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.functions import vector_to_array
    from newsprism.operators import linear as LN
    from newsprism.operators import multinomial as MN
    from pyspark.sql import functions as F
    rows, X = sparse_rows(spark, 120)
    from pyspark.ml.linalg import Vectors, VectorUDT
    rows = rows.withColumn("features", F.udf(lambda v: Vectors.sparse(v.size, v.indices, np.abs(v.values)), VectorUDT())("features"))
    packed = LN.pack(rows, "article_id")
    for (alpha, k), own in zip([(0.1, 1), (10.0, -1)], MN.BayesLearner().fit(packed, 40, 3, [(0.1, 1), (10.0, -1)])):
        lib = NaiveBayes(smoothing=alpha).fit(rows.where(f"fold <> {k}"))
        assert np.allclose(own.theta.toArray(), lib.theta.toArray()) and np.allclose(own.prior, lib.pi.toArray())
        want = {r.article_id: (r.p, r.prediction) for r in lib.transform(rows).select("article_id", vector_to_array("probability")[1].alias("p"), "prediction").collect()}
        assert all((r.prob_1, r.prediction) == pytest.approx(want[r.article_id]) for r in own.transform(rows).collect())
