"""Scoring reports: hand-traced cases (FIXTURES 3.11, 3.13, 3.14, 3.18)."""

from newsprism.operators import evaluation as EV
from newsprism.operators.splits import split_by_date


def test_confusion_and_accuracy(spark):
    df = spark.createDataFrame(list(zip([1, 1, 0, 0, 0], [1, 0, 1, 0, 0])), "label INT, prediction INT")
    cm = EV.confusion_matrix(df).collect()[0]
    assert (cm.tp, cm.fn, cm.fp, cm.tn) == (1, 1, 1, 2)
    assert EV.accuracy(df).collect()[0].accuracy == 0.6


def test_probability_bins(spark):
    df = spark.createDataFrame([(0.2, 0), (0.3, 1), (0.7, 1)], "prob_1 DOUBLE, label INT")
    got = {r.bin_label: (r.ones, r.zeros, r.accuracy) for r in EV.probability_bins(df).collect()}
    assert len(got) == 10
    assert got[0.0] == (0, 1, 1.0)      # 0.2 -> bin 0.0, below threshold: zeros / n
    assert got[0.1] == (1, 0, 0.0)      # 0.3 sits on an edge, right-closed
    assert got[0.9] == (1, 0, 1.0)
    assert all(got[b] == (0, 0, 0.0) for b in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8))


def test_soft_vote(spark):
    df = spark.createDataFrame([(1, m, p) for m, p in enumerate([0.9, 0.4, 0.4, 0.4])], "article_id INT, member INT, prob_1 DOUBLE")
    r = EV.soft_vote(df).collect()[0]
    assert abs(r.prob_1 - 0.525) < 1e-12 and r.prediction == 1


def test_split_by_date(spark):
    df = spark.createDataFrame([(1, "2017-02-28 00:00:00"), (2, "2017-03-01 00:00:00"), (3, None)], "id INT, d STRING")
    df = df.selectExpr("id", "CAST(d AS TIMESTAMP) AS date")
    a, b = split_by_date(df, "2017-03-01")
    assert [r.id for r in a.collect()] == [1] and [r.id for r in b.collect()] == [2]


def test_top_k_outcomes_bounded(spark):
    rows = [(i, i % 2, (i // 2) % 2, f"t{i}", f"u{i}", "x" * 10) for i in range(200)]
    df = spark.createDataFrame(rows, "article_id INT, label INT, prediction INT, title STRING, url STRING, text STRING")
    ex = EV.outcome_examples(df, 5).collect()
    assert sorted({r.outcome for r in ex}) == ["FN", "FP", "TN", "TP"] and len(ex) == 20
