"""Learners, grid search and evaluation reports.

``train_model`` mirrors the studied entry point: pick a test mode (random
split, ground truth, or another dataset), grid-search with k-fold
cross-validation on deterministic folds, refit the best on all training
rows, score the test rows and return a one-row report plus predictions.

Trees and forest (``trees.py``) and naive Bayes (``multinomial.py``) follow MLlib's rules over sparse rows.  Logistic regression and the
squared-hinge SVC are ``linear.py``'s: C is the inverse strength on a summed loss, so it means the same
on folds and on all rows.  The whole grid is trained in common passes, and the rows are packed once for all learners.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluation as EV
from . import linear as LN
from . import multinomial as NB
from . import trees as TR
from .splits import fold_column


@dataclass
class LearnerSpec:
    name: str
    make: callable
    grid: dict = field(default_factory=dict)   # option name -> values (studied names: C, alpha)


def learner_specs(max_depth: int = 30, seed: int = 0, trees: int = 20) -> list[LearnerSpec]:
    """The five studied learners with their grids (1 + 1 + 5 + 4 + 5 points; fixed values of the task).
    Tree and forest grow to ``max_depth`` (30 is the most MLlib allows; the studied
    ones are unbounded); the forest has ``trees`` trees."""
    cs = [0.01, 0.1, 1, 10, 100]
    return [
        LearnerSpec("Decision Tree", lambda: TR.TreeLearner(max_depth, None, seed)),
        LearnerSpec("Random Forest", lambda: TR.TreeLearner(max_depth, trees, seed)),
        LearnerSpec("Logistic Regression", lambda: LN.LinearLearner("logistic"), {"C": cs}),
        LearnerSpec("Multinomial NB", NB.BayesLearner, {"alpha": [0.1, 1.0, 10.0, 100.0]}),
        LearnerSpec("Linear SVC", lambda: LN.LinearLearner("squared_hinge"), {"C": cs}),
    ]


def spec_by_name(name: str, **kw) -> LearnerSpec:
    for s in learner_specs(**kw):
        if s.name == name:
            return s
    raise KeyError(name)


def _describe_params(model, grid: dict) -> str:
    parts = []
    for k in grid:
        if k == "C":
            parts.append(f"'C': {model.C:g}")
        elif k == "alpha":
            parts.append(f"'alpha': {model.alpha}")
    return "{" + ", ".join(parts) + "}"


def with_prob(pred: DataFrame) -> DataFrame:
    if "prob_1" in pred.columns:
        return pred
    if "probability" in pred.columns:
        return pred.withColumn("prob_1", vector_to_array("probability")[1])
    return pred.withColumn("prob_1", F.lit(None).cast("double"))


class TrainingRows:
    """Training rows with label and ``fold``, packed once for all learners."""

    def __init__(self, train: DataFrame, folds: int, id_col: str):
        self.rows, self.folds, self.id_col = fold_column(train.withColumn("label", F.col("label").cast("double")), id_col, folds), folds, id_col

    @cached_property
    def size(self) -> int:
        some = self.rows.select("features").first()
        if some is None:
            raise ValueError("no training rows")
        return some.features.size

    @cached_property
    def packed(self) -> DataFrame:
        return LN.pack(self.rows, self.id_col)

    @cached_property
    def by_feature(self) -> LN.RowSpace:
        return LN.RowSpace(self.packed, self.size)

    @cached_property
    def bins(self) -> TR.TreeSpace:
        return TR.TreeSpace(self.packed, self.size, self.folds, self.by_feature)


def _best_of(data: TrainingRows, est, grid: dict) -> tuple[object, float, list]:
    """(model on all rows, its mean fold accuracy, models without each fold) of the grid point with the highest one,
    the first of ties."""
    folds = data.folds
    if isinstance(est, TR.TreeLearner):
        data.size  # refuses no rows
        *parts, final = est.fit(data.bins, [*range(folds), -1])
        return final, float(np.mean(TR.fold_accuracy(data.packed, parts))), parts
    if isinstance(est, NB.BayesLearner):
        values = [float(a) for a in grid.get("alpha", [1.0])]
        each = [(a, k) for a in values for k in range(folds)]
        models = est.fit(data.packed, data.size, folds, [*each, *[(a, -1) for a in values]])
        judged = [m.linear() for m in models[:len(each)]]
    else:
        values = [float(c) for c in grid.get("C", [1.0])]
        each = [(c, k) for c in values for k in range(folds)]
        # on all rows beside the folds where that takes no more passes or memory of its own
        whole = values if len(values) == 1 or LN.in_row_space(data.packed, data.size) else []
        found = dict(zip(wanted := [(c, k) for c in values for k in [*range(folds), *([-1] if whole else [])]],
                         est.fit(data.packed, data.size, wanted, lambda: data.by_feature)))
        models = judged = [found[x] for x in each]
    accuracy = np.array(LN.fold_accuracy(data.packed, judged, [k for _, k in each])).reshape(len(values), folds).mean(axis=1)
    best = int(accuracy.argmax())
    if isinstance(est, NB.BayesLearner):
        final = models[len(each) + best]
    else:
        final = found[values[best], -1] if whole else est.fit(data.packed, data.size, [(values[best], -1)], lambda: data.by_feature)[0]
    return final, float(accuracy[best]), models[best * folds:(best + 1) * folds]


def train_model(train: DataFrame, test: DataFrame, spec: LearnerSpec, folds: int = 3,
                id_col: str = "article_id") -> tuple[object, dict, DataFrame]:
    """Grid search + refit + test scoring.  ``train``/``test`` carry
    ``features`` (vector) and ``label``.  Returns (best model, report, predictions)."""
    return _trained(TrainingRows(train, folds, id_col), test, spec)[:3]


def _trained(data: TrainingRows, test: DataFrame, spec: LearnerSpec) -> tuple:
    """What ``train_model`` returns, and the best setting's model without each fold."""
    best, val, parts = _best_of(data, spec.make(), spec.grid)
    pred = with_prob(best.transform(test.withColumn("label", F.col("label").cast("double"))))
    cm = EV.confusion_matrix(pred).collect()[0]
    total = cm["tp"] + cm["fn"] + cm["fp"] + cm["tn"]
    report = {"learner": spec.name, "params": _describe_params(best, spec.grid),
              "val_accuracy": val, "test_accuracy": (cm["tp"] + cm["tn"]) / total if total else 0.0,
              "tp": cm["tp"], "fn": cm["fn"], "fp": cm["fp"], "tn": cm["tn"], "n_train": len(data.by_feature.y) if "by_feature" in vars(data) else data.rows.count(), "n_test": total}
    return best, report, pred, parts


def variable_importance(model) -> np.ndarray | None:
    """Linear coefficients, tree importances, NB log-probabilities of class 1."""
    if hasattr(model, "coefficients"):
        return model.coefficients.toArray()
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "theta"):
        return model.theta.toArray()[1]
    return None


def importance_frame(spark: SparkSession, model, names: DataFrame, k: int | None = None) -> DataFrame | None:
    """(feature, weight) of a fitted model joined to the name table (M12); with
    ``k`` only the ``k`` largest weights and all that tie with the last of them."""
    imp = variable_importance(model)
    if imp is None:
        return None
    at = np.arange(len(imp))
    if k is not None and k < len(imp):
        at = np.flatnonzero(~(imp < np.partition(imp, len(imp) - k)[len(imp) - k]))
    w = spark.createDataFrame([(int(i), float(imp[i])) for i in at], "idx INT, weight DOUBLE")
    return w.join(names, "idx").select("feature", "weight")


def soft_vote_models(models: list, test: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Soft voting over fitted members: long form of member probabilities,
    averaged per row (M9)."""
    parts = []
    for i, m in enumerate(models):
        p = with_prob(m.transform(test)).select(id_col, F.lit(i).alias("member"), "prob_1")
        parts.append(p)
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    votes = EV.soft_vote(long, id_col)
    return votes.join(test.select(id_col, "label"), id_col)


def reports_frame(spark: SparkSession, reports: list[dict]) -> DataFrame:
    schema = ("learner STRING, params STRING, val_accuracy DOUBLE, test_accuracy DOUBLE, tp BIGINT, fn BIGINT, "
              "fp BIGINT, tn BIGINT, n_train BIGINT, n_test BIGINT")
    cols = ["learner", "params", "val_accuracy", "test_accuracy", "tp", "fn", "fp", "tn", "n_train", "n_test"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in reports], schema)


def compare_learners(train: DataFrame, test: DataFrame, specs: list[LearnerSpec] | None = None,
                     id_col: str = "article_id", folds: int = 3) -> tuple[list[dict], list]:
    """All learners on one dataset, then a soft-voting ensemble of the first four: members fitted on the same training
    rows for the test, and without each fold for its cross-validated accuracy (M15, M9)."""
    specs = specs or learner_specs()
    reports, models, without, data = [], [], [], TrainingRows(train, folds, id_col)
    for s in specs:
        m, r, _, parts = _trained(data, test, s)
        reports.append(r)
        models.append(m)
        without.append(parts)
    held = [_vote_counts([parts[k] for parts in without[:4]], data.rows.where(F.col("fold") == k), id_col) for k in range(folds)]
    shares = [(c["tp"] + c["tn"]) / n for c in held if (n := c["tp"] + c["fn"] + c["fp"] + c["tn"])]
    cm = _vote_counts(models[:4], test.withColumn("label", F.col("label").cast("double")), id_col)
    total = cm["tp"] + cm["fn"] + cm["fp"] + cm["tn"]
    reports.append({"learner": "Voting Classifier", "params": "{}", "val_accuracy": float(np.mean(shares)) if shares else float("nan"),
                    "test_accuracy": (cm["tp"] + cm["tn"]) / total if total else 0.0,
                    "tp": cm["tp"], "fn": cm["fn"], "fp": cm["fp"], "tn": cm["tn"],
                    "n_train": reports[0]["n_train"], "n_test": total})
    return reports, models


def _vote_counts(models: list, rows: DataFrame, id_col: str):
    LN.make_weights(models)
    return EV.confusion_matrix(soft_vote_models(models, rows, id_col)).collect()[0]
