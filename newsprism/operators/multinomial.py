"""Multinomial naive Bayes over packed rows (M7, model form): the class sums of every fold in one pass.

A model's sums are those of all rows less its left-out fold's, so a grid of smoothing values on every fold costs one pass,
and its accuracies one more.  Log-odds are linear in the features: ``margin`` = ln P(1|x) - ln P(0|x).  Priors are smoothed like the
features, as MLlib's are."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame

from . import blocks as BL
from . import linear as LN


@dataclass
class BayesModel:
    """A fitted model: log prior of each class, and log probabilities of the features in each."""
    alpha: float
    prior: np.ndarray
    log_probability: np.ndarray   # (2, features)

    @property
    def theta(self) -> DenseMatrix:
        return DenseMatrix(*self.log_probability.shape, self.log_probability.ravel(), True)

    def linear(self) -> LN.LinearModel:
        with np.errstate(invalid="ignore"):
            bias = self.prior[1] - self.prior[0]
        return LN.LinearModel("logistic", self.alpha, self.log_probability[1] - self.log_probability[0], float(bias), 0.0)

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.linear().transform(rows)


@dataclass
class BayesLearner:
    def fit(self, packed: DataFrame, size: int, folds: int, models: list[tuple[float, int]]) -> list[BayesModel]:
        """One model per (alpha, fold that is left out, -1: none)."""
        def sums(out, raw):
            off, index, value = BL.entries(raw)
            if len(value) and value.min() < 0:
                raise ValueError("naive Bayes needs features that are not negative")
            group = 2 * np.frombuffer(raw["fold"], np.int32) + (np.frombuffer(raw["y"]) > 0)
            of = np.repeat(group, np.diff(off))
            for g in range(2 * folds):
                mine = of == g
                if mine.any():
                    feature, place = np.unique(index[mine], return_inverse=True)
                    out[feature, g] += np.bincount(place, value[mine])
            out[size] += np.bincount(group, minlength=2 * folds)

        found = BL.summed(packed, sums, size + 1, 2 * folds)
        out = []
        for alpha, skip in models:
            kept = [k for k in range(folds) if k != skip]
            total = np.stack([sum(found[:, 2 * k + c] for k in kept) for c in (0, 1)])
            rows, weight = total[:, size], total[:, :size]
            there = rows > 0   # a class without rows is never predicted
            prior = np.where(there, np.log(np.maximum(rows + alpha, 1e-300)) - np.log(rows.sum() + there.sum() * alpha), -np.inf)
            out.append(BayesModel(alpha, prior, np.log(weight + alpha) - np.log(weight.sum(axis=1, keepdims=True) + size * alpha)))
        return out
