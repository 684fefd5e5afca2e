"""Multinomial naive Bayes as DataFrame aggregates (M7, SQL form).

Train on long-form features ``(id, feature, value)`` with labels; every
step is a grouping or an equi-join, so it runs at any scale and has an exact
SQL twin:

* prior_c   = ln(n_c / n)                                  (unsmoothed prior)
* theta_cf  = (S_cf + alpha) / (T_c + alpha * |V|)          S = per-class sums
* score_c(d)= prior_c + sum_f x_df ln theta_cf;  features of d absent from
  class c use ln(alpha / (T_c + alpha |V|))
* prediction = arg max, ties to class 0; P(1|d) = 1 / (1 + e^(score_0 - score_1))

``|V|`` counts the features of the whole matrix (fitted on all rows, as the
studied pipeline does).  A ``group`` key (e.g. a sweep setting) trains one
independent model per key in the same job; without one, a constant key is
used.  Per-group class tables hold two rows per group and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ONE = "_model"


def _keys(df: DataFrame, group: list[str] | None) -> tuple[DataFrame, list[str]]:
    if group:
        return df, list(group)
    return df.withColumn(_ONE, F.lit(0)), [_ONE]


def train(features: DataFrame, labels: DataFrame, id_col: str = "article_id", alpha: float = 1.0,
          group: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Return (class_table, theta_table, keys).

    ``labels``: (id, label[, group..]) training rows.  ``features``:
    (id, feature, value[, group..]) of all rows (train and test).
    class_table: (keys.., label, log_prior, log_default); theta_table:
    (keys.., feature, lt0, lt1) for features seen in training.
    """
    features, g = _keys(features, group)
    labels, _ = _keys(labels, group)
    v_size = features.select(*g, "feature").distinct().groupBy(*g).agg(F.count(F.lit(1)).alias("_v"))
    counts = labels.groupBy(*g, "label").agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.groupBy(*g).agg(F.sum("_nc").alias("_n"))
    train_feats = features.join(labels.select(id_col, *g, "label"), [id_col, *g])
    sums = train_feats.groupBy(*g, "label", "feature").agg(F.sum("value").alias("_s"))
    tot_c = sums.groupBy(*g, "label").agg(F.sum("_s").alias("_t"))
    cls = counts.join(totals, g).join(tot_c, [*g, "label"], "left").join(v_size, g)
    denom = F.coalesce(F.col("_t"), F.lit(0.0)) + F.lit(alpha) * F.col("_v")
    cls = cls.select(*g, "label", F.log(F.col("_nc") / F.col("_n")).alias("log_prior"),
                     F.log(F.lit(alpha) / denom).alias("log_default"), denom.alias("_denom"))
    theta = sums.join(F.broadcast(cls.select(*g, "label", "_denom")), [*g, "label"]).select(
        *g, "feature", "label", F.log((F.col("_s") + F.lit(alpha)) / F.col("_denom")).alias("lt"))
    theta = theta.groupBy(*g, "feature").agg(
        F.max(F.when(F.col("label") == 0, F.col("lt"))).alias("lt0"),
        F.max(F.when(F.col("label") == 1, F.col("lt"))).alias("lt1"))
    return cls.drop("_denom"), theta, g


def _class_pairs(cls: DataFrame, g: list[str]) -> DataFrame:
    return cls.groupBy(*g).agg(
        F.max(F.when(F.col("label") == 0, F.col("log_prior"))).alias("p0"),
        F.max(F.when(F.col("label") == 0, F.col("log_default"))).alias("d0"),
        F.max(F.when(F.col("label") == 1, F.col("log_prior"))).alias("p1"),
        F.max(F.when(F.col("label") == 1, F.col("log_default"))).alias("d1"))


def predict(features: DataFrame, rows: DataFrame, model, id_col: str = "article_id",
            group: list[str] | None = None) -> DataFrame:
    """Scores for ``rows`` (id[, group..], label, ...): adds score_0, score_1,
    prediction, prob_1.  Rows without features get the prior only."""
    cls, theta, g = model
    features, _ = _keys(features, group)
    rows, _ = _keys(rows, group)
    cc = F.broadcast(_class_pairs(cls, g))
    feats = features.join(rows.select(id_col, *g), [id_col, *g], "left_semi")
    j = feats.join(theta, [*g, "feature"], "left").join(cc, g)
    like = j.groupBy(id_col, *g).agg(
        F.sum(F.col("value") * F.coalesce(F.col("lt0"), F.col("d0"))).alias("_l0"),
        F.sum(F.col("value") * F.coalesce(F.col("lt1"), F.col("d1"))).alias("_l1"))
    out = rows.join(like, [id_col, *g], "left").join(cc, g)
    s0 = F.coalesce(F.col("p0"), F.lit(float("-inf"))) + F.coalesce(F.col("_l0"), F.lit(0.0))
    s1 = F.coalesce(F.col("p1"), F.lit(float("-inf"))) + F.coalesce(F.col("_l1"), F.lit(0.0))
    out = (out.withColumn("score_0", s0).withColumn("score_1", s1)
           .withColumn("prediction", F.when(F.col("score_1") > F.col("score_0"), 1).otherwise(0))
           .withColumn("prob_1", F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("score_0") - F.col("score_1"))))
           .drop("p0", "p1", "d0", "d1", "_l0", "_l1"))
    return out if group else out.drop(_ONE)


def positive_log_probs(model) -> DataFrame:
    """(keys.., feature, weight) = ln P(feature | class 1), the importance used for NB."""
    cls, theta, g = model
    d1 = F.broadcast(cls.where(F.col("label") == 1).select(*g, F.col("log_default").alias("d1")))
    out = theta.join(d1, g).select(*g, "feature", F.coalesce(F.col("lt1"), F.col("d1")).alias("weight"))
    return out.drop(_ONE) if _ONE in g else out
