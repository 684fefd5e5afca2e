"""Scoring of predictions (M9-M14, G10): confusion matrix, accuracy,
probability bins, example rows, top features, soft voting.

All functions take a predictions DataFrame with ``label``, ``prediction``
and, where needed, ``prob_1``; they aggregate (partial aggregation first) and
never collect rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def confusion_matrix(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Label order [1, 0]: TP, FN (first row), FP, TN (second row), on the full
    2 x 2 grid (zeros included) (M10)."""
    g = group or []
    lab, pr = F.col("label").cast("int"), F.col("prediction").cast("int")
    return pred.groupBy(*g).agg(
        F.count_if((lab == 1) & (pr == 1)).alias("tp"), F.count_if((lab == 1) & (pr == 0)).alias("fn"),
        F.count_if((lab == 0) & (pr == 1)).alias("fp"), F.count_if((lab == 0) & (pr == 0)).alias("tn"))


def accuracy(pred: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Share of rows with prediction = label."""
    g = group or []
    return pred.groupBy(*g).agg(
        F.round(F.avg((F.col("label").cast("int") == F.col("prediction").cast("int")).cast("double")), 6).alias("accuracy"),
        F.count(F.lit(1)).alias("n"))


def probability_bins(pred: DataFrame, bins: int = 10, threshold: float = 0.5,
                     prob_col: str = "prob_1") -> DataFrame:
    """Equal-width bins over the observed [min, max] of the probabilities,
    right-closed, lowest edge lowered by 0.1 percent of the range; bin names
    0.0 .. 0.9; per bin ones, zeros and accuracy (zeros/n below the threshold,
    else ones/n; 0.0 when empty); all bins listed (M14, G10).

    Edges are computed once as min + k * step (the way an evenly spaced grid
    is built), so values on an edge fall in the lower bin."""
    p = F.col(prob_col)
    pred = pred.where(p.isNotNull())  # a learner without probabilities fills no bin
    mn, mx = pred.agg(F.min(p)).scalar(), pred.agg(F.max(p)).scalar()
    same = mn == mx
    lo = F.when(same, mn - F.when(mn == 0, F.lit(0.001)).otherwise(F.abs(mn) * 0.001)).otherwise(mn)
    hi = F.when(same, mx + F.when(mx == 0, F.lit(0.001)).otherwise(F.abs(mx) * 0.001)).otherwise(mx)
    step = (hi - lo) / bins
    edges = [lo + F.lit(k) * step for k in range(bins)] + [hi]
    # the lowest edge is widened after the grid is built, as the studied code
    # does; it never decides a bin, so bins test only the upper edges
    b = F.when(p <= edges[1], 0)
    for k in range(2, bins):
        b = b.when(p <= edges[k], k - 1)
    b = b.otherwise(bins - 1)
    per = pred.select(b.alias("bin"), F.col("label").cast("int").alias("label")).groupBy("bin").agg(
        F.count_if(F.col("label") == 1).alias("ones"), F.count(F.lit(1)).alias("n"))
    all_bins = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(F.broadcast(per), "bin", "left").select(
        F.round(F.col("bin") / F.lit(bins), 1).alias("bin_label"),
        F.coalesce("ones", F.lit(0)).cast("long").alias("ones"),
        (F.coalesce("n", F.lit(0)) - F.coalesce("ones", F.lit(0))).cast("long").alias("zeros"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    acc = (F.when(F.col("n") == 0, F.lit(0.0))
           .when(F.col("bin_label") < threshold, F.col("zeros") / F.col("n"))
           .otherwise(F.col("ones") / F.col("n")))
    return out.select("bin_label", "ones", "zeros", F.round(acc, 6).alias("accuracy")).orderBy(F.desc("bin_label"))


def outcome(label, prediction):
    lab, pr = F.col(label).cast("int"), F.col(prediction).cast("int")
    return (F.when((lab == 1) & (pr == 1), "TP").when((lab == 0) & (pr == 1), "FP")
            .when((lab == 0) & (pr == 0), "TN").otherwise("FN"))


def outcome_examples(pred: DataFrame, k: int = 5, shown: DataFrame | None = None, id_col: str = "article_id") -> DataFrame:
    """Up to ``k`` example rows per outcome (TP, FP, TN, FN) with title, url
    and a 150-character preview, chosen by md5 of the id (M13).  The
    ``row_number() <= k`` filter is planned as a per-partition group limit
    before the shuffle, so only k rows per outcome and task move.  ``shown``
    (id, title, url, text) is joined to the chosen rows only; without it
    ``pred`` carries those columns."""
    w = Window.partitionBy("outcome").orderBy(F.md5(F.col(id_col).cast("string")), F.col(id_col))
    told = pred.withColumn("outcome", outcome("label", "prediction"))
    if shown is None:
        shown = pred.select(id_col, "title", "url", "text")
    chosen = told.select(id_col, "outcome").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # at most 4 k rows
    return shown.join(F.broadcast(chosen), id_col).select(id_col, "outcome", "title", "url", T.preview("text").alias("preview"), "rank")


def top_features(weights: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` largest signed weights, descending; ties by name."""
    return weights.orderBy(F.desc("weight"), F.asc("feature")).limit(n)


def soft_vote(member_probs: DataFrame, id_col: str = "article_id", threshold: float = 0.5) -> DataFrame:
    """Mean of member probabilities of class 1, then arg max (M9).  Input is
    long form (id, member, prob_1); a grouping, not a join per member."""
    return (member_probs.groupBy(id_col).agg(F.avg("prob_1").alias("prob_1"), F.count(F.lit(1)).alias("n_members"))
            .withColumn("prediction", F.when(F.col("prob_1") > threshold, 1).otherwise(0)))
