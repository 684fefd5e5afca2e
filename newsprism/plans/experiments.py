"""Experiment analytics (X1-X4) over the naive Bayes feature-set sweep,
which Spark derives from the given tables."""

from __future__ import annotations

from itertools import combinations

from ..operators import experiments as EX
from ..session import cut_lineage, scratch_path
from ..sources import io as IO
from .catalog import register
from .learning import BIN_COLUMNS, nb_sweep, nb_sweep_sql


def results(spark, sf, bins: bool = False):
    """The sweep results table (reused by every report: materialised once)."""
    return cut_lineage(nb_sweep(spark, sf, bins=bins))


@register("interaction_features", sql=lambda: nb_sweep_sql(
    "SELECT classifier, setting, test_accuracy, " + ", ".join(EX.FLAGS) + ", "
    + ", ".join(f"{a} * {b} AS {a}x{b}" for a, b in combinations(EX.FLAGS, 2)) + " FROM res"))
def interaction_features(spark, sf):
    return EX.interaction_features(results(spark, sf).select("classifier", "setting", "test_accuracy", *EX.FLAGS))


def _surface_sql():
    long = " UNION ALL ".join(f"SELECT classifier, test_accuracy, '{f}' AS feature, {f} AS flag FROM res" for f in EX.FLAGS)
    return nb_sweep_sql(f"""
, lg AS ({long})
, pc AS (SELECT classifier, avg(test_accuracy) AS cm, count(*) AS ns FROM res GROUP BY classifier)
, sm AS (SELECT classifier, feature, sum(CASE WHEN flag = 1 THEN test_accuracy ELSE 0.0 END) AS sw,
                sum(CASE WHEN flag = 0 THEN test_accuracy ELSE 0.0 END) AS swo FROM lg GROUP BY classifier, feature)
, ef AS (SELECT sm.classifier, sm.feature, round((sw - swo) / ns + cm, 6) AS effect FROM sm JOIN pc ON sm.classifier = pc.classifier)
, fr AS (SELECT feature, row_number() OVER (ORDER BY round(avg(effect), 6) DESC, feature) AS feature_rank FROM ef GROUP BY feature)
, cr AS (SELECT classifier, row_number() OVER (ORDER BY round(cm, 6) DESC, classifier) AS classifier_rank FROM pc)
SELECT ef.classifier, ef.feature, ef.effect, fr.feature_rank, cr.classifier_rank
FROM ef JOIN fr ON ef.feature = fr.feature JOIN cr ON ef.classifier = cr.classifier
ORDER BY feature_rank, classifier_rank""")


@register("response_surface", sql=_surface_sql)
def response_surface(spark, sf):
    return EX.response_surface(results(spark, sf))


@register("accuracy_slopes", sql=lambda: nb_sweep_sql("""
SELECT classifier, round(regr_slope(test_accuracy, CAST(tfidf AS DOUBLE)), 6) + 0.0::DOUBLE AS slope,
       round(regr_intercept(test_accuracy, CAST(tfidf AS DOUBLE)), 6) + 0.0::DOUBLE AS intercept FROM res GROUP BY classifier"""))
def accuracy_slopes(spark, sf):
    # the results go through their file format
    path = scratch_path(spark, "results_csv")
    IO.write_csv(results(spark, sf).select(*[c.split()[0] for c in IO.RESULTS_SCHEMA.split(", ")]), path)
    return EX.flag_slopes(IO.read_results(spark, path), "tfidf")


@register("accuracy_ols")
def accuracy_ols(spark, sf):
    """OLS: test_accuracy ~ 0 + classifier + flags, with standard errors."""
    return EX.accuracy_ols(results(spark, sf))


@register("parse_training_log", sql=lambda: nb_sweep_sql("""
SELECT replace(regexp_extract(classifier, '^([^=]+?)(?: alpha=.*)?$', 1), ' ', '') AS classifier,
       '''alpha'': ' || regexp_extract(classifier, 'alpha=(.*)$', 1) AS params, """ + ", ".join(EX.FLAGS) + """,
       CAST(NULL AS DOUBLE) AS val_accuracy, test_accuracy, tp, fn, fp, tn, """ + ", ".join(BIN_COLUMNS) + " FROM resb", bins=True))
def parse_training_log(spark, sf):
    """Render the sweep with its probability bins as a training log in the shared folder (S10), read it
    back as text and parse it into one row per learner run, 46 columns (X1)."""
    path = scratch_path(spark, "training_log")
    EX.write_training_log(EX.format_training_log(results(spark, sf, bins=True)), path)
    return EX.parse_training_log(EX.read_training_log(spark, path)).drop("file")
