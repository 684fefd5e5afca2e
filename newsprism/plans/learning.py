"""Model training and evaluation.

SQL-form naive Bayes queries (``nb_*``) have exact DuckDB twins; The model
learners (``train_*``, ``grid_search``, ``compare_learners``, ...) are
checked on rows only and by property tests.
"""

from __future__ import annotations

from functools import reduce

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as EV
from ..operators import models as MD
from ..operators import nbayes as NB
from ..operators import vectors as VEC
from ..operators.featureset import SWEEP_OPTIONS, FeatureOptions
from ..operators.splits import split_by_date, train_test_split
from ..session import cut_lineage
from ..sources import views as V
from . import sqllearning as SL
from .catalog import register
from .features import full_features

NB_ALPHAS = [0.1, 1.0, 10.0, 100.0]


def nb_inputs(spark, sf, opts: FeatureOptions = SWEEP_OPTIONS):
    """(features of the fitting set, split rows of the labelled articles).

    The long-form features are read by training, scoring and every report,
    so they are written once to the shared folder instead of being recomputed
    from the text per reference.  Rows carry no text."""
    feats = cut_lineage(full_features(spark, sf, opts).select("article_id", "family", "feature", "value"))
    rows = train_test_split(V.labelled_articles(spark, sf)).select("article_id", "label", "split")
    return feats, rows


def nb_predictions(spark, sf, alpha: float = 1.0) -> DataFrame:
    """Test-row predictions: id, label and scores, written for the reports."""
    feats, rows = nb_inputs(spark, sf)
    model = NB.train(feats, rows.where(F.col("split") == "train").select("article_id", "label"), alpha=alpha)
    return cut_lineage(NB.predict(feats, rows.where(F.col("split") == "test").drop("split"), model))


def _nb_sql(final: str, alpha: float = 1.0) -> str:
    ctes = SL.sweep_feature_ctes() + [SL.SPLIT_CTE,
                                      "tr AS (SELECT article_id, label FROM sp WHERE split = 'train')",
                                      "te AS (SELECT article_id, label, title, url, text FROM sp WHERE split = 'test')"]
    ctes += SL.nb_ctes(alpha)
    ctes.append(f"pred AS (SELECT p.article_id, p.label, {SL.PRED_SELECT} FROM nb_pred p)")
    return V.with_articles(",\n" + ",\n".join(ctes) + "\n" + final)


@register("nb_predictions", sql=lambda: _nb_sql(
    "SELECT article_id, label, prediction, round(prob_1, 6) AS prob_1 FROM pred"))
def nb_predictions_q(spark, sf):
    return nb_predictions(spark, sf).select("article_id", "label", "prediction", F.round("prob_1", 6).alias("prob_1"))


@register("nb_confusion_matrix", sql=lambda: _nb_sql("""
SELECT CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp, CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn,
       CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp, CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn FROM pred"""))
def nb_confusion_matrix(spark, sf):
    return EV.confusion_matrix(nb_predictions(spark, sf))


@register("nb_accuracy", sql=lambda: _nb_sql(
    "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pred"))
def nb_accuracy(spark, sf):
    return EV.accuracy(nb_predictions(spark, sf))


_BINS_SQL = """
, bd AS (SELECT min(prob_1) AS mn, max(prob_1) AS mx FROM pred)
, ed AS (SELECT CASE WHEN mn = mx THEN mn - CASE WHEN mn = 0 THEN 0.001 ELSE abs(mn) * 0.001 END ELSE mn END AS lo,
                CASE WHEN mn = mx THEN mx + CASE WHEN mx = 0 THEN 0.001 ELSE abs(mx) * 0.001 END ELSE mx END AS hi FROM bd)
, bn AS (SELECT p.label, CASE {cases} ELSE 9 END AS bin FROM pred p CROSS JOIN ed)
, per AS (SELECT bin, count_if(label = 1) AS ones, count(*) AS n FROM bn GROUP BY bin)
, allb AS (SELECT CAST(b AS INTEGER) AS bin FROM range(0, 10) t(b))
, o AS (SELECT round(a.bin / 10, 1) AS bin_label, CAST(coalesce(per.ones, 0) AS BIGINT) AS ones,
               CAST(coalesce(per.n, 0) - coalesce(per.ones, 0) AS BIGINT) AS zeros, coalesce(per.n, 0) AS n
        FROM allb a LEFT JOIN per ON a.bin = per.bin)
SELECT bin_label, ones, zeros,
       round(CASE WHEN n = 0 THEN 0.0 WHEN bin_label < 0.5 THEN zeros / n ELSE ones / n END, 6) AS accuracy
FROM o ORDER BY bin_label DESC"""


def _bins_sql() -> str:
    cases = " ".join(f"WHEN p.prob_1 <= (CASE WHEN {k} = 10 THEN hi ELSE lo + {k}.0 * ((hi - lo) / 10) END) THEN {k - 1}"
                     for k in range(1, 10))
    return _BINS_SQL.replace("{cases}", cases)


@register("nb_probability_bins", sql=lambda: _nb_sql(_bins_sql()))
def nb_probability_bins(spark, sf):
    return EV.probability_bins(nb_predictions(spark, sf))


@register("nb_outcome_examples", sql=lambda: _nb_sql("""
, ex AS (SELECT p.article_id, CASE WHEN p.label = 1 AND p.prediction = 1 THEN 'TP' WHEN p.label = 0 AND p.prediction = 1 THEN 'FP'
                                   WHEN p.label = 0 AND p.prediction = 0 THEN 'TN' ELSE 'FN' END AS outcome,
                te.title, te.url, substr(replace(te.text, chr(10), ' '), 1, 150) AS preview
         FROM pred p JOIN te ON p.article_id = te.article_id)
, rk AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY md5(CAST(article_id AS VARCHAR)), article_id) AS rank FROM ex)
SELECT article_id, outcome, title, url, preview, rank FROM rk WHERE rank <= 5"""))
def nb_outcome_examples(spark, sf):
    return EV.outcome_examples(nb_predictions(spark, sf), 5, _shown(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


@register("nb_top_features", sql=lambda: _nb_sql("""
, w AS (SELECT th.feature, coalesce(th.lt1, cc.d1) AS weight FROM nb_theta th CROSS JOIN nb_cc cc)
SELECT feature, round(weight, 6) AS weight FROM w ORDER BY weight DESC, feature LIMIT 50"""))
def nb_top_features(spark, sf):
    feats, rows = nb_inputs(spark, sf)
    model = NB.train(feats, rows.where(F.col("split") == "train").select("article_id", "label"))
    top = EV.top_features(NB.positive_log_probs(model), 50)
    return top.select("feature", F.round("weight", 6).alias("weight"))


@register("nb_soft_vote", sql=lambda: V.with_articles(",\n" + ",\n".join(
    SL.sweep_feature_ctes() + [SL.SPLIT_CTE,
                               "tr AS (SELECT article_id, label FROM sp WHERE split = 'train')",
                               "te AS (SELECT article_id, label FROM sp WHERE split = 'test')"]
    + sum((SL.nb_ctes(a, prefix=f"nb{i}") for i, a in enumerate(NB_ALPHAS)), [])
    + ["votes AS (" + " UNION ALL ".join(
        f"SELECT article_id, label, 1.0 / (1.0 + exp(s0 - s1)) AS prob_1 FROM nb{i}_pred" for i in range(len(NB_ALPHAS))) + ")"])
    + """
SELECT article_id, round(avg(prob_1), 6) AS prob_1, CASE WHEN avg(prob_1) > 0.5 THEN 1 ELSE 0 END AS prediction,
       count(*) AS n_members
FROM votes GROUP BY article_id"""))
def nb_soft_vote(spark, sf):
    """Soft voting over naive Bayes members with the four smoothing values."""
    feats, rows = nb_inputs(spark, sf)
    train, test = rows.where(F.col("split") == "train").select("article_id", "label"), rows.where(F.col("split") == "test")
    members = []
    for i, a in enumerate(NB_ALPHAS):
        p = NB.predict(feats, test.select("article_id", "label"), NB.train(feats, train, alpha=a))
        members.append(p.select("article_id", F.lit(i).alias("member"), "prob_1"))
    votes = EV.soft_vote(reduce(DataFrame.unionByName, members))
    return votes.select("article_id", F.round("prob_1", 6).alias("prob_1"), "prediction", "n_members")


# ------------------------------------------------------------------ sweep

def sweep_settings(spark, families=None) -> DataFrame:
    """Non-empty subsets of the built families as (setting, family); 2^k - 1
    settings from ``range`` + bit tests (J7)."""
    fams = families or [f for f, _ in SL.SWEEP_FAMILIES]
    k = len(fams)
    s = spark.range(1, 2 ** k).select(F.col("id").cast("int").alias("setting"))
    arr = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("family")) for i, f in enumerate(fams)])
    ex = s.select("setting", F.inline(arr))
    bit = F.expr(f"shiftright(setting, {k - 1} - i) & 1")
    return ex.where(bit == 1).select("setting", "family")


BIN_COLUMNS = [f"{kind}_{b}" for kind in ("ones", "zeros", "acc") for b in range(10)]


def _bin_counts(pred: DataFrame) -> DataFrame:
    """(classifier, setting, 30 bin columns) of (classifier, setting, label, prob_1): ten equal bins over each run's own
    range of probabilities, ones and zeros in them, and the accuracy per bin (M14)."""
    run = ["classifier", "setting"]
    edges = pred.groupBy(*run).agg(F.min("prob_1").alias("mn"), F.max("prob_1").alias("mx")).select(
        *run, F.when(F.col("mn") == F.col("mx"), F.col("mn") - F.when(F.col("mn") == 0, 0.001).otherwise(F.abs("mn") * 0.001))
        .otherwise(F.col("mn")).alias("lo"),
        F.when(F.col("mn") == F.col("mx"), F.col("mx") + F.when(F.col("mx") == 0, 0.001).otherwise(F.abs("mx") * 0.001))
        .otherwise(F.col("mx")).alias("hi"))
    step = (F.col("hi") - F.col("lo")) / 10
    place = F.lit(9)
    for b in range(8, -1, -1):
        place = F.when(F.col("prob_1") <= F.col("lo") + F.lit(b + 1) * step, b).otherwise(place)
    binned = pred.join(F.broadcast(edges), run).select(*run, "label", place.alias("bin"))  # edges: a row a run
    counts = binned.groupBy(*run).agg(
        *[F.count_if((F.col("bin") == b) & (F.col("label") == 1)).alias(f"ones_{b}") for b in range(10)],
        *[F.count_if((F.col("bin") == b) & (F.col("label") == 0)).alias(f"zeros_{b}") for b in range(10)])
    n = {b: F.col(f"ones_{b}") + F.col(f"zeros_{b}") for b in range(10)}
    return counts.select("*", *[F.when(n[b] == 0, 0.0).otherwise(F.round(F.col(f"{'zeros' if b < 5 else 'ones'}_{b}") / n[b], 6)).alias(f"acc_{b}")
                                for b in range(10)])


def nb_sweep(spark, sf, alphas=None, bins: bool = False) -> DataFrame:
    """Feature-set sweep with SQL-form naive Bayes, one model per (setting,
    alpha), all in one pass over the features.

    Per-class feature sums do not depend on the setting; only the
    denominator T_c(s) + alpha |V(s)| does, and it is a sum of per-family
    terms.  So ln theta = ln(S + alpha) - ln D_c(s) splits into a per-family
    part, aggregated once per (document, family), and a per-setting part: the
    2^k - 1 settings are combined on those small aggregates, never by fanning
    the feature rows out per setting.  Output is the results table (D18), with ``bins``
    also the ten probability bins of every run."""
    alphas = alphas or NB_ALPHAS
    feats, rows = nb_inputs(spark, sf)
    settings = F.broadcast(sweep_settings(spark))
    n_set = 2 ** len(SL.SWEEP_FAMILIES) - 1
    train = rows.where(F.col("split") == "train").select("article_id", "label")
    test = rows.where(F.col("split") == "test").select("article_id", "label")
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("_nc"))
    n_train = train.agg(F.count(F.lit(1))).scalar()
    prior = {r["label"]: r["_p"] for r in counts.select("label", F.log(F.col("_nc") / n_train).alias("_p")).collect()}
    fam_v = feats.select("family", "feature").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("_v"))
    sums = cut_lineage(feats.join(train, "article_id").groupBy("family", "label", "feature")
                       .agg(F.sum("value").alias("_s")))
    fam_t = sums.groupBy("family", "label").agg(F.sum("_s").alias("_t"))
    fam_tl = fam_v.select("family", "_v", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    fam_tl = fam_tl.join(fam_t, ["family", "label"], "left").fillna(0.0, ["_t"])
    den_parts = settings.join(fam_tl, "family").groupBy("setting", "label").agg(
        F.sum("_t").alias("_T"), F.sum("_v").alias("_V"))
    test_feats = feats.join(test.select("article_id"), "article_id", "left_semi")
    set_ids = F.explode(F.array(*[F.lit(i) for i in range(1, n_set + 1)]))
    # one aggregation for all alphas: a column for each alpha and class
    per_class = sums.groupBy("family", "feature").agg(*[F.max(F.when(F.col("label") == c, F.col("_s"))).alias(f"_s{c}") for c in (0, 1)])
    each = [(i, c) for i in range(len(alphas)) for c in (0, 1)]

    def log_sum(i: int, c: int):
        """ln(S + alpha); a feature without rows of the class counts alpha alone."""
        return F.coalesce(F.log(F.col(f"_s{c}") + float(alphas[i])), F.lit(float(np.log(alphas[i]))))

    per_fam = (test_feats.join(per_class, ["family", "feature"], "left").groupBy("article_id", "family")
               .agg(*[F.sum(F.col("value") * log_sum(i, c)).alias(f"_a{i}{c}") for i, c in each], F.sum("value").alias("_b")))
    per_set = per_fam.join(settings, "family").groupBy("article_id", "setting").agg(
        *[F.sum(f"_a{i}{c}").alias(f"_a{i}{c}") for i, c in each], F.sum("_b").alias("_b"))
    den = den_parts.groupBy("setting").agg(
        *[F.max(F.when(F.col("label") == c, F.log(F.col("_T") + float(alphas[i]) * F.col("_V")))).alias(f"_ld{i}{c}") for i, c in each])
    j = test.withColumn("setting", set_ids).join(per_set, ["article_id", "setting"], "left").join(F.broadcast(den), "setting")
    b = F.coalesce("_b", F.lit(0.0))

    def score(i: int, c: int):
        return F.lit(prior.get(c, float("-inf"))) + F.coalesce(f"_a{i}{c}", F.lit(0.0)) - F.col(f"_ld{i}{c}") * b

    scores = F.array(*[F.struct(F.lit(f"Multinomial NB alpha={a}").alias("classifier"), score(i, 0).alias("s0"), score(i, 1).alias("s1"))
                       for i, a in enumerate(alphas)])
    pred = j.select("setting", "label", F.inline(scores)).select(
        "classifier", "setting", "label", F.when(F.col("s1") > F.col("s0"), 1).otherwise(0).alias("prediction"),
        (1.0 / (1.0 + F.exp(F.col("s0") - F.col("s1")))).alias("prob_1"))
    pred = cut_lineage(pred) if bins else pred.drop("prob_1")
    res = pred.groupBy("classifier", "setting").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("test_accuracy"),
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 0)).alias("fn"),
        F.count_if((F.col("label") == 0) & (F.col("prediction") == 1)).alias("fp"),
        F.count_if((F.col("label") == 0) & (F.col("prediction") == 0)).alias("tn"))
    res = res.join(_bin_counts(pred), ["classifier", "setting"]) if bins else res
    k = len(SL.SWEEP_FAMILIES)
    flags = {name: F.lit(0) for name in ("tags", "spell", "grammar", "word_count", "tfidf", "lsh", "title", "sentiment")}
    for i, (_, flag) in enumerate(SL.SWEEP_FAMILIES):
        flags[flag] = F.shiftright(F.col("setting"), k - 1 - i).bitwiseAND(1)
    return res.select("classifier", F.col("setting").cast("int").alias("setting"),
                      F.round("test_accuracy", 6).alias("test_accuracy"),
                      *[c.cast("int").alias(n) for n, c in flags.items()], "tp", "fn", "fp", "tn", *(BIN_COLUMNS if bins else []))


def _bin_sql(i: int) -> list[str]:
    """CTE ``nb{i}_bins`` (setting, 30 bin columns) of ``nb{i}_pred``."""
    cases = " ".join(f"WHEN prob_1 <= lo + {b + 1}.0 * ((hi - lo) / 10) THEN {b}" for b in range(9))
    counts = ", ".join(f"CAST(count_if(bin = {b} AND label = {v}) AS BIGINT) AS {kind}_{b}" for v, kind in ((1, "ones"), (0, "zeros")) for b in range(10))
    share = ", ".join(f"CASE WHEN ones_{b} + zeros_{b} = 0 THEN 0.0 ELSE round({'zeros' if b < 5 else 'ones'}_{b} / (ones_{b} + zeros_{b}), 6) END AS acc_{b}"
                      for b in range(10))
    return [f"nb{i}_pr AS (SELECT setting, label, 1.0 / (1.0 + exp(s0 - s1)) AS prob_1 FROM nb{i}_pred)",
            f"nb{i}_mm AS (SELECT setting, min(prob_1) AS mn, max(prob_1) AS mx FROM nb{i}_pr GROUP BY setting)",
            f"""nb{i}_ed AS (SELECT setting, CASE WHEN mn = mx THEN mn - CASE WHEN mn = 0 THEN 0.001 ELSE abs(mn) * 0.001 END ELSE mn END AS lo,
                        CASE WHEN mn = mx THEN mx + CASE WHEN mx = 0 THEN 0.001 ELSE abs(mx) * 0.001 END ELSE mx END AS hi FROM nb{i}_mm)""",
            f"nb{i}_bn AS (SELECT p.setting, label, CASE {cases} ELSE 9 END AS bin FROM nb{i}_pr p JOIN nb{i}_ed e ON p.setting = e.setting)",
            f"nb{i}_ct AS (SELECT setting, {counts} FROM nb{i}_bn GROUP BY setting)",
            f"nb{i}_bins AS (SELECT *, {share} FROM nb{i}_ct)"]


def nb_sweep_sql(final: str, bins: bool = False) -> str:
    ctes = SL.sweep_feature_ctes() + [SL.SPLIT_CTE, f"sfeat AS (SELECT st.setting, f.* FROM feat f JOIN {SL.sweep_settings_sql()} ON f.family = st.family)",
                                      "sids AS (SELECT DISTINCT setting FROM sfeat)",
                                      "tr AS (SELECT s.article_id, s.label, i.setting FROM sp s CROSS JOIN sids i WHERE s.split = 'train')",
                                      "te AS (SELECT s.article_id, s.label, i.setting FROM sp s CROSS JOIN sids i WHERE s.split = 'test')"]
    accs = []
    for i, a in enumerate(NB_ALPHAS):
        ctes += SL.nb_ctes(a, feat="sfeat", group="setting", prefix=f"nb{i}")
        pr = "(CASE WHEN s1 > s0 THEN 1 ELSE 0 END)"
        ctes += _bin_sql(i) if bins else []
        accs.append(f"SELECT 'Multinomial NB alpha={a}' AS classifier, setting, "
                    f"avg(CASE WHEN label = {pr} THEN 1.0 ELSE 0.0 END) AS acc, "
                    f"CAST(count_if(label = 1 AND {pr} = 1) AS BIGINT) AS tp, CAST(count_if(label = 1 AND {pr} = 0) AS BIGINT) AS fn, "
                    f"CAST(count_if(label = 0 AND {pr} = 1) AS BIGINT) AS fp, CAST(count_if(label = 0 AND {pr} = 0) AS BIGINT) AS tn "
                    f"FROM nb{i}_pred GROUP BY setting")
    k = len(SL.SWEEP_FAMILIES)
    fl = {n: "0" for n in ("tags", "spell", "grammar", "word_count", "tfidf", "lsh", "title", "sentiment")}
    for i, (_, flag) in enumerate(SL.SWEEP_FAMILIES):
        fl[flag] = f"(setting >> {k - 1 - i}) & 1"
    ctes.append("res AS (SELECT classifier, CAST(setting AS INTEGER) AS setting, round(acc, 6) AS test_accuracy, "
                + ", ".join(f"CAST({v} AS INTEGER) AS {n}" for n, v in fl.items())
                + ", tp, fn, fp, tn FROM (" + " UNION ALL ".join(accs) + "))")
    if bins:
        every = " UNION ALL ".join(f"SELECT 'Multinomial NB alpha={a}' AS classifier, * FROM nb{i}_bins" for i, a in enumerate(NB_ALPHAS))
        ctes.append(f"resb AS (SELECT res.*, {', '.join('b.' + c for c in BIN_COLUMNS)} FROM res JOIN ({every}) b "
                    "ON res.classifier = b.classifier AND res.setting = b.setting)")
    return V.with_articles(",\n" + ",\n".join(ctes) + "\n" + final)


@register("nb_feature_sweep", sql=lambda: nb_sweep_sql("SELECT * FROM res"))
def nb_feature_sweep(spark, sf):
    return nb_sweep(spark, sf)


# ------------------------------------------------------------------ time slices

TIME_WINDOWS = [("2017-03-01", "2017-03-02"), ("2017-03-01", "2017-03-08"), ("2017-03-01", "2017-03-15"),
                ("2017-03-01", "2017-03-22"), ("2017-03-01", "2017-03-29")]


def time_slice_rows(spark, sf, start: str, end: str, test_days: int | None = 1):
    """Window rows split at ``end``: train = dated before end; test = dated on
    ``end`` .. end + test_days (``test_days=None`` keeps the reference bound:
    only rows stamped exactly at the end midnight)."""
    hi = end if test_days is None else F.date_add(F.lit(end).cast("date"), test_days).cast("timestamp")
    arts = V.labelled_articles(spark, sf, start_date=start)
    if test_days is None:
        arts = arts.where(F.col("date") <= F.lit(end).cast("timestamp"))
    else:
        arts = arts.where(F.col("date") < hi)
    return split_by_date(arts, end)


@register("time_slice_counts", sql=V.with_articles("""
, w AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, TIMESTAMP '{s}', TIMESTAMP '{e}')" for i, (s, e) in enumerate(TIME_WINDOWS)) + """) AS t(window_id, ws, we))
SELECT CAST(w.window_id AS INTEGER) AS window_id, CAST(count_if(a.date < w.we) AS BIGINT) AS n_train,
       CAST(count_if(a.date >= w.we) AS BIGINT) AS n_test
FROM w LEFT JOIN labelled_articles a ON a.date >= w.ws AND a.date < w.we + INTERVAL 1 DAY
GROUP BY w.window_id"""))
def time_slice_counts(spark, sf):
    """Rows before and on the test day of every window, zeros for a window
    without rows: one scan, each row meets the few windows as an array."""
    day = F.expr("INTERVAL 1 DAY")
    windows = F.array(*[F.struct(F.lit(i).alias("window_id"), F.lit(s).cast("timestamp").alias("ws"),
                                 F.lit(e).cast("timestamp").alias("we")) for i, (s, e) in enumerate(TIME_WINDOWS)])
    rows = V.labelled_articles(spark, sf).select("date", F.explode(windows).alias("w"))
    rows = rows.where((F.col("date") >= F.col("w.ws")) & (F.col("date") < F.col("w.we") + day))
    counts = rows.groupBy(F.col("w.window_id").alias("window_id")).agg(
        F.count_if(F.col("date") < F.col("w.we")).alias("n_train"), F.count_if(F.col("date") >= F.col("w.we")).alias("n_test"))
    every = spark.createDataFrame([(i,) for i in range(len(TIME_WINDOWS))], "window_id INT")
    return every.join(counts, "window_id", "left").fillna(0, ["n_train", "n_test"])


# ------------------------------------------------------------------ MLlib learners (P)

def vector_sets(spark, sf, opts: FeatureOptions = SWEEP_OPTIONS, mode: str = "split"):
    """(train, test, names): vectors of the studied feature set.  ``mode``:
    'split' (md5 80/20), 'ground_truth' (train on labelled articles, test on
    ground truth)."""
    _known(mode)
    vec, names = vectors(spark, sf, opts)
    return *sets_of(vec, mode), names


def _known(mode: str) -> None:
    if mode not in ("split", "ground_truth"):
        raise ValueError("mode must be 'split' or 'ground_truth'; for another dataset see other_dataset_sets")


def vectors(spark, sf, opts: FeatureOptions = SWEEP_OPTIONS) -> tuple[DataFrame, DataFrame]:
    """(vectors of the labelled articles and ground truth, names), written once for every mode."""
    corpus = V.labelled_corpus(spark, sf)
    feats = cut_lineage(full_features(spark, sf, opts))
    index = VEC.fit_index(feats)
    # training iterates over these rows dozens of times: they are a written
    # table without text, so each iteration ships a scan of its files
    return VEC.to_vectors(feats, index, corpus.select("article_id", "label", "origin")), VEC.feature_names(index, spark)


def sets_of(vec: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) of ``vectors`` in a mode of ``vector_sets``."""
    _known(mode)
    arts = vec.where(F.col("origin") == "articles")
    if mode == "ground_truth":
        return arts, vec.where(F.col("origin") == "ground_truth")
    s = train_test_split(arts)
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def other_dataset_sets(train_features: DataFrame, train_rows: DataFrame, other_features: DataFrame, other_rows: DataFrame):
    """(train, test) vectors with another dataset as the test set (M2): the
    feature index is that of the training set, other features are skipped."""
    index = VEC.fit_index(train_features)
    return VEC.to_vectors(train_features, index, train_rows), VEC.to_vectors(other_features, index, other_rows)


def choose_test(ground_truth: bool = False, other: bool = False) -> str:
    """The evaluation mode; ground truth and another dataset exclude each other (M2)."""
    if ground_truth and other:
        raise ValueError("ground truth and another dataset exclude each other as the test set")
    return "ground_truth" if ground_truth else "other" if other else "split"


def _shown(spark, sf) -> DataFrame:
    """What an example shows of its article."""
    return V.labelled_corpus(spark, sf).select("article_id", "title", "url", "text")


def _train_one(name: str):
    def run(spark, sf):
        train, test, _ = vector_sets(spark, sf)
        _, rep, _ = MD.train_model(train, test, MD.spec_by_name(name))
        return MD.reports_frame(spark, [rep])
    return run


for _key, _name in [("train_tree", "Decision Tree"), ("train_forest", "Random Forest"),
                    ("train_logreg", "Logistic Regression"), ("train_nb", "Multinomial NB"),
                    ("train_svc", "Linear SVC")]:
    register(_key)(_train_one(_name))


@register("grid_search")
def grid_search(spark, sf):
    """Logistic regression over C in {0.01 .. 100} with 3-fold CV (M3)."""
    train, test, _ = vector_sets(spark, sf)
    _, rep, _ = MD.train_model(train, test, MD.spec_by_name("Logistic Regression"))
    return MD.reports_frame(spark, [rep])


@register("compare_learners")
def compare_learners(spark, sf):
    """All five learners and the soft-voting ensemble of the first four."""
    train, test, _ = vector_sets(spark, sf)
    reports, _ = MD.compare_learners(train, test)
    return MD.reports_frame(spark, reports)


@register("train_eval_modes")
def train_eval_modes(spark, sf):
    """Logistic regression (C = 100) with the random split and with ground
    truth as the test set (M2)."""
    spec = MD.LearnerSpec("Logistic Regression", MD.spec_by_name("Logistic Regression").make, {"C": [100]})
    reps, (vec, _) = [], vectors(spark, sf)
    for mode in ("split", "ground_truth"):
        train, test = sets_of(vec, mode)
        _, rep, _ = MD.train_model(train, test, spec)
        rep["learner"] = f"{spec.name} [{mode}]"
        reps.append(rep)
    return MD.reports_frame(spark, reps)


@register("top_features")
def top_features(spark, sf):
    """50 largest signed logistic-regression coefficients with names."""
    train, test, names = vector_sets(spark, sf)
    spec = MD.LearnerSpec("Logistic Regression", MD.spec_by_name("Logistic Regression").make, {"C": [100]})
    model, _, _ = MD.train_model(train, test, spec)
    return EV.top_features(MD.importance_frame(spark, model, names, 50), 50)


@register("probability_bins")
def probability_bins(spark, sf):
    """Accuracy per probability bin of logistic regression."""
    train, test, _ = vector_sets(spark, sf)
    spec = MD.LearnerSpec("Logistic Regression", MD.spec_by_name("Logistic Regression").make, {"C": [100]})
    _, _, pred = MD.train_model(train, test, spec)
    return EV.probability_bins(pred)


@register("outcome_examples")
def outcome_examples(spark, sf):
    """Up to five TP/FP/TN/FN examples of logistic regression."""
    train, test, _ = vector_sets(spark, sf)
    spec = MD.LearnerSpec("Logistic Regression", MD.spec_by_name("Logistic Regression").make, {"C": [100]})
    _, _, pred = MD.train_model(train, test, spec)
    return EV.outcome_examples(pred, 5, _shown(spark, sf))


@register("soft_vote")
def soft_vote(spark, sf):
    """Soft voting of tree, forest, logistic regression and NB (M9)."""
    train, test, _ = vector_sets(spark, sf)
    data = MD.TrainingRows(train, 3, "article_id")
    models = [MD._trained(data, test, s)[0] for s in MD.learner_specs()[:4]]
    votes = MD.soft_vote_models(models, test.withColumn("label", F.col("label").cast("double")))
    return votes.select("article_id", "label", F.round("prob_1", 6).alias("prob_1"), "prediction")


@register("time_slices")
def time_slices(spark, sf):
    """Expanding windows; logistic regression (C = 100) trained before each end
    date, tested on the following day (M17)."""
    from ..operators import features as FT
    from ..sources.tables import table
    reps = []
    spec = MD.LearnerSpec("Logistic Regression", MD.spec_by_name("Logistic Regression").make, {"C": [100]})
    # the dictionary is that of all documents, whatever the window
    dictionary = cut_lineage(FT.corpus_dictionary(table(spark, sf, "documents"), "doc_id", "text"))
    for i, (s, e) in enumerate(TIME_WINDOWS):
        tr_rows, te_rows = time_slice_rows(spark, sf, s, e)
        corpus = tr_rows.unionByName(te_rows).unionByName(V.ground_truth(spark, sf))
        from ..operators.featureset import build_features
        from ..sources import fixtures as FX
        feats = build_features(corpus, SWEEP_OPTIONS, dictionary=dictionary, rules=FX.grammar_rules(spark),
                               lexicon=FX.emotion_lexicon(spark))
        feats = cut_lineage(feats)
        index = VEC.fit_index(feats)
        # iterative training: cut lineage so iterations scan checkpoint files
        tr = VEC.to_vectors(feats, index, tr_rows.select("article_id", "label"))
        te = VEC.to_vectors(feats, index, te_rows.select("article_id", "label"))
        n_train, n_test = tr.count(), te.count()
        if not n_train or not n_test:  # listed with its counts, without a model
            reps.append({"learner": f"{spec.name} [{s}..{e}]", "params": None, "val_accuracy": None, "test_accuracy": None,
                         "tp": None, "fn": None, "fp": None, "tn": None, "n_train": n_train, "n_test": n_test})
            continue
        _, rep, _ = MD.train_model(tr, te, spec)
        rep["learner"] = f"{spec.name} [{s}..{e}]"
        reps.append(rep)
    return MD.reports_frame(spark, reps)


def feature_sweep(spark, sf, specs=None, families=("tags", "misspellings", "tfidf", "title")):
    """The studied sweep with MLlib learners (M16): features are built once
    and materialised, then for every non-empty subset of the built families
    the learners are compared on the same split.  One model per fit is
    inherent to MLlib, so this loops on the driver over settings; the
    SQL-form naive Bayes sweep (``nb_feature_sweep``) runs all settings in
    one distributed job instead.  Returns the results table (D18)."""
    from itertools import product

    from ..operators.featureset import partial_features
    corpus = V.labelled_corpus(spark, sf)
    feats = cut_lineage(full_features(spark, sf, SWEEP_OPTIONS))
    rows = corpus.select("article_id", "label", "origin")
    split = train_test_split(rows.where(F.col("origin") == "articles"))
    flag_of = {"tags": "tags", "misspellings": "spell", "tfidf": "tfidf", "title": "title"}
    out = []
    for setting in product((True, False), repeat=len(families)):
        chosen = dict(zip(families, setting))
        if not any(chosen.values()):
            continue                      # nothing to stack
        sub = partial_features(feats, SWEEP_OPTIONS, **chosen)
        index = VEC.fit_index(sub)
        vec = VEC.to_vectors(sub, index, split)
        train, test = vec.where(F.col("split") == "train"), vec.where(F.col("split") == "test")
        reports, _ = MD.compare_learners(train, test, specs)
        for r in reports:
            flags = {f: 0 for f in ("tags", "spell", "grammar", "word_count", "tfidf", "lsh", "title", "sentiment")}
            flags.update({flag_of[k]: int(v) for k, v in chosen.items()})
            out.append((r["learner"], float(r["test_accuracy"]), *flags.values()))
    return spark.createDataFrame(out, "classifier STRING, test_accuracy DOUBLE, tags INT, spell INT, grammar INT, "
                                      "word_count INT, tfidf INT, lsh INT, title INT, sentiment INT")
