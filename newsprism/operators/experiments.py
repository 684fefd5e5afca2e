"""Experiment analytics over sweep results.

Results table (D18): classifier, test_accuracy and eight 0/1 flags
(tags, spell, grammar, word_count, tfidf, lsh, title, sentiment).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FLAGS = ["tags", "spell", "grammar", "word_count", "tfidf", "lsh", "title", "sentiment"]


def interaction_features(results: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """Adds the 28 pairwise products ``a x b`` of the flags."""
    return results.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}x{b}") for a, b in combinations(flags, 2)])


def response_surface(results: DataFrame, divisor: float | None = None, flags: list[str] = FLAGS) -> DataFrame:
    """Per classifier and flag: (sum of accuracy with the flag - sum without)
    / divisor + class mean; ranked by the flag's mean effect, then the class
    mean accuracy (X4, G11, J14).  ``divisor`` defaults to the number of
    settings per classifier (the studied code hard-codes 255)."""
    stack = F.expr("stack({n}, {pairs}) AS (feature, flag)".format(
        n=len(flags), pairs=", ".join(f"'{f}', {f}" for f in flags)))
    long = results.select("classifier", "test_accuracy", stack)
    per_class = results.groupBy("classifier").agg(F.avg("test_accuracy").alias("class_mean"),
                                                   F.count(F.lit(1)).alias("n_settings"))
    sums = long.groupBy("classifier", "feature").agg(
        F.sum(F.when(F.col("flag") == 1, F.col("test_accuracy")).otherwise(0.0)).alias("s_with"),
        F.sum(F.when(F.col("flag") == 0, F.col("test_accuracy")).otherwise(0.0)).alias("s_without"))
    d = F.lit(float(divisor)) if divisor else F.col("n_settings")
    # rounded before ranking, so that equal effects tie exactly and fall back
    # to the name order on every engine
    eff = sums.join(F.broadcast(per_class), "classifier").select(
        "classifier", "feature",
        F.round((F.col("s_with") - F.col("s_without")) / d + F.col("class_mean"), 6).alias("effect"),
        "class_mean")
    # the two order tables are tiny (one row per flag / per classifier)
    f_rank = eff.groupBy("feature").agg(F.round(F.avg("effect"), 6).alias("_m")).select(
        "feature", F.row_number().over(Window.orderBy(F.desc("_m"), "feature")).alias("feature_rank"))
    c_rank = per_class.select("classifier", F.row_number().over(
        Window.orderBy(F.desc(F.round("class_mean", 6)), "classifier")).alias("classifier_rank"))
    out = eff.join(F.broadcast(f_rank), "feature").join(F.broadcast(c_rank), "classifier")
    return (out.select("classifier", "feature", F.round("effect", 6).alias("effect"),
                       F.col("feature_rank").cast("long").alias("feature_rank"),
                       F.col("classifier_rank").cast("long").alias("classifier_rank"))
            .orderBy("feature_rank", "classifier_rank"))


def accuracy_ols(results: DataFrame, classifier: str | None = None, flags: list[str] = FLAGS) -> DataFrame:
    """OLS of test accuracy on the flags: ``0 + classifier + flags`` over all
    classifiers, or ``1 + flags`` for one (X3).  Constant flags are dropped
    (they would make the normal equations singular).  Returns the coefficient
    table (term, coef, std_err, t, p) plus a centred R^2 row."""
    df = results
    if classifier:
        df = df.where(F.col("classifier") == classifier)
    stats = df.agg(*[F.countDistinct(f).alias(f) for f in flags]).collect()[0]
    used = [f for f in flags if stats[f] > 1]
    if classifier:
        formula, intercept = "test_accuracy ~ " + (" + ".join(used) if used else "1"), True
    else:
        formula, intercept = "test_accuracy ~ classifier + " + " + ".join(used) if used else "test_accuracy ~ classifier", False
    rf = RFormula(formula=formula, featuresCol="x", labelCol="y", stringIndexerOrderType="alphabetAsc")
    if not intercept:
        rf = rf.setForceIndexLabel(False)
    prepared = rf.fit(df).transform(df)
    lr = LinearRegression(featuresCol="x", labelCol="y", solver="normal", regParam=0.0, fitIntercept=intercept)
    if not intercept:
        # full one-hot of the classifier column in place of the intercept
        names = sorted(r[0] for r in df.select("classifier").distinct().collect())
        one_hot = [F.when(F.col("classifier") == n, 1.0).otherwise(0.0) for n in names]
        from pyspark.ml.functions import array_to_vector
        prepared = df.select(F.col("test_accuracy").alias("y"),
                             array_to_vector(F.array(*one_hot, *[F.col(f).cast("double") for f in used])).alias("x"))
        terms = [f"classifier[{n}]" for n in names] + used
    else:
        terms = ["intercept"] + used
    model = lr.fit(prepared)
    s = model.summary
    coefs = ([model.intercept] if intercept else []) + list(model.coefficients)
    se, tv, pv = list(s.coefficientStandardErrors), list(s.tValues), list(s.pValues)
    if intercept:  # MLlib lists the intercept last
        se, tv, pv = se[-1:] + se[:-1], tv[-1:] + tv[:-1], pv[-1:] + pv[:-1]
    y_mean = df.agg(F.avg("test_accuracy")).collect()[0][0]
    sst = df.agg(F.sum((F.col("test_accuracy") - F.lit(y_mean)) ** 2)).collect()[0][0]
    sse = s.meanSquaredError * s.numInstances
    r2 = 1.0 - sse / sst if sst else float("nan")
    rows = [(t, float(c), float(e), float(tt), float(p)) for t, c, e, tt, p in zip(terms, coefs, se, tv, pv)]
    rows.append(("r2_centred", r2, float("nan"), float("nan"), float("nan")))
    spark = df.sparkSession
    return spark.createDataFrame(rows, "term STRING, coef DOUBLE, std_err DOUBLE, t DOUBLE, p DOUBLE")


def flag_slopes(results: DataFrame, flag: str) -> DataFrame:
    """Per classifier simple regression of accuracy on one flag (SQL regr_*);
    adding 0.0 turns a negative zero into zero."""
    return results.groupBy("classifier").agg(
        (F.round(F.regr_slope("test_accuracy", F.col(flag).cast("double")), 6) + F.lit(0.0)).alias("slope"),
        (F.round(F.regr_intercept("test_accuracy", F.col(flag).cast("double")), 6) + F.lit(0.0)).alias("intercept"))


# ---------------------------------------------------------------- training log

def format_training_log(runs: DataFrame) -> DataFrame:
    """Render sweep runs as the lines of a training log, one ``value`` per
    line with a ``line_no`` order: a bare ``True, False, ...`` header per
    setting, then per learner its name line and tab-indented detail lines.
    Runs with bin columns (ones_b, zeros_b, acc_b) get their bins too, from 0.9 down.
    Built with Spark expressions; each setting's block is keyed by its
    (setting, classifier) rank, so the rendering is distributed too."""
    flag_txt = F.concat_ws(", ", *[F.when(F.col(f) == 1, "True").otherwise("False") for f in FLAGS])
    head = runs.select("setting", F.lit(-1).alias("k"), F.lit(0).alias("j"), flag_txt.alias("value")).distinct()
    name = F.regexp_replace(F.regexp_extract("classifier", r"^([^=]+?)(?: alpha=.*)?$", 1), " ", "")
    alpha = F.regexp_extract("classifier", r"alpha=(.*)$", 1)
    k = F.dense_rank().over(Window.partitionBy("setting").orderBy("classifier"))
    r = runs.withColumn("k", k)
    bins = [F.lit("\tProbabilities"), F.lit("\t\tprobs\t1\t0\tacc"),
            *[F.concat_ws("\t", F.lit(f"\t\t0.{b}"), *[F.col(f"{kind}_{b}").cast("string") for kind in ("ones", "zeros", "acc")])
              for b in range(9, -1, -1)]] if "ones_0" in runs.columns else []
    lines = F.array(
        F.concat(name, F.lit(" with parameters {'alpha': "), alpha, F.lit("}:")),
        F.concat(F.lit("\tval-accuracy: nan")),
        F.concat(F.lit("\ttest-accuracy: "), F.col("test_accuracy").cast("string")),
        F.concat(F.lit("\tconfusion matrix: [["), F.col("tp").cast("string"), F.lit(" "), F.col("fn").cast("string"), F.lit("]")),
        F.concat(F.lit("\t                   ["), F.col("fp").cast("string"), F.lit(" "), F.col("tn").cast("string"), F.lit("]]")),
        *bins)
    body = r.select("setting", "k", F.posexplode(lines).alias("j", "value"))
    allr = head.unionByName(body.select("setting", "k", (F.col("j") + 1).alias("j"), "value"))
    return allr.select((F.col("setting") * 100000 + (F.col("k") + 1) * 100 + F.col("j")).alias("line_no"), "value")


def parse_training_log(lines: DataFrame) -> DataFrame:
    """One row per learner run from a training log (X1): class, parameters, flags, accuracies, confusion counts
    and ten bins of ones, zeros and accuracy (null where the log has none).

    ``lines``: (file, block, nth, value), in this order.  A run begins at a learner-name line and takes the flags of the
    latest header *above* it, which fixes the studied parser's defects (last run lost, flags of the next setting, the
    TP/FP/FN/TN mislabelling).  Runs are numbered and headers carried inside each block (one split
    of a file, by a window that ends with it); a row a block then tells the blocks after it how many runs
    and which header came before, so a large file is the work of many tasks."""
    part = ["file", "block"]
    v = F.col("value")
    is_header = v.rlike(r"^(True|False)\b")
    is_learner = (~is_header) & v.rlike(r"^[A-Z]")
    w = Window.partitionBy(*part).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = lines.select(*part, "nth", "value", F.when(is_header, F.split(F.regexp_replace(v, ",", ""), " ")).alias("_flags"),
                      is_learner.cast("int").alias("_is_learner"))
    df = df.withColumn("_in", F.sum("_is_learner").over(w)).withColumn("_own", F.last("_flags", True).over(w))
    blocks = df.groupBy(*part).agg(F.sum("_is_learner").alias("_n"), F.max_by("_flags", F.when(F.col("_flags").isNotNull(), F.col("nth"))).alias("_last"))
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*part, F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_before"), F.last("_last", True).over(above).alias("_header"))
    df = (df.join(blocks, part).withColumn("_run", F.col("_before") + F.col("_in")).withColumn("_set", F.coalesce("_own", "_header")))
    t = F.regexp_replace(v, r"^\s+|\s+$", "")
    num = lambda pat: F.regexp_extract(t, pat, 1)
    agg = df.where(F.col("_run") > 0).groupBy("file", "_run").agg(
        F.max(F.when(F.col("_is_learner") == 1, F.regexp_extract(v, r"^(\S+)", 1))).alias("classifier"),
        F.max(F.when(F.col("_is_learner") == 1, F.regexp_extract(v, r"\{(.*)\}", 1))).alias("params"),
        F.max(F.when(F.col("_is_learner") == 1, F.col("_set"))).alias("_flags"),
        F.max(F.when(t.startswith("val-accuracy"), num(r"^val-accuracy:\s*(\S+)"))).alias("val_accuracy"),
        F.max(F.when(t.startswith("test-accuracy"), num(r"^test-accuracy:\s*(\S+)"))).alias("test_accuracy"),
        F.max(F.when(t.startswith("confusion"), num(r"\[\[?\s*(\d+)"))).alias("tp"),
        F.max(F.when(t.startswith("confusion"), num(r"\[\[?\s*\d+\s+(\d+)"))).alias("fn"),
        F.max(F.when(t.startswith("["), num(r"^\[\s*(\d+)"))).alias("fp"),
        F.max(F.when(t.startswith("["), num(r"^\[\s*\d+\s+(\d+)"))).alias("tn"),
        *[F.max(F.when(t.startswith(f"0.{b}\t"), F.split(t, "\t")[k])).alias(f"{kind}_{b}")
          for k, kind in ((1, "ones"), (2, "zeros"), (3, "acc")) for b in range(10)])
    return agg.select("file", "classifier", "params",
                      *[F.when(F.col("_flags")[i] == "True", 1).otherwise(0).alias(f) for i, f in enumerate(FLAGS)],
                      F.nullif(F.col("val_accuracy").try_cast("double"), F.lit(float("nan"))).alias("val_accuracy"),  # "nan": none was taken
                      F.col("test_accuracy").cast("double").alias("test_accuracy"),
                      *[F.col(c).cast("long").alias(c) for c in ("tp", "fn", "fp", "tn")],
                      *[F.col(f"{kind}_{b}").cast("double" if kind == "acc" else "long").alias(f"{kind}_{b}")
                        for kind in ("ones", "zeros", "acc") for b in range(10)])


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log file or folder: (file, block, nth, value).  A file may be read in any number of splits; a line
    belongs to the split it starts in."""
    return (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("nth"), "value")
            .where(F.col("value") != ""))


def write_training_log(lines: DataFrame, path: str, key: str = "setting") -> None:
    """Write rendered lines as text, whole setting blocks per file, in order."""
    (lines.withColumn(key, (F.col("line_no") / 100000).cast("long"))
     .repartitionByRange(key).sortWithinPartitions("line_no").select("value")
     .write.mode("overwrite").text(path))
