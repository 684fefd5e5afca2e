"""Corpus summary statistics.

Quantiles are exact but never gather a group's raw values: each group is
first reduced to a value histogram (partial aggregation, bounded by the
number of distinct values), and ranks are read off cumulative counts.  A
source holding a third of all articles therefore costs no more than any
other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def r6(c):
    return F.round(c, 6)


def global_stats(articles: DataFrame) -> DataFrame:
    """Rows, distinct sources, mean word count, missing authors/titles/texts."""
    return articles.agg(
        F.count(F.lit(1)).alias("n_articles"),
        F.countDistinct("base_url").alias("n_sources"),
        r6(F.avg("word_count")).alias("mean_word_count"),
        F.count_if(F.col("authors") == "").alias("missing_authors"),
        F.count_if(F.col("title") == "").alias("missing_titles"),
        F.count_if(F.col("text") == "").alias("missing_texts"),
    )


def word_count_stats(articles: DataFrame) -> DataFrame:
    """Per source: count, mean and sample deviation of word count, by count desc."""
    return (articles.groupBy("base_url")
            .agg(F.count(F.lit(1)).alias("n"), r6(F.avg("word_count")).alias("mean_wc"),
                 r6(F.stddev_samp("word_count")).alias("std_wc"))
            .orderBy(F.desc("n"), F.asc("base_url")))


def top_sources(articles: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` sources with most articles (G3); ties broken by name."""
    return (articles.groupBy("base_url").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc("base_url")).limit(k))


def missing_by_source(articles: DataFrame) -> DataFrame:
    """Per source counts of empty author, text and title; only sources with any."""
    return (articles.groupBy("base_url")
            .agg(F.count_if(F.col("authors") == "").alias("no_author"),
                 F.count_if(F.col("text") == "").alias("no_text"),
                 F.count_if(F.col("title") == "").alias("no_title"))
            .where((F.col("no_author") != 0) | (F.col("no_text") != 0) | (F.col("no_title") != 0)))


def value_histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, lo, hi, total): rows with rank in [lo, hi) hold ``value``."""
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    return (hist.withColumn("_hi", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .withColumn("_lo", F.col("_hi") - F.col("_n"))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy(*keys))))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (the ``quantile_cont`` definition) per group."""
    hist = value_histogram(df, keys, value)
    aggs = []
    for name, p in probs.items():
        h = (F.col("_total") - 1) * F.lit(p)
        r0, r1 = F.floor(h), F.ceil(h)
        v0 = F.max(F.when((F.col("_lo") <= r0) & (r0 < F.col("_hi")), F.col(value)))
        v1 = F.max(F.when((F.col("_lo") <= r1) & (r1 < F.col("_hi")), F.col(value)))
        frac = F.max(h - r0)
        aggs.append((v0.cast("double") + frac * (v1 - v0)).alias(name))
    return hist.groupBy(*keys).agg(*aggs)


def box_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Box-plot data: quartiles, whiskers at 1.5 IQR, outlier count."""
    q = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        raise ValueError("box_summary needs at least one group key")
    j = hist.join(q, keys)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col(value) >= lo_f) & (F.col(value) <= hi_f)
    out = j.groupBy(*keys).agg(
        F.sum("_n").alias("n"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_hi"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outliers"))
    return out.select(*keys, "n", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                      "n_outliers")


def wordcount_box(articles: DataFrame, k: int = 10) -> DataFrame:
    """Box summary of word count for the top ``k`` sources (G4 + J5 semi join)."""
    top = top_sources(articles, k).select("base_url")
    return box_summary(articles.join(F.broadcast(top), "base_url", "left_semi"), ["base_url"], "word_count")


def articles_by_source_label(articles: DataFrame, min_count: int = 100) -> DataFrame:
    """Groups (source, label) with more than ``min_count`` articles, box of their
    counts per label (G5)."""
    counts = (articles.where(F.col("label").isNotNull())
              .groupBy("base_url", "label").agg(F.count(F.lit(1)).alias("n_articles"))
              .where(F.col("n_articles") > min_count))
    return box_summary(counts, ["label"], "n_articles").withColumnRenamed("n", "n_sources")


def kde_density(df: DataFrame, key: str, value: str, bandwidth: float = 3.0,
                grid_size: int = 100, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per ``key`` on an even grid from min - cut*bw to
    max + cut*bw (G7).  Points are pre-aggregated to (key, value, n); each
    histogram row is expanded over the fixed-size grid, so the work is
    distinct values x grid points, never pairs of rows."""
    hist = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    bounds = hist.groupBy(key).agg(F.min(value).alias("_min"), F.max(value).alias("_max"),
                                   F.sum("_n").alias("_total"))
    g = (hist.join(bounds, key)
         .withColumn("grid_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid_size - 1).cast("long")))))
    lo = F.col("_min") - cut * bandwidth
    step = (F.col("_max") - F.col("_min") + 2 * cut * bandwidth) / (grid_size - 1)
    x = lo + F.col("grid_idx") * step
    z = (x - F.col(value)) / bandwidth
    contrib = F.col("_n") * F.exp(-0.5 * z * z) / (bandwidth * math.sqrt(2 * math.pi) * F.col("_total"))
    return (g.groupBy(key, "grid_idx").agg(r6(F.first(x)).alias("x"), r6(F.sum(contrib)).alias("density")))


def term_weight_totals(weights: DataFrame) -> DataFrame:
    """Column totals of a long-form weight matrix."""
    return weights.groupBy("term").agg(r6(F.sum("weight")).alias("total_weight"))
