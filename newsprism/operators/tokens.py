"""Long-form token tables (N6-N11 exploded once, shared by the feature
families, sentiment and topics) and table-driven stemming (N10)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage

#: texts whose tokens one task counts; words with another stem that may be broadcast
TASK_TEXTS, MANY_STEMS = 5_000, 2_000_000


def token_counts(df: DataFrame, id_col: str, tokens_col) -> DataFrame:
    """(id, token, n): occurrences of each token per row.  Partial aggregation
    happens map-side, and the exploded rows of one document sit together, so
    the shuffle carries at most one row per (document, distinct token)."""
    return (df.select(F.col(id_col), F.explode(tokens_col).alias("token"))
            .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n")))


def normalized_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """(id, token) rows of the normalised text (N11), one per occurrence."""
    ex = df.select(F.col(id_col), *(keep or []), F.explode_outer(T.raw_normal_tokens(F.col(text_col))).alias("token"))
    return ex.where(F.col("token").isNotNull() & T.keep_token(F.col("token")))


def normalized_token_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n) of the normalised text; filters run after the explode so
    the whole chain stays in generated code."""
    return (normalized_tokens(df, id_col, text_col)
            .groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n")))


def suffix_stems(vocabulary: DataFrame, word_col: str = "token") -> DataFrame:
    """A stem table (word, stem) derived from a vocabulary by stripping one
    common English suffix; stands in for a user-supplied stem table."""
    w = F.col(word_col)
    stem = F.regexp_replace(w, r"(ations|ation|ings|ing|edly|ed|ly|ies|es|s)$", "")
    return vocabulary.select(w.alias("word"), F.when(F.length(stem) >= 2, stem).otherwise(w).alias("stem"))


def dealt_tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) rows of the normalised text (N11), one per occurrence: texts are cut into tokens once, written
    normalised, and dealt by id, ``TASK_TEXTS`` to a task, so that counts by id and token stay in their task."""
    whole = cut_lineage(df.select(F.col(id_col), T.normalize_text(text_col).alias("_normal")))
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(whole.count() / TASK_TEXTS))
    return (whole.repartition(parts, id_col).select(id_col, F.explode_outer(F.split("_normal", " ")).alias("token"))
            .where(F.col("token") != ""))


def stem_by_table(tokens: DataFrame, stems: DataFrame, id_col: str) -> DataFrame:
    """(id, stem, n) of (id, token) rows, by a (word, stem) table; unknown tokens
    stay, so only words that their stems change are joined.  They are broadcast
    while they are few, and tokens dealt by id are counted where they are; else
    the counts by id and token join those that the tokens have."""
    changed = cut_lineage(stems.groupBy(F.col("word").alias("token"))
                          .agg(F.collect_list(F.coalesce(F.col("stem"), F.col("word"))).alias("_to"))
                          .where((F.size("_to") > 1) | (F.col("_to")[0] != F.col("token")))
                          .select("token", F.explode("_to").alias("stem")))
    if changed.count() <= MANY_STEMS:
        rows, changed = tokens.withColumn("n", F.lit(1)), F.broadcast(changed)
    else:
        rows = tokens.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))
        changed = changed.join(tokens.select("token").distinct(), "token", "left_semi")
    stem = F.coalesce(F.col("stem"), F.col("token")).alias("stem")
    return rows.join(changed, "token", "left").select(id_col, stem, "n").groupBy(id_col, "stem").agg(F.sum("n").alias("n"))
