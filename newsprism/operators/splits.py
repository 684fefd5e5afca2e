"""Row splits (F12, M1, M3 folds).

Splits are functions of the row key (an md5 prefix), never of row order or a
random draw, so they repeat across runs, partitionings and engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_by_date(df: DataFrame, cut: str, date_col: str = "date") -> tuple[DataFrame, DataFrame]:
    """(rows dated before ``cut``, rows dated on/after ``cut``); undated rows in neither."""
    c = F.col(date_col)
    ts = F.lit(cut).cast("timestamp")
    return df.where(c < ts), df.where(c >= ts)


def key_hash_prefix(key: str) -> Column:
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2)


def train_test_split(df: DataFrame, key: str = "article_id", test_share: float = 0.2) -> DataFrame:
    """Adds ``split`` in {'train', 'test'}: train when the first two hex digits
    of md5(key) fall below the cut (``'cc'`` = 204/256 for 20% test)."""
    cut = format(int(256 * (1 - test_share)), "02x")
    return df.withColumn("split", F.when(key_hash_prefix(key) < F.lit(cut), "train").otherwise("test"))


def fold_column(df: DataFrame, key: str = "article_id", folds: int = 3, name: str = "fold") -> DataFrame:
    """Deterministic cross-validation fold id in [0, folds) from md5(key)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit("fold:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn(name, (h % folds).cast("int"))
