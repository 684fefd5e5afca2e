"""Join helpers.

Broadcast only what has a proven bound: ``broadcast_checked`` counts the
side first (cheap for the small tables it is meant for) and falls back to a
plain join, which AQE may still turn into a broadcast from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def broadcast_checked(small: DataFrame, max_rows: int) -> DataFrame:
    """``F.broadcast(small)`` if it has at most ``max_rows`` rows, else ``small``."""
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def lookup_left(df: DataFrame, lookup: DataFrame, on: str, max_rows: int = 1_000_000) -> DataFrame:
    """Left equi lookup (J1), broadcast when the lookup is size-checked small."""
    return df.join(broadcast_checked(lookup, max_rows), on, "left")


def anti_join(df: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in ``seen`` (J2).  ``seen`` is projected to the key
    and de-duplicated (partial aggregation) before the shuffle."""
    return df.join(seen.select(on).distinct(), on, "left_anti")


def union_distinct(frames: list[DataFrame]) -> DataFrame:
    """UNION (J8): append then de-duplicate."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def first_seen(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Keep the first row per key by ``order_col`` (J10).  ``min_by`` over a
    struct is a hash aggregate with partial aggregation, so a key repeated a
    million times costs one row per partition before the shuffle."""
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def top_k_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """``row_number() <= k`` per group (J13); groups here are bounded (topics,
    clusters), never a data-sized key."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
