"""Long form -> model form (F9 vector side, D12/D13), inside the JVM.

Feature names get dense indices in alphabetical order from a range
partitioning: a name's index is its place in its partition plus the sizes of the partitions before.
The name table stays distributed; a long row finds its index by a join that AQE plans
from the sizes.  A document's pairs are gathered (bounded by its non-zeros),
sorted, and written as the fields of a sparse vector, which Parquet reads back as
MLlib vectors; training then scans those files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, write_and_reload


@dataclass
class FeatureIndex:
    names: DataFrame   # (idx, feature)
    size: int

    @property
    def labels(self) -> list[str]:
        """All names in index order (for small indices)."""
        return [r.feature for r in self.names.orderBy("idx").collect()]


def fit_index(features: DataFrame) -> FeatureIndex:
    """Dense indices of the distinct feature names, alphabetical."""
    place = F.monotonically_increasing_id()
    ranged = write_and_reload(features.select("feature").where("feature IS NOT NULL").distinct()
                              .repartitionByRange("feature").sortWithinPartitions("feature")
                              .select("feature", F.shiftright(place, 33).cast("int").alias("part"),
                                      place.bitwiseAND(F.lit((1 << 33) - 1)).alias("nth")), "feature_names")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    before, total = {}, 0
    for r in sorted(sizes.collect(), key=lambda r: r.part):
        before[r.part] = total
        total += r.n
    if not before:
        return FeatureIndex(ranged.select(F.col("part").alias("idx"), "feature"), 0)
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part"))
    return FeatureIndex(ranged.select((start + F.col("nth")).cast("int").alias("idx"), "feature"), total)


def feature_names(index: FeatureIndex, spark) -> DataFrame:
    """(idx, feature) table of the model's columns."""
    return index.names


def to_vectors(features: DataFrame, index: FeatureIndex, rows: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Join sparse feature vectors onto ``rows`` (rows without features get
    an all-zero vector); the result is a written table.  A feature outside the
    index is skipped."""
    indexed = features.select(id_col, "feature", "value").join(index.names, "feature")
    per_doc = indexed.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx"), F.col("value").cast("double").alias("value")))).alias("_p"))
    sparse = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(index.size).alias("size"),
        F.coalesce(F.col("_p.idx"), F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.col("_p.value"), F.array().cast("array<double>")).alias("values"))
    out = rows.join(per_doc, id_col, "left").select(*[F.col(f"`{c}`") for c in rows.columns], sparse.alias("features"))
    path = scratch_path(rows.sparkSession, "vectors")
    out.write.parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)
