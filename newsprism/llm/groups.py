"""Small Spark helpers of the subpackage: bounded Arrow batches, streaming
over sorted groups, and connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: bytes of an Arrow batch handed to a Python kernel
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so long texts cannot pile up in a worker,
    and let Spark remove the shuffle files of a job when it has ended: what later
    jobs read is a table in the shared folder."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class Scratch:
    """Tables in the shared folder that can be dropped when they are used up."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_groups(batches, key: str) -> Iterator[pa.Table]:
    """Tables that end where a group ends, from batches sorted by ``key``."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(keys != keys[-1])
        cut = int(cut[-1]) + 1 if len(cut) else 0
        if cut == 0 and rest and rest[0].column(rest[0].schema.get_field_index(key))[0].as_py() == keys[0]:
            rest.append(batch)
            continue
        done = [*rest, batch.slice(0, cut)] if cut else rest
        if done:
            yield pa.Table.from_batches(done)
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of (a, b): component is its least node.

    Alternating large-star and small-star rounds; each is a group-by minimum
    and a join on the node, so a hub costs one partially aggregated group.
    Rounds are written to the shared folder.
    """
    spark = edges.sparkSession

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.join(low, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = (linked.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                   .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        out = out.where("a <> b")
        return out if large else out.distinct()

    def put(pairs: DataFrame, n: int) -> tuple[DataFrame, tuple]:
        """Written pairs, and a mark of them observed while they are written."""
        seen = Observation()
        marked = pairs.observe(seen, F.count(F.lit(1)).alias("n"),
                               F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        return scratch.put(marked, f"{name}-{n}"), tuple(sorted(seen.get.items(), key=str))

    scratch = Scratch(spark)
    # every pair points from the larger to the smaller node
    now, before = put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .where("a <> b").distinct(), 0)
    n, empty = 0, now.isEmpty()
    while not empty:
        n += 1
        now, after = put(star(star(now, True), False), n)
        scratch.drop(f"{name}-{n - 1}")
        if after == before:
            break
        before = after
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct())
