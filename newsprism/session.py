"""Spark session and shared-storage helpers.

Everything in the library takes a ``SparkSession`` from the caller; this
module only builds one for tests, the bench and scripts, and resolves the
shared folder that lineage cuts and intermediate tables are written to.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of lineage cuts are removed once no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "newsprism", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (a cluster passes its own)."""
    cpus = os.environ.get("BENCH_CPUS")
    master = master or (f"local[{cpus}]" if cpus else "local[*]")
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("NEWSPRISM_DRIVER_MEMORY", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (local tests) is a scratch folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="newsprism-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A written table in the shared folder in place of the plan: it survives
    executor loss, and later reads prune columns and push filters."""
    return write_and_reload(df, "cut")


def write_and_reload(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    for paths in _written:
        paths.append(path)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


#: lists that take the paths of tables written from now on
_written: list[list[str]] = []
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, Spark removes the shuffle files of a job when it has ended."""
    before = spark.conf.get(SHUFFLES)
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)


@contextmanager
def written_tables():
    """The paths of the tables that are written inside."""
    paths: list[str] = []
    _written.append(paths)
    try:
        yield paths
    finally:
        _written[:] = [x for x in _written if x is not paths]


class Passing:
    """Written tables of a computation in passes, deleted when no later pass reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back, until it is dropped."""
        path = scratch_path(self.spark, "passing")
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete these tables, or all that are left."""
        self.delete(*[self.paths.pop(key)[1] for key in [id(t) for t in tables] or list(self.paths)])

    def delete(self, *paths: str) -> None:
        """Delete written tables by their paths."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in map(jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(conf).delete(path, True)
