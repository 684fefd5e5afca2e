"""Incremental ingest and routing (R1-R3, S11, J2, J8, J10), batch and
Structured Streaming.

Routing, first rule wins: fetch failed -> ``bad``; on the ground-truth list
-> ``ground_truth``; language not English -> ``bad``; dated on/after the
cut-off -> ``articles``; else ``old``.  Ground truth is exempt from the
language and date rules.

The streaming form keeps no unbounded streaming state: each micro-batch is
de-duplicated by url, anti-joined with the urls already stored, routed and
appended to the store partitioned by route.  A replayed batch finds its own
rows already stored (Parquet appends commit atomically), so the sink stays
exactly-once across executor or driver loss; the stream checkpoint lives in
the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import anti_join, first_seen, union_distinct
from ..operators.language import detect_language
from ..session import ensure_checkpoint_dir, scratch_path

ROUTES = ("bad", "ground_truth", "articles", "old")
# cut-off of "new" articles: 2017-02-01 in US/Eastern, as UTC
DEFAULT_CUTOFF = "2017-02-01 05:00:00"


def route_column(fetched: Column, gt_label: Column, language: Column, date: Column,
                 cutoff: str = DEFAULT_CUTOFF) -> Column:
    return (F.when(~fetched, "bad")
            .when(gt_label.isNotNull(), "ground_truth")
            .when(language != "english", "bad")
            .when(F.coalesce(date >= F.lit(cutoff).cast("timestamp"), F.lit(False)), "articles")
            .otherwise("old"))


def route_articles(rows: DataFrame, id_col: str = "article_id", cutoff: str = DEFAULT_CUTOFF) -> DataFrame:
    """Adds ``route`` to parsed article rows carrying ``text``, ``gt_label``
    (label when the url is on the ground-truth list) and ``date``."""
    lang = detect_language(rows.select(id_col, "text"), id_col, "text")
    j = rows.join(lang, id_col, "left")
    fetched = F.col("text").isNotNull() & (F.col("text") != "")
    return j.withColumn("route", route_column(fetched, F.col("gt_label"), F.col("language"), F.col("date"), cutoff))


def route_counts(routed: DataFrame) -> DataFrame:
    """Per-route counters (R3, G12), zeros included."""
    spark = routed.sparkSession
    all_routes = spark.createDataFrame([(r,) for r in ROUTES], "route STRING")
    c = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    return all_routes.join(F.broadcast(c), "route", "left").select("route", F.coalesce("n", F.lit(0)).alias("n"))


def seen_urls(stored: list[DataFrame]) -> DataFrame:
    """Union of the stored url sets, duplicates removed."""
    return union_distinct([s.select("url") for s in stored])


def new_urls(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidate urls not seen before, each once."""
    return anti_join(candidates.select("url").distinct(), seen, "url")


def ground_truth_first_seen(gt_list: DataFrame, stored_gt: DataFrame) -> DataFrame:
    """First label per url in list order, minus urls already stored."""
    first = first_seen(gt_list.select("url", "label", "line_no"), "url", "line_no")
    return anti_join(first, stored_gt, "url").select("url", "label")


# ---------------------------------------------------------------- streaming

def _append_batch(spark: SparkSession, batch: DataFrame, store: str, id_col: str, cutoff: str) -> None:
    batch = first_seen(batch, "url", id_col)
    try:
        seen = spark.read.parquet(store).select("url")
    except AnalysisException:  # nothing stored yet
        seen = None
    if seen is not None:
        batch = anti_join(batch, seen, "url")
    routed = route_articles(batch, id_col, cutoff)
    (routed.select(id_col, "url", "route").write.mode("append").partitionBy("route").parquet(store))


def table_source(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str | None]:
    """(folder, glob of its files) of a table that is one Parquet file or a folder of part files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return (path.toString(), None) if status.isDirectory() else (sf_dir, f"{name}.parquet")


def stream_route(spark: SparkSession, source_dir: str, prepare, store: str | None = None,
                 checkpoint: str | None = None, id_col: str = "article_id", cutoff: str = DEFAULT_CUTOFF,
                 max_files_per_trigger: int = 1, file_glob: str | None = None) -> str:
    """Run the routing stream over Parquet files in ``source_dir`` (optionally
    only those matching ``file_glob``) until all available input is processed
    (``availableNow``); returns the store path.
    ``prepare(stream_df) -> stream_df`` maps raw rows to article rows with
    (id, url, text, gt_label, date); it must be stateless (projections,
    stream-static joins)."""
    ensure_checkpoint_dir(spark)
    store = store or scratch_path(spark, "routed_store")
    checkpoint = checkpoint or scratch_path(spark, "routed_stream_ckpt")
    reader = spark.read
    sreader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if file_glob:
        reader, sreader = reader.option("pathGlobFilter", file_glob), sreader.option("pathGlobFilter", file_glob)
    schema = reader.parquet(source_dir).schema
    src = sreader.schema(schema).parquet(source_dir)
    rows = prepare(src)

    def handle(batch_df: DataFrame, batch_id: int) -> None:
        _append_batch(spark, batch_df, store, id_col, cutoff)

    q = (rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store
