"""File sources and sinks (S4-S10): headerless lookup CSVs, line files, the
emotion-lexicon TSV, result CSVs and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def read_url_labels(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``domain,label`` CSV; blank label -> null."""
    df = (spark.read.schema("domain STRING, label STRING").option("header", False).csv(path))
    return df.select(F.col("domain"),
                     F.when(F.trim(F.col("label")) == "", None).otherwise(F.col("label")).cast("double").alias("label"))


def read_ground_truth_urls(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``url,label`` CSV with its line position kept (S5): file, start
    of the block read, and order inside the block.  The position orders lines
    whatever way the scan packs splits of one or several files."""
    df = spark.read.schema("url STRING, label INT").option("header", False).csv(path)
    return df.select("url", "label", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth")).alias("line_no"))


def read_lines(spark: SparkSession, path: str, name: str = "word") -> DataFrame:
    """One record per line, stripped, blank lines dropped."""
    return (spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias(name))
            .where(F.col(name) != ""))


LEXICON_SCHEMA = T.StructType([T.StructField("word", T.StringType()),
                               T.StructField("affect", T.StringType()),
                               T.StructField("association", T.IntegerType())])


def read_emotion_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated word/affect/association file; keep associated pairs."""
    df = spark.read.schema(LEXICON_SCHEMA).option("sep", "\t").option("header", False).csv(path)
    return df.where(F.col("association") == 1).select("word", "affect")


RESULTS_SCHEMA = ("classifier STRING, test_accuracy DOUBLE, tags INT, spell INT, grammar INT, "
                  "word_count INT, tfidf INT, lsh INT, title INT, sentiment INT")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of experiment results with a declared schema."""
    return spark.read.schema(RESULTS_SCHEMA).option("header", True).csv(path)


# marker for SQL NULL in exported CSV, so that '' and NULL stay distinct
NULL_MARK = "\\N"


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV export (S9/S10); quotes and embedded newlines survive a read-back."""
    (df.write.mode("overwrite").option("header", header).option("escape", '"')
     .option("nullValue", NULL_MARK).option("emptyValue", '""').csv(path))


def read_csv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    return (spark.read.schema(schema).option("header", header).option("multiLine", True)
            .option("escape", '"').option("nullValue", NULL_MARK).option("emptyValue", "").csv(path))


def csv_round_trip(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as header CSV into the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema)
