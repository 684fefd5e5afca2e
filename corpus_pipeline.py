"""The training-data pipeline over ``documents``.

Quality rules and language identification drop rows, near-duplicate removal
keeps one text of each group, repeated passages are cut out of the texts that are left, and
what remains is packed into bins.  Each stage is written as Parquet in the
shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsprism.llm import bestfit, byte_gru, fertility, path_join, suffix_repeats
from newsprism.session import write_and_reload
from newsprism.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fertility.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_gru.in_one_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return path_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_repeats.strip(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit.pack(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates),
          ("repeated_passages", repeated_passages), ("packing", packing)]

#: no stage but the last could be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_reload(stage(spark, docs, sf_dir), name)
    return docs
