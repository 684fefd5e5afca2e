"""Routing, first-seen de-duplication and stream = batch (FIXTURES 3.10, 3.15; SURVEY 5.5)."""

import os
import tempfile

from pyspark.sql import functions as F

from newsprism.operators import language as L
from newsprism.operators.joins import first_seen
from newsprism.plans import ingest as PI
from newsprism.sources import views as V
from newsprism.streaming import ingest as IN

EN = "This is some English stuff right here. I hope that it knows."
FR = "Les deux suspects ont un lourd casier judiciaire, mais sans connotation et ils sont en examen pour la mise."


def test_detect_language(spark):
    df = spark.createDataFrame([(1, EN), (2, FR), (3, "zzz qqq"), (4, "")], "id INT, text STRING")
    got = {r.id: r.language for r in L.detect_language(df, "id", "text").collect()}
    assert got[1] == "english" and got[2] == "french"
    assert got[3] == "danish" and got[4] == "danish"  # no hit -> first language in list order


def test_routes(spark):
    rows = [(1, "u1", "", None, "2017-03-01 00:00:00"),      # failed fetch
            (2, "u2", FR, 1, "2016-01-01 00:00:00"),         # labelled, French, old -> ground truth
            (3, "u3", FR, None, "2017-03-01 00:00:00"),      # unlabelled French
            (4, "u4", EN, None, "2017-03-01 00:00:00"),      # English, new
            (5, "u5", EN, None, None)]                       # English, undated
    df = spark.createDataFrame(rows, "article_id INT, url STRING, text STRING, gt_label INT, d STRING")
    df = df.selectExpr("article_id", "url", "text", "gt_label", "CAST(d AS TIMESTAMP) AS date")
    got = {r.article_id: r.route for r in IN.route_articles(df).collect()}
    assert got == {1: "bad", 2: "ground_truth", 3: "bad", 4: "articles", 5: "old"}
    counts = {r.route: r.n for r in IN.route_counts(IN.route_articles(df)).collect()}
    assert counts == {"bad": 2, "ground_truth": 1, "articles": 1, "old": 1}


def test_first_seen(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 0, 2), ("b", 1, 3)], "url STRING, label INT, line_no INT")
    got = {r.url: r.label for r in first_seen(df, "url", "line_no").collect()}
    assert got == {"a": 0, "b": 1}


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    src = tempfile.mkdtemp(prefix="np-stream-src-")
    # the same documents split over several files, streamed one file per micro-batch
    docs.repartition(3, "doc_id").write.mode("overwrite").parquet(os.path.join(src, "docs"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    store = IN.stream_route(spark, os.path.join(src, "docs"),
                            lambda s: PI.article_rows(V.raw_articles_from(s, labels)))
    streamed = {(r.article_id, r.route) for r in spark.read.parquet(store).select("article_id", "route").collect()}
    batch = {(r.article_id, r.route) for r in PI.route_articles(spark, sf).collect()}
    assert streamed == batch and len(streamed) == docs.count()


def test_stream_over_table_of_part_files(spark):
    """``documents.parquet`` may be a folder of part files, as Spark writes it."""
    at = tempfile.mkdtemp(prefix="np-stream-sf-")
    docs = [(k, EN if k % 3 else FR, "en", f"s{k % 4}", 50) for k in range(40)]
    (spark.createDataFrame(docs, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
     .repartition(3, "doc_id").write.parquet(f"{at}/documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(0, 40, 3)], "doc_id LONG, quality INT, toxic INT").write.parquet(f"{at}/labels.parquet")
    streamed = {(r.article_id, r.route) for r in PI.stream_route_articles(spark, at).collect()}
    batch = {(r.article_id, r.route) for r in PI.route_articles(spark, at).collect()}
    assert streamed == batch and len(streamed) == 40
