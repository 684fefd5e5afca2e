"""File sources and sinks (S4-S10) and the long-form -> vector conversion."""

import os
import tempfile

from newsprism.operators import vectors as VEC
from newsprism.sources import io as IO


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_url_labels_blank_is_null(spark):
    d = tempfile.mkdtemp(prefix="np-io-")
    p = _write(os.path.join(d, "labels.csv"), "a.com,1\nb.com,\nc.com,0\n")
    got = {r.domain: r.label for r in IO.read_url_labels(spark, p).collect()}
    assert got == {"a.com": 1.0, "b.com": None, "c.com": 0.0}


def test_lines_and_lexicon(spark):
    d = tempfile.mkdtemp(prefix="np-io-")
    p = _write(os.path.join(d, "dict.txt"), " the \ncat\n\n")
    assert sorted(r.word for r in IO.read_lines(spark, p).collect()) == ["cat", "the"]
    q = _write(os.path.join(d, "lex.tsv"), "bad\tnegative\t1\nbad\tjoy\t0\nhappy\tjoy\t1\n")
    assert sorted(tuple(r) for r in IO.read_emotion_lexicon(spark, q).collect()) == [("bad", "negative"), ("happy", "joy")]


def test_ground_truth_urls_keep_file_order(spark):
    d = tempfile.mkdtemp(prefix="np-io-")
    p = _write(os.path.join(d, "gt.csv"), "u1,1\nu2,0\nu1,0\n")
    rows = sorted(IO.read_ground_truth_urls(spark, p).collect(), key=lambda r: r.line_no)
    assert [(r.url, r.label) for r in rows] == [("u1", 1), ("u2", 0), ("u1", 0)]


def test_results_csv(spark):
    d = tempfile.mkdtemp(prefix="np-io-")
    p = _write(os.path.join(d, "results.csv"),
               "classifier,test_accuracy,tags,spell,grammar,word_count,tfidf,lsh,title,sentiment\nDT,0.5,1,0,0,0,1,0,1,0\n")
    r = IO.read_results(spark, p).collect()[0]
    assert r.classifier == "DT" and r.test_accuracy == 0.5 and r.tfidf == 1


def test_csv_round_trip_keeps_newlines_quotes_and_empties(spark):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', ""), (2, None, "x,y")], "id INT, t STRING, u STRING")
    back = {r.id: (r.t, r.u) for r in IO.csv_round_trip(df, "rt").collect()}
    assert back == {1: ('a "quoted"\nline', ""), 2: (None, "x,y")}


def test_vectors_equal_long_form(spark):
    feats = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 3.0)], "article_id INT, feature STRING, value DOUBLE")
    rows = spark.createDataFrame([(1,), (2,), (3,)], "article_id INT")
    index = VEC.fit_index(feats)
    assert list(index.labels) == ["a", "b", "c"]
    vec = {r.article_id: r.features for r in VEC.to_vectors(feats, index, rows).collect()}
    assert vec[1].toArray().tolist() == [1.0, 2.0, 0.0]
    assert vec[2].toArray().tolist() == [0.0, 0.0, 3.0]
    assert vec[3].numNonzeros() == 0 and vec[3].size == 3
