"""Nothing is cut, capped or read in part; oracles need no jar."""

import glob

import pytest
from pyspark.sql import functions as F

from newsprism.functions.lexicons import LANGUAGES, stop_words
from newsprism.functions.urls import url_base
from newsprism.operators.features import lsh_bands
from newsprism.operators.topics import lda_topics
from newsprism.plans import catalog
from newsprism.sources.pages import pages_to_articles


def test_all_oracles_build_without_any_jar(monkeypatch):
    monkeypatch.setattr(glob, "glob", lambda *a, **k: [])
    built = catalog.oracle_sql()
    assert set(built) == set(catalog._ORACLES) and len(built) >= 72
    assert all(len(stop_words(lang)) > 50 for lang in LANGUAGES)


def test_one_failing_oracle_costs_its_own_key(monkeypatch):
    catalog.queries()
    monkeypatch.setitem(catalog._ORACLES, "broken", lambda: 1 / 0)
    with pytest.warns(UserWarning, match="broken"):
        built = catalog.oracle_sql()
    assert "broken" not in built and "normalize_text" in built


def test_long_page_and_all_articles(spark):
    long = "word " * 20_000
    html = f"<html><body><article>{long}</article><p>x</p><article>second part</article></body></html>"
    text = pages_to_articles(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first().text
    assert len(text) > 99_000 and text.endswith("second part")


def test_long_host_is_stripped_fully(spark):
    url = "http://www.site" + ".ab" * 11 + "/x"
    df = spark.createDataFrame([(url,), ("http://www.site.co.uk.com",)], "u string")
    got = [r[0] for r in df.select(url_base("u", keep=("zz",))).collect()]
    assert got == ["site", "site"]
    assert [r[0] for r in df.select(url_base("u", keep=("uk",))).collect()][1] == "co.uk"


def test_last_band_takes_the_rest(spark):
    sig = spark.createDataFrame([(1, "0123456789abcdef")], "id int, signature string")
    keys = [r.band_key for r in lsh_bands(sig, "id", 3, 64).orderBy("band").collect()]
    assert "".join(keys) == "0123456789abcdef" and len(keys) == 3
    with pytest.raises(ValueError):
        lsh_bands(sig, "id", 17, 64)


def test_lda_reads_every_text(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i % 3}") for i in range(30)], "doc_id int, text string")
    model, _ = lda_topics(docs, ["alpha", "beta", "gamma0", "gamma1", "gamma2"], k=2, max_iter=2)
    assert model.getOrDefault("subsamplingRate") == 1.0


def test_line_numbers_follow_the_file(spark, tmp_path):
    from newsprism.sources.io import read_ground_truth_urls, read_lines
    (tmp_path / "a.csv").write_text("".join(f"u{i},{i % 2}\n" for i in range(200)))
    (tmp_path / "w.txt").write_text("one\t \r\n\n two\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        rows = read_ground_truth_urls(spark, str(tmp_path / "a.csv")).orderBy(F.col("line_no")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.url for r in rows] == [f"u{i}" for i in range(200)]
    assert sorted(r.word for r in read_lines(spark, str(tmp_path / "w.txt")).collect()) == ["one", "two"]


def test_time_slice_counts_keep_a_window_without_rows(spark, monkeypatch):
    from newsprism.plans import learning
    sf = "/root/testdata/sf0.001"
    before = {r.window_id: (r.n_train, r.n_test) for r in learning.time_slice_counts(spark, sf).collect()}
    monkeypatch.setattr(learning, "TIME_WINDOWS", [*learning.TIME_WINDOWS, ("1901-01-01", "1901-01-02")])
    after = {r.window_id: (r.n_train, r.n_test) for r in learning.time_slice_counts(spark, sf).collect()}
    assert after == {**before, 5: (0, 0)} and len(before) == 5
