import re
from collections import Counter

import pandas as pd
import pytest

from newsprism.llm import fertility

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            inside |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def check_base(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_query_matches_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    rows = fertility.op10_fertility(spark, SF).collect()
    assert len(rows) == len(docs)
    check_base(rows, docs.text)


def test_edge_rows(spark, make_docs, as_table):
    texts = [None, "", " \n\t ", "one", "a b c d e f g h " * 40, "x" * 300_000, "é ü  q\r\n\n\nq",
             "same line here\nsame line here\n\n same line here", "w" * 70 + " " + "w" * 70, None]
    df = make_docs(texts, langs=["en", None, "fr", "en", None, "de", "en", "en", "en", "en"],
                   verdict=["v"] * 10, text_key=["k"] * 10, n_words=["z"] * 10)
    check_base(fertility.op10_fertility(spark, as_table(df)).collect(), texts)
    kept = fertility.keep_good(df)
    assert kept.columns == df.columns and kept.count() <= 10
    assert fertility.keep_good(df.limit(0)).count() == 0


def test_junk_goes_clean_stays(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet").toPandas().set_index("doc_id")
    kept = {r.doc_id for r in fertility.keep_good(docs).select("doc_id").collect()}
    share = labels.quality.groupby(labels.index.isin(kept)).mean()
    assert share[True] > 0.95 and labels[labels.quality == 1].index.isin(kept).mean() > 0.95


def test_fallback_share_is_measured(spark, make_docs):
    words = " ".join(f"word{i} stone{i} river{i}" for i in range(30))
    df = make_docs([words, words + " " + "\U00013000 \U00013001 " * 60])
    rows, v = fertility.with_verdict(df)
    got = {r.doc_id: r[v] for r in rows.collect()}
    assert got[0].n_fallback == 0 and got[1].n_fallback > 60 and not got[1].kept
    assert got[0].kept


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE_WORDS", 3)
    v = fertility._Vocabulary(*fertility.vocabularies())
    for k in range(5):
        v.read([10 * k, 10 * k + 1], lambda i: "ab")
        assert len(v.known) <= 5


@pytest.mark.parametrize("text", ["", "a b"])
def test_measure_small(text):
    import pyarrow as pa
    v = fertility._Vocabulary(*fertility.vocabularies())
    got = fertility.measure(pa.array([text, None]), v)
    assert got["n_words"].tolist() == [len(text.split()), 0] and got["entropy"][1] == 0


def test_bands_are_exact_ranks_in_a_large_class(spark):
    def rows(parts):
        return spark.range(0, 90_001, 1, parts).selectExpr(
            "'en' AS l", "CAST(id % 3 = 0 AS int) AS k", "id * 37 % 90001 / 10000 AS cpt", "sqrt(id) AS entropy")
    for parts in (1, 7):
        df = rows(parts)
        want = df.toPandas().round(4).groupby("k")
        got = {r.k: r for r in fertility.class_bands(df, ["cpt", "entropy"]).collect()}
        for k, g in want:
            for n in ("cpt", "entropy"):
                v = sorted(g[n])
                assert got[k][n] == [v[-(-len(v) // 2) - 1], v[-(-len(v) // 5) - 1]], (parts, k, n)
