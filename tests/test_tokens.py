"""Stemming by a table (N10): each word once, also where stems are many, repeated or missing."""

import re
from collections import Counter

from newsprism.operators import tokens as TK
from newsprism.plans import textplans

TEXTS = [(1, "Cats walking, cats walked"), (1, "cat walks"), (2, "the 12   sing"), (None, "running dogs"), (None, "dogs"),
         (3, None), (4, ""), (5, "of the"), (6, "es nations")]
WANT = {(1, "cat"): 3, (1, "walk"): 3, (2, "sing"): 1, (None, "runn"): 1, (None, "dog"): 2, (6, "es"): 1, (6, "nations"): 1}


def test_stem_query_cuts_texts_once_and_counts_them_where_they_are(spark, tmp_path, monkeypatch):
    spark.createDataFrame(TEXTS, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    found = textplans.stem_by_table(spark, str(tmp_path))
    got = {(r.doc_id, r.stem): r.n for r in found.collect()}
    assert got == WANT
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(([^)]*)\)", plan) and all(
        "token" not in keys and "stem" not in keys for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan))
    assert "regexp_replace" not in plan
    monkeypatch.setattr(TK, "MANY_STEMS", 0)
    assert {(r.doc_id, r.stem): r.n for r in textplans.stem_by_table(spark, str(tmp_path)).collect()} == got


def test_stems_of_a_given_table(spark, monkeypatch):
    """A word may have several stems, the same twice, itself, none, or no row."""
    words = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "d"), (2, "e"), (None, "f")]
    stems = [("a", "x"), ("b", "x"), ("c", "c"), ("c", "y"), ("d", None), ("e", "z"), ("e", "z"), ("unused", "q"), (None, "a")]
    tokens = spark.createDataFrame(words, "id LONG, token STRING")
    table = spark.createDataFrame(stems, "word STRING, stem STRING")
    want = Counter()
    for i, w in words:
        for to in [s or w for v, s in stems if v == w] or [w]:
            want[i, to] += 1
    for many in (2_000_000, 0):
        monkeypatch.setattr(TK, "MANY_STEMS", many)
        assert {(r.id, r.stem): r.n for r in TK.stem_by_table(tokens, table, "id").collect()} == want
