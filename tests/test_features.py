"""Feature families: hand-traced cases and invariants (FIXTURES 3.6, 3.8, 3.9, 3.16)."""

import math

import numpy as np
from pyspark.sql import functions as F

from newsprism.operators import features as FT


def test_multi_hot(spark):
    df = spark.createDataFrame([(1, "a,b,a"), (2, "")], "article_id INT, tags STRING")
    got = {(r.article_id, r.feature): r.value for r in FT.multi_hot(df, "article_id", "tags", "tag").collect()}
    assert got == {(1, "tag_a"): 2.0, (1, "tag_b"): 1.0, (2, "tag_"): 1.0}


def test_misspelling_rate(spark):
    df = spark.createDataFrame([(1, "The cat szt on"), (2, "123"), (3, "")], "article_id INT, text STRING")
    dictionary = spark.createDataFrame([("the",), ("cat",)], "word STRING")
    got = {r.article_id: r.value for r in FT.misspelling_rate(df, dictionary).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 0.0}


def test_emotion_scores(spark):
    df = spark.createDataFrame([(1, "bad. bad. happy. angry. crying."), (2, "")], "article_id INT, text STRING")
    lex = spark.createDataFrame([("bad", "negative"), ("happy", "joy")], "word STRING, affect STRING")
    got = {(r.article_id, r.feature): r.value for r in FT.emotion_scores(df, lex).collect()}
    assert got[(1, "sent_negative")] == 2 / 5 and got[(1, "sent_joy")] == 1 / 5
    assert got[(1, "sent_trust")] == 0.0 and all(got[(2, f)] == 0.0 for f in ("sent_joy", "sent_negative"))
    assert len(got) == 20


def test_source_count(spark):
    df = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/y"), (3, "http://b/z")], "article_id INT, url STRING")
    got = {r.article_id: r.value for r in FT.source_count(df).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 1.0}


def test_tfidf_rows_are_unit_norm(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma"), (3, "delta")], "article_id INT, text STRING")
    w = FT.tfidf_weights(df, "article_id", "text")
    norms = w.groupBy("article_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-12 for r in norms)
    # idf = ln((1 + N) / (1 + df)) + 1, raw tf
    a = {r.term: r.weight for r in w.where("article_id = 1").collect()}
    ia, ib = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    na = math.sqrt(ia ** 2 + (2 * ib) ** 2)
    assert abs(a["alpha"] - ia / na) < 1e-12 and abs(a["beta"] - 2 * ib / na) < 1e-12


def test_bigrams(spark):
    df = spark.createDataFrame([(1, "a1 b2 c3")], "article_id INT, text STRING")
    terms = sorted(r.term for r in FT.ngram_terms(df, "article_id", "text", ngram=2).collect())
    assert terms == ["a1", "a1 b2", "b2", "b2 c3", "c3"]


def test_lsh_scale_invariant_and_repeatable(spark):
    rows = [(1, "t1", 0.3), (1, "t2", -0.7), (1, "t3", 0.1), (2, "t1", 3.0), (2, "t2", -7.0), (2, "t3", 1.0)]
    df = spark.createDataFrame(rows, "id INT, term STRING, weight DOUBLE")
    sig = {r.id: r.signature for r in FT.lsh_signatures(df, "id", 64).collect()}
    assert sig[1] == sig[2] and len(sig[1]) == 16
    # the numpy kernel agrees with the plain aggregate form
    ref = {r.id: r.signature for r in FT.signature_hex(FT.sign_dots(df, "id", "term", "weight", 64), "id", 64).collect()}
    assert ref == sig


def test_rule_violation_rate(spark):
    df = spark.createDataFrame([(1, "a  b ,c"), (2, "")], "article_id INT, text STRING")
    rules = spark.createDataFrame([("r1", " {2,}"), ("r2", " ,")], "rule_id STRING, regex STRING")
    got = {r.article_id: r.value for r in FT.rule_violation_rate(df, rules).collect()}
    assert got == {1: 2 / 3, 2: 0.0}


def test_test_rows_change_nothing_in_a_fit(spark, tmp_path):
    from newsprism.operators.featureset import FeatureOptions, FittedFeatures, fit_features
    cols = "article_id LONG, url STRING, title STRING, text STRING, tags STRING"
    train = spark.createDataFrame([(1, "http://a.com/1", "one title", "apple pear apple", "x,y"),
                                   (2, "http://a.com/2", "two title", "pear plum", "y"), (3, "http://b.org/3", None, "", "")], cols)
    test = spark.createDataFrame([(9, "http://a.com/9", "new title", "apple kiwi kiwi", "x,z"), (8, "http://c.net/8", "one", "kiwi", "z")], cols)
    opts = FeatureOptions(author=False, misspellings=False, grammar_mistakes=False, sentiment=False, lsh_bits=32)
    state = fit_features(train, opts, str(tmp_path / "state"))
    alone = {tuple(r) for r in state.transform(train).collect()}
    before = {tuple(r) for r in state.names.collect()}
    got = {(r.article_id, r.feature): r.value for r in FittedFeatures.load(spark, str(tmp_path / "state"), opts).transform(test.unionByName(train)).collect()}
    assert {k: v for k, v in got.items() if k[0] < 8} == {(r[0], r[2]): r[3] for r in alone}
    assert {tuple(r) for r in state.names.collect()} == before
    assert got[(9, "text_apple")] == 1.0 and not any("kiwi" in f or f == "tag_z" or f == "title_new" for _, f in got)
    assert got[(9, "tag_x")] == 1.0 and got[(9, "source_count")] == 2.0 and got[(8, "source_count")] == 0.0
    assert abs(got[(1, "text_apple")] / got[(1, "text_pear")] - 2 * (np.log(4 / 2) + 1) / (np.log(4 / 3) + 1)) < 1e-12


def _exchanged(df) -> list[str]:
    """What the exchanges of an executed plan are dealt by."""
    import re
    df.collect()
    return re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_words_do_not_move_for_text_features(spark):
    """Exchanges of TF-IDF, misspellings, emotions and the dictionary carry texts and sums, not (id, word) pairs;
    rows that share an id or have none still count as one text (F24 F26 F27 F29 F30 F33 F34 F36)."""
    from pyspark.sql import functions as F
    from newsprism.operators import features as FT
    rows = spark.createDataFrame([(1, "Red red fish"), (1, "red boat"), (2, "blue Boat joy"), (None, "fish x1"), (None, "fish fish"), (3, None), (4, "lone")],
                                 "article_id LONG, text STRING")
    dictionary = FT.corpus_dictionary(rows, "article_id", "text", 2 / 7)
    assert {r.word for r in dictionary.collect()} == {"boat", "fish"}
    lexicon = spark.createDataFrame([("joy", "joy"), ("fish", "trust")], "word STRING, affect STRING")
    made = {"mis": FT.misspelling_rate(rows, dictionary), "sent": FT.emotion_scores(rows, lexicon), "w": FT.tfidf_weights(rows, "article_id", "text")}
    for df in made.values():
        assert not any("term" in keys or "lw" in keys or "token" in keys for keys in _exchanged(df))
    rate = {r.article_id: r.value for r in made["mis"].collect()}
    assert rate == {1: 2 / 5, 2: 2 / 3, None: 1 / 4, 3: 0.0, 4: 1.0}
    tf = FT.term_counts(rows, "article_id", "text")
    plain = FT.weigh(tf, FT.document_frequencies(tf), F.lit(7.0), "article_id")
    want = {(r.article_id, r.term): r.weight for r in plain.collect()}
    got = {(r.article_id, r.term): r.weight for r in made["w"].collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and (None, "fish") in got


def test_words_are_counted_in_their_batch_as_the_long_form_counts_them(spark, monkeypatch):
    """Dictionary and misspellings by batches of texts: null, empty and repeated ids, letters beyond ASCII, capitals."""
    rows = [(1, "The cat's naïve CAT, cat"), (2, "the dog_2 catÉs"), (2, "The the owl"), (3, None), (4, ""), (None, "cat The"), (None, "dog"),
            (5, "42 -- !"), (6, "Straße the dog\u212a")]
    docs = spark.createDataFrame(rows, "article_id LONG, text STRING")
    words = FT.letter_words(docs, "article_id", "text").selectExpr("article_id", "lower(word) AS word").where("word IS NOT NULL").distinct()
    want = {r.word for r in words.groupBy("word").count().where("count >= 0.25 * 9").collect()}
    found = FT.corpus_dictionary(docs, "article_id", "text", 0.25)
    assert {r.word for r in found.collect()} == want == {"the", "cat", "dog"}
    small = sorted((str(r.article_id), r.value) for r in FT.misspelling_rate(docs, found).collect())
    plan = FT.misspelling_rate(docs, found)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan  # no row a word
    monkeypatch.setattr(FT, "MANY_WORDS", 0)
    assert small == sorted((str(r.article_id), r.value) for r in FT.misspelling_rate(docs, found).collect()) and len(small) == 7


def test_ngrams_are_cut_in_one_scan_and_their_counts_stay_in_their_task(spark, monkeypatch):
    """Bigrams beside tokens: no union, one exchange of texts, none of terms; also where frequencies are too many to broadcast."""
    rows = [(1, "Aa bb aa bb cc"), (2, "aa"), (3, None), (4, ""), (None, "bb cc"), (None, "cc bb"), (5, "x yy"), (5, "yy zz yy")]
    docs = spark.createDataFrame(rows, "article_id LONG, text STRING")
    terms = FT.ngram_terms(docs, "article_id", "text", 2)
    assert "Union" not in terms._jdf.queryExecution().toString()
    tri = sorted(r.term for r in FT.ngram_terms(docs.where("article_id = 1"), "article_id", "text", 3).collect())
    assert tri == sorted(["aa", "bb", "aa", "bb", "cc", "aa bb", "bb aa", "aa bb", "bb cc", "aa bb aa", "bb aa bb", "aa bb cc"])
    plans = []
    cut = FT.cut_lineage
    monkeypatch.setattr(FT, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = {}
    for many in (FT.MANY_TERMS, 0):
        monkeypatch.setattr(FT, "MANY_TERMS", many)
        plans.clear()
        weights = FT.tfidf_weights(docs, "article_id", "text", 2)
        assert plans[0].count("Exchange hashpartitioning") == 1 and "term" not in plans[0].split("Exchange hashpartitioning")[1].split(")")[0]
        assert "Window" not in weights._jdf.queryExecution().toString()
        got[many] = {(r.article_id, r.term): round(r.weight, 9) for r in weights.collect()}
    want = FT.weigh(FT.term_counts(docs, "article_id", "text", 2), FT.document_frequencies(FT.term_counts(docs, "article_id", "text", 2)), F.lit(8.0), "article_id")
    assert got[0] == got[max(got)] == {(r.article_id, r.term): round(r.weight, 9) for r in want.collect()}
    assert {t for i, t in got[0] if i == 5} == {"yy", "zz", "yy zz", "zz yy"} and (None, "cc bb") in got[0]
