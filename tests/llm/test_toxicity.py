import random

import numpy as np
import pandas as pd

from newsprism.llm import toxicity
from newsprism.llm.toxicity import Lexicon, fold

from .conftest import SF


def test_fold():
    assert fold("Ídiоt$$$ 1D10T  ｓｃｕｍ\n<l0ser>") == " idiot idiot scum ioser "
    assert fold(None) == fold("") == " " and fold("...") == "  "


def test_matches_equal_naive_search():
    rng = random.Random(2)
    entries = {" ab": 1.0, " abc": 3.0, " ca ": 2.0, " bb": 1.5}
    lexicon = Lexicon(entries, [" abca ", " bb ab "])
    patterns = {**entries, **{e: 0.0 for e in lexicon.exceptions}}
    for _ in range(300):
        text = fold(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(8)))
        want = {}
        for s in range(len(text)):
            best = max((p for p in patterns if text.startswith(p, s)), key=len, default=None)
            if best and patterns[best]:
                want[s] = (len(best), patterns[best])
        assert lexicon.matches(text) == want


def test_held_out_quality(spark):
    sf = SF.replace("0.001", "0.1")
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")
    rows = toxicity.op3_toxicity(spark, sf).toPandas().set_index("doc_id")
    assert len(rows) == 10_000 and rows.score.between(0, 1).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    out = rows[rows.held_out].join(labels, how="inner")
    caught = out.predicted[out.toxic == 1].mean()
    alarms = out.predicted[out.toxic == 0].mean()
    assert caught > 0.85 and alarms < 0.01, (caught, alarms)


def test_edges(spark, make_docs, as_table):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(words, 30)) for _ in range(300)]
    toxic = [" ".join([*rng.choice(words, 30), "nastyword", *rng.choice(words, 5)]) for _ in range(60)]
    texts = clean + toxic + [None, "", "n4styw0rd", "nаstyword " * 3, "long " * 100_000, clean[0]]
    n = len(texts)
    df = make_docs(texts, family=["f"] * n, score=["s"] * n, toxic=["x"] * n)
    at = as_table(df)
    labels = spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(360)] + [(None, 1, 1), (5, 1, None), (5, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    as_table(labels, "labels", at)
    rows = toxicity.op3_toxicity(spark, at).toPandas().set_index("doc_id").sort_index()
    assert len(rows) == n
    assert rows.predicted[300:360].mean() > 0.95 and rows.predicted[:300].sum() == 0
    assert rows.predicted[[360, 361, 364, 365]].sum() == 0 and rows.predicted[[362, 363]].sum() == 2
    none = toxicity.learn(toxicity.labelled_sample(df, labels.limit(0)))
    assert toxicity.scores(df, none).agg({"score": "max"}).first()[0] < 1e-9
    assert toxicity.scores(df.limit(0), none).count() == 0


def test_sample_leaves_out_only_near_copies(spark, make_docs):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words, 30))
    shared = [f"{line} {' '.join(rng.choice(words, 60))}" for _ in range(60)]
    copied = " ".join(rng.choice(words, 400)).split()
    copies = [" ".join([*copied[:k], "changed", *copied[k + 1:]]) for k in (50, 150, 250)]
    texts = [*shared, *copies, copies[0], copies[1], "", None, "one two", "one two", "one three"]
    toxic = [i % 2 for i in range(60)] + [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id bigint, toxic int")
    kept = {r.doc_id: r.toxic for r in toxicity.labelled_sample(make_docs(texts), labels).collect()}
    assert all(kept.get(i) == toxic[i] for i in range(60))  # one line in common is no copy
    assert kept.get(64) == 1  # a toxic copy of a clean text stays
    assert 60 in kept and 63 not in kept  # an exact copy goes
    assert {65, 67, 69} <= kept.keys() and not {66, 68} & kept.keys()
