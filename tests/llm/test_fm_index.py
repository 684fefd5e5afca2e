import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from newsprism.llm import fm_index as fm

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    """[(n_words, n_hit, n_items, sha, spans of words)] by sets of word tuples."""
    phrases = {}
    for name, text in items:
        w = words(text)
        for i in range(max(len(w) - 9, min(len(w), 1))):
            phrases.setdefault(tuple(w[i:i + 10]), set()).add(name)
    out = []
    for text in docs:
        w = words(text)
        hit, found = np.zeros(len(w), bool), set()
        for m in {len(p) for p in phrases}:
            for i in range(len(w) - m + 1):
                names = phrases.get(tuple(w[i:i + m]))
                if names:
                    hit[i:i + m] = True
                    found |= names
        found = sorted(str(x) for x in found if x is not None)
        out.append((len(w), int(hit.sum()), len(found), hashlib.sha256(",".join(found).encode()).hexdigest()))
    return out


def bench(spark, rows):
    return spark.createDataFrame(rows, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]))


def check(rows, docs, items):
    want = brute(docs, items)
    assert len(rows) == len(docs)
    for r in rows:
        sha = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, sha) == want[r.doc_id], r.doc_id
        assert sum(s.words for s in r.spans) == r.n_hit
        raw = (docs[r.doc_id] or "").encode()
        spans = [words(raw[s.lo:s.hi].decode()) for s in r.spans]
        all_words = words(docs[r.doc_id])
        assert spans == [all_words[s.word:s.word + s.words] for s in r.spans]


def test_query_matches_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = brute(docs.text, zip(items.item_id, items.text))
    got = {r.doc_id: r for r in fm.op11_fm_decontaminate(spark, SF).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs.doc_id, want):
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (*w, w[1] > 0)
    assert any(r.contaminated for r in got.values()) and not all(r.contaminated for r in got.values())


def made(seed=3):
    rng = random.Random(seed)
    prose = lambda n, v=12: " ".join(rng.choice(["Wa", "bé", "c1", "d", "ee", "F", "g", "hh", "ï", "J2", "kk", "l"][:v]) for _ in range(n))
    common = prose(11)
    items = [(i, prose(rng.randrange(8, 40))) for i in range(25)] + [(30 + i, prose(4) + " " + common) for i in range(5)]
    items += [(40, "short one"), (41, "one"), (42, None), (43, " .,"), (44, items[0][1]), (0, items[0][1]), (0, items[1][1]), (None, items[2][1])]
    docs = [prose(rng.randrange(80), rng.choice([3, 12])) for _ in range(40)]
    docs += [prose(20) + "; " + rng.choice(items[:25])[1].upper() + "!" + prose(9) for _ in range(30)]
    docs += [f"x{common}, {common} y", f"x {common}, {common} y", None, "", "...", "one", "Short, ONE short", items[0][1], items[2][1] + prose(3)]
    docs += [items[3][1] + " " + items[3][1]] * 4
    return docs, items


@pytest.mark.parametrize("block,part", [(1 << 21, 1 << 15), (400, 15)])
def test_made_texts_in_one_and_many_blocks(spark, make_docs, monkeypatch, block, part):
    monkeypatch.setattr(fm, "BLOCK_WORDS", block)
    monkeypatch.setattr(fm, "PART_WORDS", part)
    docs, items = made()
    check(fm.contamination(make_docs(docs), bench(spark, items)).collect(), docs, items)


def test_edges(spark, make_docs):
    docs, items = [None, "", "some words here"], [(1, "words")]
    df = make_docs(docs, hits=["h"] * 3, owners=["o"] * 3, item_id=["i"] * 3)
    check(fm.contamination(df, bench(spark, items)).collect(), docs, items)
    for empty in ([], [(1, None)], [(1, " . ")]):
        check(fm.contamination(df, bench(spark, empty)).collect(), docs, empty)
    assert fm.contamination(df.limit(0), bench(spark, items)).count() == 0
    twice = df.unionByName(df).unionByName(make_docs(["words"], ids=[None], hits=["h"], owners=["o"], item_id=["i"]))
    assert sorted(r.n_hit for r in fm.contamination(twice, bench(spark, items)).collect()) == [0, 0, 0, 0, 1, 1, 1]


def test_decontaminate_cuts_the_spans(spark, make_docs):
    item = "the quick brown fox jumps over one lazy dog, twice a day!"
    docs = [f"é before. {item.upper()} after", "clean", None, item]
    df = make_docs(docs, hits=["h"] * 4)
    out = {r.doc_id: r for r in fm.decontaminate(df, bench(spark, [(7, item)])).collect()}
    assert fm.decontaminate(df, bench(spark, [(7, item)])).columns == df.columns
    assert [out[k].text for k in range(4)] == ["é before. ! after", "clean", None, "!"]
    assert out[0].n_chars == len(out[0].text) and out[1].hits == "h"


def test_index_parts():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 7, 500)
    wavelet = fm.WaveletMatrix(values, 3)
    for c in range(7):
        at = np.arange(501)
        rank = wavelet.place(np.full(501, c), at) - wavelet.place(np.full(501, c), np.zeros(501, np.int64))
        assert rank.tolist() == [int((values[:i] == c).sum()) for i in at]
    got, _ = wavelet.follow(np.arange(500))
    assert got.tolist() == values.tolist()
    text = np.append(rng.integers(1, 4, 300), 0)
    text[[50, 51, 200]] = 0
    index = fm.FMIndex(text, 3, sample=5)
    assert sorted(index.locate(np.arange(len(text)))[4:].tolist()) == np.flatnonzero(text).tolist()
    phrase, lo, hi = index.search(np.array([1, 2, 3, 1]), np.array([0, 0, 1, 2]), np.array([1, 3, 2, 2]))
    for p, a, b in zip(phrase, lo, hi):
        want = np.array([1, 2, 3, 1])[[0, 0, 1, 2][p]:][:[1, 3, 2, 2][p]].tolist()
        at = sorted(index.locate(np.arange(a, b)).tolist())
        assert at == [i for i in range(len(text)) if text[i:i + len(want)].tolist() == want]
