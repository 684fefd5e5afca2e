import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from newsprism.llm import lcp_runs as lr
from newsprism.llm.suffix_order import suffix_order

from .conftest import SF


def brute_runs(w):
    """All runs of a list of words, by every period: the longest stretches of it."""
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                stretch = w[i:j + q]
                if not any(all(stretch[k] == stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                    found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(w):
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (len(runs), best[0], best[1], best[2], 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def fields(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


def test_query_matches_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: fields(r) for r in lr.op13_kruskal_runs(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs.itertuples():
        w = brute_words(d.doc_id, d.text)
        if len(w) < 1500:
            assert got[d.doc_id] == digest(w), d.doc_id
    assert sum(r[0] > 0 for r in got.values()) > len(got) // 20


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_made_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        w = [rng.choice("abcdef"[:letters]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice("abcdef"[:letters]) for _ in range(rng.randrange(1, 9))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[:rng.randrange(4 * len(unit), 9 * len(unit) + 1)]
        texts.append(w)
    fib = ["a", "ab"]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    texts += [list(fib[-1]), list("ab" * 40 + "a" * 30 + "ab" * 20), list("abaab" * 12), []]
    counts = np.array([len(t) for t in texts])
    h = np.array([ord(x) for t in texts for x in t], np.uint64)
    got = lr.runs_of(lr.textflat.mix64(h), np.concatenate([[0], np.cumsum(counts)]))
    for w, runs in zip(texts, got):
        assert runs == brute_runs(w), "".join(w)


def test_long_class_in_blocks(monkeypatch):
    monkeypatch.setattr(lr, "BLOCK", 4)
    w = list("abcd" * 300 + "xyz" * 100 + "abcd" * 50)
    h = lr.textflat.mix64(np.array([ord(x) for x in w], np.uint64))
    assert lr.runs_of(h, np.array([0, len(w)])) == [[(0, 1200, 4), (1200, 300, 3), (1500, 200, 4)]]


def test_suffix_order():
    rng = np.random.default_rng(5)
    for size in (1, 2, 40, 300):
        v = np.append(rng.integers(1, 4, size), 0)
        assert suffix_order(v).tolist() == sorted(range(len(v)), key=lambda i: v[i:].tolist())
    assert suffix_order(np.zeros(0, np.int64)).tolist() == []


def test_edges_and_columns(spark, make_docs):
    texts = [None, "", " \t ", "one two", "go " * 6, "go go go go go", ("a b c " * 4).upper(), "x  y\tx y x y x\ny"]
    df = make_docs(texts, runs=["r"] * 8, n_words=["n"] * 8)
    out = lr.find_runs(df)
    assert set(df.columns) - {"text"} < set(out.columns) and "runs_" in out.columns
    got = {r.doc_id: r.runs_ for r in out.collect()}
    assert [got[k].n_words for k in range(8)] == [0, 0, 0, 2, 6, 5, 12, 8]
    assert [[tuple(x) for x in got[k].runs] for k in range(8)] == [[], [], [], [], [(0, 6, 1)], [], [(0, 12, 3)], [(0, 8, 2)]]
    assert [got[k].collapsed for k in range(8)] == ["", "", "", "one two", "go", "go go go go go", "A B C", "x y"]
    assert lr.find_runs(df.limit(0)).count() == 0
    again = df.unionByName(df).unionByName(make_docs(["z " * 7], ids=[None], runs=["r"], n_words=["n"]))
    assert lr.find_runs(again).count() == 17
    none = lr.planted(make_docs(["z " * 7, "u v", None], ids=[None, 7, 8])).collect()
    assert len(none) == 3
