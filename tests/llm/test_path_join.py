import re
from collections import defaultdict

import numpy as np
import pandas as pd

from newsprism.llm import path_join

from .conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]+", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute(texts):
    """{doc_id: (size, component)} by comparing all texts that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    have = defaultdict(list)
    for s, ids in by_set.items():
        for x in s:
            have[x].append(min(ids))
    shared = defaultdict(int)
    for ids in have.values():
        for a in range(len(ids)):
            for b in range(a):
                shared[tuple(sorted((ids[a], ids[b])))] += 1
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    def link(a, b):
        a, b = sorted((root(a), root(b)))
        top[b] = a

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            link(a, b)
    for s, ids in by_set.items():
        if s:
            for i in ids:
                link(i, min(ids))
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_query_matches_brute_force(spark):
    sf = SF.replace("0.001", "0.01")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text.to_dict()
    rows = path_join.op2_path_join(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def family(rng, n, words=120, edits=4):
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, words, edits):
            w[at] = f"e{rng.integers(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_large_nodes_branch_leave_and_block(spark, make_docs, monkeypatch):
    """Small leaves send families through branching, leaving and blocks."""
    rng = np.random.default_rng(3)
    texts = family(rng, 60, edits=5) + family(rng, 60, edits=1) + ["same text again and again today"] * 40
    texts += family(rng, 30, edits=8) + [" ".join(f"u{i}x{j}" for j in range(40)) for i in range(30)]
    monkeypatch.setattr(path_join, "LEAF", 8)
    for levels, held in ((1, 32 << 20), (3, 4096)):
        monkeypatch.setattr(path_join, "LEVELS", levels)
        monkeypatch.setattr(path_join, "FAMILY_BYTES", held)
        rows = path_join.classes(make_docs(texts)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(dict(enumerate(texts)))


def test_edges(spark, make_docs):
    texts = [None, "", "  \n", "one two", "One  TWO", "one", None, "a b c d e", "a b c d e f", "É b c d é", "é b c d é",
             "z " * 5000, "z " * 5001, "long " + "y" * 100_000]
    df = make_docs(texts, node=["n"] * 14, component=["c"] * 14, sig=["s"] * 14)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in path_join.classes(df).collect()}
    assert got == brute(dict(enumerate(texts)))
    kept = path_join.one_of_each(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if i == c}
    twice = df.unionByName(df).unionByName(make_docs(["free", None], ids=[None, None], node=["n"] * 2,
                                                     component=["c"] * 2, sig=["s"] * 2))
    assert path_join.one_of_each(twice).count() == 2 * kept.count() + 2
    assert path_join.classes(df.limit(0)).count() == 0


def test_recall_model():
    assert path_join.trees_for(0.999, 6) == 13 and path_join.trees_for(0.9, 1) < 3
