import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from newsprism.llm import bestfit

from .conftest import SF


def naive(sizes, clusters, sources, capacity, per_source):
    bins, out = [], []
    for n, c, s in zip(sizes, clusters, sources):
        best = None
        for k, (used, cs, ss) in enumerate(bins):
            if capacity - used >= n and (c is None or c not in cs) and (s is None or ss[s] < per_source):
                if best is None or (capacity - used, k) < (capacity - bins[best][0], best):
                    best = k
        if best is None:
            best = len(bins)
            bins.append((0, set(), Counter()))
        used, cs, ss = bins[best]
        cs.add(c)
        ss[s] += 1
        bins[best] = (used + n, cs, ss)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_naive_search(seed):
    rng = np.random.default_rng(seed)
    n = 300
    sizes = sorted(rng.integers(1, 40, n).tolist(), reverse=True)
    clusters = [None if x == 0 else int(x) for x in rng.integers(0, 60, n)]
    sources = [None if x == 0 else f"s{min(x, 4)}" for x in rng.integers(0, 9, n)]
    assert bestfit.best_fit(sizes, clusters, sources, 50, 3) == naive(sizes, clusters, sources, 50, 3)


def check(rows, docs, capacity, per_source):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) + 1 for i, t in docs.text.items()}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r["size"]
    assert got == Counter(size)
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r.piece)
        bins[r.bin_id].append(r)
    assert all(sorted(p) == list(range(len(p))) for p in pieces.values())
    for b in bins.values():
        assert sum(r["size"] for r in b) == b[0].bin_used <= capacity
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r["size"]
        clusters = Counter(r.cluster for r in b if r.cluster is not None)
        sources = Counter(r.source for r in b if r.source is not None)
        assert max(clusters.values(), default=1) == 1 and max(sources.values(), default=0) <= per_source
    return len(bins), sum(size.values())


def test_query_packs_whole_table(spark):
    docs = pd.read_parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").set_index("doc_id")
    n, total = check(bestfit.op9_bestfit(spark, SF.replace("0.001", "0.01")).collect(), docs, bestfit.CAPACITY, bestfit.PER_SOURCE)
    assert n <= 1.15 * total / bestfit.CAPACITY + 2


def test_hot_groups_and_edges(spark, make_docs):
    texts = [None, "", " \n", "w " * 25, "w " * 9, "w " * 10, "x"] + ["copy of one text"] * 60 + [f"t{i} a b" for i in range(60)]
    sources = [None, "a", "a", "b", None, "b", "b"] + ["hot"] * 90 + ["cold"] * 30
    df = make_docs(texts, sources=sources, size=["1"] * len(texts), cluster=["c"] * len(texts), pack_group=["g"] * len(texts))
    docs = pd.DataFrame({"text": texts})
    for rows in (4096, 30):
        check(bestfit.pack(df, capacity=10, per_source=2, group_rows=rows).collect(), docs, 10, 2)
    twice = bestfit.pack(df.unionByName(df), capacity=10).collect()
    assert sum(r["size"] for r in twice) == 2 * sum(len((t or "").split()) + 1 for t in texts)
    assert bestfit.pack(df.limit(0)).count() == 0
    none = bestfit.pack(make_docs(["a", "a"], ids=[None, None], sources=[None, None])).collect()
    assert len({r.bin_id for r in none}) == 2
    with pytest.raises(ValueError):
        bestfit.pack(df, capacity=0)
