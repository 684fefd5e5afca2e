import math
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest

from newsprism.llm import kneser_ney as kn

from .conftest import SF


def split(text):
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]


class Brute:
    def __init__(self, texts):
        self.c, self.pair = Counter(), Counter()
        for t in texts:
            w = split(t)
            self.c.update(w)
            self.pair.update(zip(["<s>", *w], w))
        self.cont, self.follow = Counter(w for _, w in self.pair), defaultdict(list)
        for (u, _), n in self.pair.items():
            self.follow[u].append(n)
        of = lambda v: [sum(x == k for x in v) for k in (1, 2, 3, 4)]
        self.dp, self.dw = kn.discounts(of(self.pair.values())), kn.discounts(of(self.cont.values()))
        self.n, self.v, self.t = sum(self.c.values()), len(self.c), len(self.pair)
        self.spare = sum(n - self.cut(self.dw, n) for n in self.cont.values()) / self.t
        self.left = {u: sum(n - self.cut(self.dp, n) for n in v) for u, v in self.follow.items()}

    def cut(self, d, n):
        return max(0.0, n - d[min(n, 3)])

    def p(self, u, w):
        low = self.cut(self.dw, self.cont[w]) / self.t + self.spare / (self.v + 1)
        if u not in self.follow:
            return low
        total = sum(self.follow[u])
        return (self.cut(self.dp, self.pair[u, w]) + self.left[u] * low) / total

    def row(self, text):
        w = split(text)
        base = sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), self.n, base, sum(math.log10(self.p(u, x)) for u, x in zip(["<s>", *w], w))


def check(rows, brute, texts):
    for r in rows:
        want = brute.row(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-6)


def test_query_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kn, "BUCKET_TEXTS", 40)
    texts = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text.to_dict()
    rows = kn.op5_kneser_ney(spark, SF).collect()
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    assert len(rows) == len(texts) and all(r.held_out == held[r.doc_id] for r in rows)
    check(rows, Brute([t for i, t in texts.items() if not held[i]]), texts)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one():
    b = Brute(["a b a b c", "a c c a", "b b a", "d"])
    for u in ("<s>", "a", "b", "zz"):
        assert sum(b.p(u, w) for w in [*b.c, "unknown"]) == pytest.approx(1)


def test_edges(spark, make_docs, monkeypatch):
    monkeypatch.setattr(kn, "RUN_TOKENS", 50)
    texts = [None, "", "the end", "The END the end", "a " * 700, "É é", "x" * 5000, " \n", "the end"] * 2
    df = make_docs(texts, ids=[i % 9 for i in range(18)], bucket=["b"] * 18, score=["s"] * 18)
    check(kn.score(df, kn.train(df)).collect(), Brute(texts), texts)
    none = kn.train(df.limit(0))
    rows = kn.score(df, none).collect()
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows) and len(rows) == 18
    assert kn.score(df.limit(0), none).count() == 0
