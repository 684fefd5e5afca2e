import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from newsprism.llm import suffix_repeats as sr

from .conftest import SF


def brute(texts):
    """[(n_bytes, n_removed, n_spans, sha)] by a table of all 200-byte strings."""
    raws = [(t or "").encode() for t in texts]
    times = defaultdict(int)
    for r in raws:
        for i in range(len(r) - 199):
            times[hash(r[i:i + 200])] += 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - 199):
            if times[hash(r[i:i + 200])] > 1:
                gone[i] += 1
                gone[i + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0 if r else np.zeros(0, bool)
        rest = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(rest).hexdigest()))
    return out


def check(rows, texts):
    want = brute(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id


def test_query_matches_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    check(sr.op1_suffix_repeats(spark, SF).collect(), docs.text.tolist())


def made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other, line = prose(90), prose(60), "one very common line that is shared by many of the texts here, over eighty bytes " * 2
    texts = [prose(80) + " " + passage + " " + prose(rng.randrange(60)) for _ in range(25)]
    texts += [prose(20) + line + prose(20) for _ in range(20)]
    texts += [prose(30) + other[:rng.randrange(150, len(other))] + prose(5) for _ in range(10)]
    whole = prose(150)
    texts += [whole] * 15 + [whole[:400] + word() + whole[400:]] * 2 + [whole[3:700], whole[:199], whole[:200]]
    texts += ["a" * 1000, "ab" * 300, "a" * 199, "a" * 200, "abc " * 200 + prose(30) + "abc " * 200, None, "", "é" * 150, prose(3000)]
    near = prose(150).split(" ")
    for _ in range(20):
        w = list(near)
        for at in rng.sample(range(len(w)), 2):
            w[at] = word()
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("hot,very", [(1000, 50), (4, 50), (4, 2), (1, 1)])
def test_made_texts_and_hot_names(spark, make_docs, monkeypatch, hot, very):
    monkeypatch.setattr(sr, "HOT", hot)
    monkeypatch.setattr(sr, "VERY_HOT", very)
    texts = made()
    check(sr.digests(make_docs(texts)).collect(), texts)


def test_edges(spark, make_docs):
    texts = [None, "", "x" * 300, "short"]
    df = make_docs(texts, row=["r"] * 4, rest=["s"] * 4, key=["k"] * 4)
    check(sr.digests(df).collect(), texts)
    assert sr.digests(df.limit(0)).count() == 0
    twice = df.unionByName(df).unionByName(make_docs(["y" * 250], ids=[None], row=["r"], rest=["s"], key=["k"]))
    got = sr.digests(twice).collect()
    assert len(got) == 9 and sorted(r.n_removed for r in got) == [0] * 6 + [250, 300, 300]


def test_strip_and_groups(spark, make_docs):
    passage = "the same passage of many words that stands in two texts é " * 6
    texts = ["first " * 3 + passage + "tail one", "second start " + passage + "tail two", None, "clean text", passage + "x" * 3]
    df = make_docs(texts, row=["r"] * 5)
    out = {r.doc_id: r for r in sr.strip(df).collect()}
    assert sr.strip(df).columns == df.columns and out[2].text is None and out[3].text == "clean text"
    for i in (0, 1):
        assert len(out[i].text) < 60 and out[i].n_chars == len(out[i].text)
    groups = sr.repeats(df).collect()
    by = defaultdict(set)
    for g in groups:
        by[g.group].add(texts[g.doc_id].encode()[g.lo:g.hi])
    assert groups and all(len(v) == 1 and len(next(iter(v))) >= 200 for v in by.values())


def test_long_texts_take_the_other_minimum(monkeypatch):
    rng = np.random.default_rng(0)
    h = np.repeat(rng.integers(0, 1 << 64, 700, dtype=np.uint64), rng.integers(1, 4, 700))
    want = sr.least_of_windows(h, 121)
    high = h >> np.uint64(sr._POS)
    assert want.tolist() == [i + int(np.argmin(high[i:i + 121])) for i in range(len(h) - 120)]

    class Long(np.ndarray):
        pass
    monkeypatch.setattr(sr, "_POS", 24)
    big = np.concatenate([h, rng.integers(0, 1 << 64, (1 << 24), dtype=np.uint64)])
    assert sr.least_of_windows(big, 121)[:len(want)].tolist() == want.tolist()


def test_intervals_of_a_known_string():
    text = "xabcyabczabcyab"
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    lcp = [0] + [common(text[a:], text[b:]) for a, b in zip(suffixes, suffixes[1:])]
    before = [ord(text[i - 1]) if i else 256 for i in suffixes]
    found = {(n, text[suffixes[m[0]]:][:n]) for n, m in sr.maximal_intervals(lcp, before) if m}
    assert (6, "abcyab") in found and (3, "abc") in found and not any(s == "bc" for _, s in found)
