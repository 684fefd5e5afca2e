import zlib
from collections import defaultdict

import pandas as pd
import pytest

from newsprism.llm import kd_shards

from .conftest import SF


def check(rows, texts, count, slack):
    """Sizes, checksums, gapless slots and near-equal bytes."""
    per, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
        per[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and set(per) <= set(range(count))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(per.values()) / count
    assert max(abs(per[k] - mean) for k in range(count)) <= slack, dict(per)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_balances_bytes(spark, sf):
    at = SF.replace("sf0.001", sf)
    texts = pd.read_parquet(f"{at}/documents.parquet").set_index("doc_id").text.to_dict()
    rows = kd_shards.op4_kd_shards(spark, at).collect()
    sizes = [len(t.encode()) + 1 for t in texts.values()]
    check(rows, texts, 16, 2 * max(sizes) if sf == "sf0.01" else 0.05 * sum(sizes) / 16)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    if sf == "sf0.1":  # equal texts stay together unless their group is large
        groups = defaultdict(list)
        for r in rows:
            groups[texts[r.doc_id]].append(r)
        small = [g for t, g in groups.items() if len(g) > 1 and len(g) * len(t.encode()) < 0.0005 * sum(sizes)]
        assert small and all(len({r.shard for r in g}) == 1 for g in small)


def test_blocks_and_hot_group(spark, make_docs, monkeypatch):
    monkeypatch.setattr(kd_shards, "BLOCK", 7)
    texts = ["one text that a third of all rows hold"] * 200 + [f"text number {i} " * (1 + i % 9) for i in range(400)]
    df = make_docs(texts, langs=[("en", "de", None)[i % 3] for i in range(600)], sources=["hot"] * 300 + ["a", "b", None] * 100,
                   node=["n"] * 600, tie=["t"] * 600, bytes=["b"] * 600)
    check(kd_shards.shards(df).collect(), dict(enumerate(texts)), 16, 400)
    check(kd_shards.shards(df, count=5).collect(), dict(enumerate(texts)), 5, 400)
    assert {r.shard for r in kd_shards.shards(df, target_bytes=10 ** 9).collect()} == {0}


def test_edges(spark, make_docs):
    texts = [None, "", "a", "é" * 100_000]
    df = make_docs(texts, langs=[None] * 4, sources=[None] * 4)
    rows = kd_shards.shards(df).collect()
    check(rows, dict(enumerate(texts)), 16, 300_000)
    assert {r["size"] for r in rows if r.doc_id in (0, 1)} == {1}
    assert kd_shards.shards(df.limit(0)).count() == 0
    same = make_docs(["x"] * 64, ids=[None] * 32 + [1] * 32)
    got = kd_shards.shards(same).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 64 and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_plan_is_native(spark):
    plan = kd_shards.op4_kd_shards(spark, SF)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
