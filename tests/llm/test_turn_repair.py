import hashlib
import random
import re
import zlib
from functools import lru_cache

import pandas as pd
import pytest
from pyspark.sql import types as T

from newsprism.llm import turn_repair as tr

from .conftest import SF

SHAPE = re.compile(r"(s?(ua)+)?")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))


def brute(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines) by full dynamic programming over (row, roles so far)."""
    rows = in_order(rows)
    faults, seen = [], set()
    for _, _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "." if solid[-1] in ".!?" else "t")
        seen.add((role, text))
    first = [r[2][:1] for r in rows]

    @lru_cache(None)
    def best(i, last, run):
        """(cost, audit) from row i on; last: initials so far that matter; run: rows inserted just before."""
        ways = [(0, "")] if i == len(rows) and last in ("", "a") else []
        new = {"": "u", "s": "u", "u": "a", "a": "u"}[last]
        if run < 2:
            c, x = best(i, new, run + 1)
            ways.append((c + 2, "I" + x))
        if i < len(rows):
            c, x = best(i + 1, last, 0)
            ways.append((c + 3, "D" + x))
            if faults[i] in ".t":
                more = faults[i] == "t"
                if first[i] == new or (first[i] == "s" and last == ""):
                    c, x = best(i + 1, first[i], 0)
                    ways.append((c + more, "K" + x))
                c, x = best(i + 1, new, 0)
                ways.append((c + 2 + more, "R" + x))
        return min(ways) if ways else (10**9, "")

    cost, audit = best(0, "", 0)
    lines, i, last = [], 0, ""
    for e in audit:
        new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last[:1]]
        if e == "K":
            last = rows[i][2]
            lines.append(f"{last}:{rows[i][3]}")
        elif e in "IR":
            last = new
            lines.append(f"{new}:{rows[i][3] if e == 'R' else ''}")
        i += e != "I"
    assert SHAPE.fullmatch("".join(x[:1] for x in lines))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, lines


def digest(rows):
    *stats, lines = brute(rows)
    return (*stats, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def fields(r):
    return r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def make(spark, rows, **extra):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType()), *[T.StructField(k, T.StringType()) for k in extra]])
    return spark.createDataFrame([(*r, *extra.values()) for r in rows], schema)


def test_query_matches_brute_force(spark):
    rows = list(pd.read_parquet(f"{SF}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    damaged = by_conv(brute_damage(rows))
    got = {r.conv_id: fields(r) for r in tr.op12_ida_repair(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, found in got.items():
        assert found == digest(damaged.get(conv, [])), conv
    assert any(f[5] for f in got.values())


def made(rng, n):
    texts = ["Fine.", "Why?", "no end", "", " ", "Yes!", "more words", "Fine. ", "a long end ." + " " * 70]
    return [(rng.randrange(n + 1) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]),
             rng.choice(texts) + ("" if rng.random() < 0.3 else rng.choice("xyz."))) for _ in range(n)]


def test_search_against_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        rows = in_order([(0, *r) for r in made(rng, rng.randrange(12))])
        seen, shape = set(), ""
        for _, _, role, text in rows:
            shape += (role[:1] if role[:1] in tr._AFTER else "?") + tr.fault_of(text, (role, text) in seen)
            seen.add((role, text))
        assert tr.search(shape) == brute(rows)[5:7], shape
        # in chunks of any size the choice is the same
        for size in (1, 3, 5):
            parts = [shape[2 * k:2 * (k + size)] for k in range(0, len(rows), size)]
            found = [[tr.search(x, q, p) or (-1, "") for q in range(4) for p in range(4)] for x in parts]
            chunks = [([c for c, _ in f], [a for _, a in f]) for f in found]
            cost, path, state = tr.choose(chunks)
            audit = "".join(a[4 * q + p] for (_, a), (q, p) in zip(chunks, path)) + tr._END[state][1]
            assert (cost, audit) == tr.search(shape)


@pytest.mark.parametrize("chunk", [256, 4])
def test_made_conversations(spark, monkeypatch, chunk):
    monkeypatch.setattr(tr, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(None if c == 3 else c, *r) for c in range(30) for r in made(rng, 60 if c in (3, 9) else rng.randrange(1, 9))]
    clean = [(c, t, r or " ", x or " ") for c, t, r, x in rows]
    got = {r.conv_id: fields(r) for r in tr.repair(make(spark, rows)).collect()}
    want = by_conv([(c, t, "" if r == " " else r, "" if x == " " else x) for c, t, r, x in clean])
    assert set(got) == set(want)
    for conv in want:
        assert got[conv] == digest(by_conv(rows)[conv]), conv
    lines = {}
    for r in sorted(tr.repaired(make(spark, rows)).collect(), key=lambda r: (r.part, r.chunk, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(lines.get(conv, []) == brute(by_conv(rows)[conv])[-1] for conv in want)


def test_first_occurrences_at_the_bounds_of_the_exchange(spark):
    """Rows that occur first stay so wherever the range exchange cuts."""
    rng = random.Random(5)
    rows = [(c, *r) for c in range(12) for r in made(rng, 40)]
    want = by_conv(rows)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "150"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.conv_id: fields(r) for r in tr.repair(make(spark, rows)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {c for c in want if got[c] != digest(want[c])} == set()


def test_damage_nulls_and_edges(spark, as_table):
    rows = [(None, None, None, None), (None, 1, "user", None), (5, None, "assistant", "x"), (5, 2, None, "y.")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c in range(10, 40) for t in range(2)]
    rows += rows[:8]
    df = make(spark, rows, conv="c", cost="d")
    at = as_table(df, "conversations")
    want = by_conv(brute_damage(rows))
    got = {r.conv_id: fields(r) for r in tr.op12_ida_repair(spark, at).collect()}
    assert set(got) == {r[0] for r in rows} and len(got) == len({r[0] for r in rows})
    assert all(got[c] == digest(want.get(c, [])) for c in got)
    gone = next(c for c in range(10**6) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = as_table(make(spark, [(gone, 0, "user", "a.")]), "conversations")
    assert [fields(r) for r in tr.op12_ida_repair(spark, lost).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert tr.op12_ida_repair(spark, as_table(df.limit(0), "conversations")).count() == 0


def test_long_conversation_is_quick():
    rng = random.Random(8)
    shape = "".join(("u" if k % 2 == 0 else "a") + rng.choice("......t") for k in range(tr.CHUNK) if rng.random() > 0.1)
    cost, edits = tr.search(shape, tr.START, tr.ASSISTANT)
    assert cost >= 0 and sum(e != "I" for e in edits) == len(shape) // 2
