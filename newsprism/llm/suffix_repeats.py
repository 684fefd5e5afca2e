"""Repeated passages by an enhanced suffix array, as maximal repeat groups.

Every text is a byte string; a repeat is a string of at least ``SPAN`` bytes
that starts at two or more places.  The work is dealt out so that equal strings
meet and nothing else has to:

1. each ``SPAN``-byte window is named by the least hash among its
   ``GRAM``-byte grams (leftmost of ties); equal windows have equal names.  Names that occur
   once in the whole input end here (counted with partial aggregation);
2. neighbouring windows under one occurrence of a name form a piece of text;
   equal pieces are counted, not repeated;
3. the pieces of one name form one small text collection.  Its suffixes are
   ordered by the key of their first ``SPAN`` bytes, then by the bytes that
   follow, so suffixes that share at least ``SPAN`` bytes are neighbours, as
   in lexicographic order; the array of common-prefix lengths is computed from the
   bytes.  A stack scan over that array walks the common-prefix intervals; an
   interval whose suffixes differ in the byte before them is a maximal
   repeat, and all its suffixes are occurrences of it.

Every repeated window lies in an occurrence of a maximal repeat (extend it to
the left until the bytes before differ), so their union is all that repeats.

A name with more than ``HOT`` occurrences is split by content: its windows go
by their offset to the name in steps of ``STEP`` (beyond ``HOT`` * ``VERY_HOT``
of 1) together with the hash of the bytes that all windows of the step share.
Equal windows still meet, a collection stays bounded, and equal pieces have
been counted before they are shuffled.  Maximal repeats end where a piece ends;
``spans`` joins what touches or overlaps.

Defined results: a null text is empty; texts under ``SPAN`` bytes keep all;
equal texts are removed whole, each of them (repeated rows too); overlapping
repeats inside one text count; rows without doc_id are judged like others; an
empty table gives an empty table; further columns are ignored or passed on.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import textflat
from .groups import Scratch, bounded_batches, free_name, whole_groups
from .registry import register

SPAN, GRAM = 200, 48
HOT, STEP, VERY_HOT = 1000, 10, 50
#: bytes of collections scanned at once (a larger collection is scanned alone)
SCAN_BYTES = 1 << 20
#: bytes of text named at once (a longer text alone)
NAME_BYTES = 1 << 20
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.random.default_rng(21).integers(0, 1 << 64, 256, dtype=np.uint64)
_POS = 24


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""
    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int):
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _prefix(data: np.ndarray) -> np.ndarray:
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[:-1], out=out[1:])
    return out


def gram_hashes(prefix: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of the n bytes from each position."""
    count = len(prefix) - n
    if count <= 0:
        return np.zeros(0, np.uint64)
    _, down = _Powers.get(len(prefix))
    return textflat.mix64((prefix[n:] - prefix[:count]) * down[:count])


def least_of_windows(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the least (upper 40 bits, leftmost of ties) of each w neighbours."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    high = h >> np.uint64(_POS)
    if n < 1 << _POS:
        key = (high << np.uint64(_POS)) | np.arange(n, dtype=np.uint64)
        size = 1
        while size * 2 <= w:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        key = np.minimum(key[:n - w + 1], key[w - size:w - size + n - w + 1])
        return (key & np.uint64((1 << _POS) - 1)).astype(np.int64)
    at, size = np.arange(n), 1

    def lower(a, b):
        return np.where(high[b] < high[a], b, a)

    while size * 2 <= w:
        at = lower(at[:-size], at[size:])
        size *= 2
    return lower(at[:n - w + 1], at[w - size:w - size + n - w + 1])


def names(data: np.ndarray, off: np.ndarray):
    """(windows, position of the name of each, gram hashes): windows are the
    starts of the SPAN-byte windows inside texts."""
    grams = gram_hashes(_prefix(data), GRAM)
    least = least_of_windows(grams, SPAN - GRAM + 1)
    ok = np.zeros(len(data) + 1, np.int32)
    long = np.diff(off) >= SPAN
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - SPAN + 1, -1)
    windows = np.flatnonzero(np.cumsum(ok[:len(least)]) > 0)
    return windows, least[windows], grams


def _name_rows(texts: DataFrame) -> DataFrame:
    """(row, pos, name) of every name occurrence of (row, text)."""
    def run(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text", NAME_BYTES):
                data, off = textflat.flat(piece.column(1))
                windows, least, grams = names(data, off)
                doc = np.searchsorted(off, windows, side="right") - 1
                first = np.flatnonzero((np.diff(least, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
                at, doc = least[first], doc[first]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(doc)), pa.array((at - off[doc]).astype(np.int32)),
                     pa.array(grams[at].view(np.int64))], names=["row", "pos", "name"])

    return texts.select("row", "text").mapInArrow(run, "row bigint, pos int, name bigint")


def _cut_pieces(texts: DataFrame) -> DataFrame:
    """(key, content, row, start, bytes) of the pieces of (row, text, marks),
    where marks are (pos, times) of the names that repeat.  Of equal pieces in
    one batch only the first carries its bytes."""
    def run(batches):
        for batch in batches:
            for part in textflat.pieces(batch, "text", NAME_BYTES):
                data, off = textflat.flat(part.column(1))
                windows, least, grams = names(data, off)
                prefix = _prefix(data)
                _, down = _Powers.get(len(prefix))
                marks = part.column(2)
                size = np.diff(marks.offsets.to_numpy())
                inner = marks.flatten()
                at = np.repeat(off[:-1], size) + inner.field(0).to_numpy()
                times = np.zeros(len(data) + 1, np.int64)
                times[np.minimum(at, len(data))] = inner.field(1).to_numpy()
                stay = times[least] > 1
                win, least = windows[stay], least[stay]
                hot, very = times[least] > HOT, times[least] > HOT * VERY_HOT
                step = np.where(very, least - win, np.where(hot, (least - win) // STEP, -1))
                # one piece: neighbouring windows, same name occurrence, same step
                cut = np.flatnonzero((np.diff(win, prepend=-2) != 1) | (np.diff(least, prepend=-1) != 0)
                                     | (np.diff(step, prepend=-9) != 0))
                lo, key, split = win[cut], grams[least[cut]], step[cut]
                hi = (np.append(win[cut[1:] - 1], win[-1:]) if len(cut) else lo) + SPAN
                h = np.flatnonzero(split >= 0)
                if len(h):
                    # what all windows of the step share: from its last start to its first end
                    width = np.where(very[cut][h], 1, STEP)
                    name_at = least[cut][h]
                    core_lo, core_hi = name_at - split[h] * width, name_at - (split[h] * width + width - 1) + SPAN
                    core = (prefix[core_hi] - prefix[core_lo]) * down[core_lo]
                    key[h] = textflat.mix64(key[h] ^ textflat.mix64(core ^ (split[h].astype(np.uint64) * textflat._C1)))
                doc = np.searchsorted(off, lo, side="right") - 1
                content = textflat.mix64((prefix[hi] - prefix[lo]) * down[lo] ^ (hi - lo).astype(np.uint64))
                _, first = np.unique(textflat.mix64(key) ^ content, return_index=True)
                raw, blobs = data.tobytes(), [None] * len(lo)
                for k in first.tolist():
                    blobs[k] = raw[lo[k]:hi[k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), part.column(0).take(pa.array(doc)),
                     pa.array(lo - off[doc], pa.int64()), pa.array(blobs, pa.binary())],
                    names=["key", "content", "row", "start", "bytes"])

    return texts.select("row", "text", "marks").mapInArrow(
        run, "key bigint, content bigint, row bigint, start bigint, bytes binary")


def maximal_intervals(lcp: list[int], before: list[int]) -> list[tuple[int, list[int]]]:
    """Stack scan over one run of suffixes: lcp[i] is the common prefix of
    suffixes i - 1 and i (lcp[0] unused), before[i] the byte before suffix i
    (256: differs from every other).  Returns the left-diverse intervals, inner
    ones first, as (length, the suffixes for which it is the longest)."""
    found = []
    stack: list[list] = [[0, None, []]]
    n = len(before)

    def merge(top, child):
        top[1] = child[1] if top[1] is None else (top[1] if top[1] == child[1] and top[1] < 256 else 256)
        top[2] += child[2]

    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        last = [0, before[i - 1], [i - 1]]
        while stack[-1][0] > now:
            top = stack.pop()
            merge(top, last)
            if top[1] == 256:
                found.append((top[0], top[2]))
                top[2] = []
            last = top
        if stack[-1][0] < now:
            stack.append([now, last[1], last[2]])
        else:
            merge(stack[-1], last)
    return found


def _order(view, pos, end, run):
    """Suffixes ordered by run, then by the bytes after SPAN up to their end."""
    order = np.argsort(run, kind="stable")
    pos, end, run = pos[order], end[order], run[order]
    todo, at = np.arange(len(pos)), SPAN
    while len(todo):
        rest = np.clip(end[todo] - pos[todo] - at, 0, 8)
        word = view[np.minimum(pos[todo] + at, len(view) - 1)]
        word = np.where(rest == 8, word, np.where(rest == 0, 0, word >> ((8 - rest).astype(np.uint64) * np.uint64(8))
                                                  << ((8 - rest).astype(np.uint64) * np.uint64(8))))
        k = np.lexsort((end[todo] - pos[todo], word, run[todo]))
        src = todo[k]
        pos[todo], end[todo], order[todo] = pos[src], end[src], order[src]
        word, rest, group = word[k], rest[k], run[todo]
        new = (np.diff(group, prepend=-1) != 0) | (np.diff(word, prepend=word[:1]) != 0) | (rest < 8)
        run[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        same = run[todo]
        alone = np.ones(len(todo), bool)
        alone[1:] &= same[1:] != same[:-1]
        alone[:-1] &= same[1:] != same[:-1]
        todo = todo[~alone & (rest == 8)]
        at += 8
    return order


def _common(view, a, b, limit):
    """Bytes that the suffixes at a and b share, at most limit."""
    out = limit.copy()
    todo, at = np.arange(len(a)), 0
    while len(todo):
        x = view[a[todo] + at] ^ view[b[todo] + at]
        low = x & (~x + np.uint64(1))
        differs = np.where(x == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        stop = (x != 0) | (at + 8 >= limit[todo])
        out[todo[stop]] = np.minimum(limit[todo[stop]], at + differs[stop])
        todo = todo[~stop]
        at += 8
    return out


def scan_collections(key: np.ndarray, data: np.ndarray, off: np.ndarray, copies: np.ndarray):
    """Occurrences (piece, from, to, group) of the maximal repeats of the
    collections ``key`` of pieces; a piece counts ``copies`` times."""
    buf = np.concatenate([data, np.zeros(16, np.uint8)])
    whole = np.flatnonzero(copies > 1)
    size = np.diff(off)
    piece, lo, hi = [whole], [np.zeros(len(whole), np.int64)], [size[whole]]
    group = [textflat.mix64(key[whole] ^ textflat.mix64(whole.astype(np.uint64)))]
    count = np.maximum(size - SPAN + 1, 0)
    owner = np.repeat(np.arange(len(size)), count)
    pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + off[owner]
    windows = gram_hashes(_prefix(data), SPAN)
    name = textflat.mix64(windows[pos] ^ textflat.mix64(key[owner])) if len(pos) else np.zeros(0, np.uint64)
    order = np.argsort(name)
    same = name[order[1:]] == name[order[:-1]]
    shared = np.zeros(len(name), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    if len(order):
        run = np.cumsum(np.diff(name[order], prepend=name[order[0]] ^ np.uint64(1)) != 0)
        owner, pos = owner[order], pos[order]
        end = off[owner + 1]
        k = _order(textflat.load8(buf, little=False), pos, end, run)
        owner, pos, end = owner[k], pos[k], end[k]
        lcp = np.zeros(len(pos), np.int64)
        pair = np.flatnonzero(run[1:] == run[:-1]) + 1
        limit = np.minimum(end[pair] - pos[pair], end[pair - 1] - pos[pair - 1])
        lcp[pair] = _common(textflat.load8(buf), pos[pair], pos[pair - 1], limit)
        lcp[lcp < SPAN] = 0
        at = pos - off[owner]
        before = np.where(at == 0, 256, buf[np.maximum(pos - 1, 0)].astype(np.int64))
        first = np.flatnonzero(np.diff(run, prepend=run[0] - 1))
        length = np.diff(np.append(first, len(run)))
        two = first[length == 2]
        two = two[(lcp[two + 1] > 0) & ((before[two] != before[two + 1]) | (before[two] == 256))]
        who, far = [np.concatenate([two, two + 1])], [np.tile(lcp[two + 1], 2)]
        code = [np.tile(two, 2)]
        for a, m in zip(first[length > 2].tolist(), length[length > 2].tolist()):
            for size_, members in maximal_intervals(lcp[a:a + m].tolist(), before[a:a + m].tolist()):
                if members:
                    who.append(np.array(members) + a)
                    far.append(np.full(len(members), size_))
                    code.append(np.full(len(members), a + members[0]))
        who, far, code = np.concatenate(who), np.concatenate(far), np.concatenate(code)
        piece.append(owner[who])
        lo.append(at[who])
        hi.append(at[who] + far)
        group.append(textflat.mix64(name[order][k][who] ^ textflat.mix64(code.astype(np.uint64)) ^ far.astype(np.uint64)))
    return (np.concatenate(x) for x in (piece, lo, hi, group))


def _scan(contents: DataFrame) -> DataFrame:
    """(key, content, lo, hi, group) over collections (key, content, bytes, copies)."""
    def run(batches):
        for part in whole_groups(batches, "key"):
            key = part.column("key").to_numpy().view(np.uint64)
            copies, content = part.column("copies").to_numpy(), part.column("content").to_numpy()
            data, off = textflat.flat(part.column("bytes"))
            edges = np.append(np.flatnonzero(np.diff(key, prepend=key[0] ^ np.uint64(1))), len(key))
            a = 0
            while a < len(edges) - 1:
                b = max(a + 1, int(np.searchsorted(off[edges], off[edges[a]] + SCAN_BYTES, side="right")) - 1)
                x, y = edges[a], edges[min(b, len(edges) - 1)]
                piece, lo, hi, group = scan_collections(key[x:y], data[off[x]:off[y]], off[x:y + 1] - off[x], copies[x:y])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[x:y][piece].view(np.int64)), pa.array(content[x:y][piece]), pa.array(lo), pa.array(hi),
                     pa.array(group.view(np.int64))], names=["key", "content", "lo", "hi", "group"])
                a = min(b, len(edges) - 1)

    return (contents.select("key", "content", "bytes", "copies").repartition("key").sortWithinPartitions("key")
            .mapInArrow(run, "key bigint, content bigint, lo bigint, hi bigint, group bigint"))


def _marked(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, text, marks) of the texts that hold a name found twice."""
    found = scratch.put(_name_rows(texts), "names")
    # written first: both sides of the join are then plain shuffles, whose hot names Spark can split
    twice = scratch.put(found.groupBy("name").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "twice")
    marks = (found.join(twice, "name").groupBy("row")
             .agg(F.collect_list(F.struct("pos", "times")).alias("marks")))
    # a merge join at every size: marks grow with the input
    marked = scratch.put(texts.select("row", "text").join(marks.hint("merge"), "row"), "marked")
    scratch.drop("names", "twice")
    return marked


def occurrences(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """(group, row, lo, hi): all occurrences of all maximal repeat groups of the
    texts from ``_marked``; group names the repeated string."""
    pieces = scratch.put(_cut_pieces(marked), "pieces")
    contents = pieces.groupBy("key", "content").agg(F.first("bytes", ignorenulls=True).alias("bytes"),
                                                    F.count(F.lit(1)).alias("copies"))
    found = scratch.put(_scan(contents), "intervals")
    return (pieces.select("key", "content", "row", "start").join(found, ["key", "content"])
            .select("group", "row", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")))


def repeats(docs: DataFrame) -> DataFrame:
    """(group, doc_id, lo, hi): the maximal repeat groups of ``docs``, every
    occurrence as a byte span of its text."""
    bounded_batches(docs.sparkSession)
    texts, scratch = _rows(docs), Scratch(docs.sparkSession)
    return occurrences(_marked(texts, scratch), scratch).join(texts.select("row", "doc_id").distinct(), "row").select(
        "group", "doc_id", "lo", "hi").distinct()


def spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, text, spans) of every text with repeats; spans are unordered."""
    marked = _marked(texts, scratch)
    per_row = scratch.put(occurrences(marked, scratch).groupBy("row").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans")), "spans")
    scratch.drop("pieces", "intervals")
    return marked.join(per_row, "row").select("row", "text", "spans")


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text); row names the doc_id and the text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def merged(found) -> list[tuple[int, int]]:
    """Spans in order, joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in cut:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _apply(found: DataFrame, one, schema: str, columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """(row, *one(bytes, ordered spans)) of (row, text, spans), once for equal rows."""
    def run(batches):
        for batch in batches:
            data, off = textflat.flat(batch.column(1))
            raw = data.tobytes()
            rows = [one(raw[a:b], merged((s["lo"], s["hi"]) for s in cut))
                    for a, b, cut in zip(off[:-1].tolist(), off[1:].tolist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(columns)]],
                names=["row", *[n for n, _ in columns]])

    return found.mapInArrow(run, schema).dropDuplicates(["row"])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    bounded_batches(docs.sparkSession)
    texts = _rows(docs)

    def one(raw, cut):
        return sum(b - a for a, b in cut), len(cut), hashlib.sha256(without(raw, cut)).hexdigest()

    scratch = Scratch(docs.sparkSession)
    done = _apply(spans(texts, scratch), one, "row bigint, n_removed bigint, n_spans bigint, rest string",
                  [("n_removed", pa.int64()), ("n_spans", pa.int64()), ("rest", pa.string())])
    done = scratch.put(done, "done")
    scratch.drop("marked", "spans")
    text = F.coalesce("text", F.lit(""))
    base = texts.select("row", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        F.sha2(text.cast("binary"), 256).alias("whole"))
    return base.join(done, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("rest", "whole").alias("kept_sha256"))


def strip(docs: DataFrame) -> DataFrame:
    """Pipeline stage: texts without their repeated bytes (a character cut in
    the middle goes whole); ``n_chars`` follows.  A text of which only white
    space would be left goes with its row."""
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    name, new = free_name(docs, "row"), free_name(docs, "rest")

    def one(raw, cut):
        return (without(raw, cut).decode("utf-8", "ignore"),)

    scratch = Scratch(docs.sparkSession)
    done = scratch.put(_apply(spans(_rows(docs), scratch), one, "row bigint, rest string", [("rest", pa.string())]), "rests")
    scratch.drop("marked", "spans")
    joined = docs.withColumn(name, F.xxhash64("doc_id", "text")).join(
        done.select(F.col("row").alias(name), F.col("rest").alias(new)).hint("merge"), name, "left")
    joined = joined.where(F.col(new).isNull() | F.col(new).rlike(r"\S"))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new).cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return joined.withColumn("text", F.coalesce(new, "text")).select(*columns)


@register("op1_suffix_repeats")
def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
