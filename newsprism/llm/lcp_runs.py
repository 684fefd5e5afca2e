"""Periodic runs of words, found by joining suffix classes in order of
falling common prefix.

A run of a text is a stretch of words with smallest period q, at least
``LEAST`` words and ``TIMES`` * q words long, that no neighbouring word extends
with the same period.  For the texts of a batch:

1. the words are numbered per text and all suffixes are put in order by
   prefix doubling (texts are parted by a number of their own);
2. common prefixes of neighbouring suffixes of one text follow from one sweep over
   its positions (Kasai's method);
3. as Kruskal does with edges, neighbours are united by falling common prefix:
   classes of a union-find, each with its positions in order.  The smaller
   class is put into the larger one position at a time; a position that gets a
   neighbour of the other class at distance d not above the common prefix l
   seeds a repetition of d + l words with period d.  It is a run if the words
   before the two positions differ.

Each run is seeded from its own start: with s its start and L its length, the
suffixes at s and s + q share L - q words and are united at that level, and no
position between them can be in their class (it would give a smaller period).
For the same reason the distance of neighbours in a class is never a multiple of the period.
A run needs a common prefix of ``TIMES - 1`` periods and ``LEAST`` - 1 words at
period 1, so joining stops below that.

Texts are independent: a batch is one task's work, equal texts cost the same
each, and nothing is shuffled.  A very long text is a batch of its own, its
memory in proportion to its length.

Defined results: a null or empty text, or one without words, has no runs and
collapses to the empty text; every row has one result, repeated rows and rows
without doc_id too; an empty table gives an empty table; runs are ordered by
start, then period, and may overlap; further columns are passed on.
Words stand for their 64-bit hash.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from . import textflat
from .groups import bounded_batches, free_name
from .registry import register
from .suffix_order import suffix_order

LEAST, TIMES = 6, 4
#: bytes of text handled at once (a longer text alone)
PART_BYTES = 4 << 20
#: positions in one block of a class
BLOCK = 1024

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Positions:
    """Ordered set of numbers in blocks, so that an insertion moves one block only."""

    __slots__ = ("blocks", "first", "size")

    def __init__(self, one: int):
        self.blocks, self.first, self.size = [[one]], [one], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Put x in; returns the numbers before and after it (-1: none)."""
        b = max(bisect_left(self.first, x) - 1, 0)
        block = self.blocks[b]
        k = bisect_left(block, x)
        before = block[k - 1] if k else -1
        after = block[k] if k < len(block) else (self.first[b + 1] if b + 1 < len(self.first) else -1)
        block.insert(k, x)
        self.first[b] = block[0]
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks.insert(b + 1, block[half:])
            self.first.insert(b + 1, block[half])
            del block[half:]
        return before, after


def common_prefixes(words, suffixes: list[int], joined: list[bool]) -> list[int]:
    """Words that each suffix shares with the one before it in ``suffixes``
    (0 where ``joined`` is false), by a sweep over positions: from one position
    to the next the common prefix falls by one at most."""
    before = {}
    for k in range(1, len(suffixes)):
        if joined[k]:
            before[suffixes[k]] = (suffixes[k - 1], k)
    out = [0] * len(suffixes)
    shared, last = 0, -2
    for i in sorted(before):
        j, k = before[i]
        shared = max(shared - (i - last), 0)
        while words[i + shared] == words[j + shared]:
            shared += 1
        out[k], last = shared, i
    return out


def kruskal_runs(words, suffixes: list[int], joined: list[bool]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text, which ends with a word that occurs
    nowhere else: ``suffixes`` are its positions that share their first words with another
    one, in suffix order, and joined[k] says that k - 1 and k do."""
    shared = common_prefixes(words, suffixes, joined)
    least = min(LEAST - 1, 2 * (TIMES - 1))
    edges = sorted((k for k in range(len(shared)) if shared[k] >= least), key=lambda k: -shared[k])
    parent = list(range(len(suffixes)))
    classes: dict[int, Positions] = {}
    member = {p: k for k, p in enumerate(suffixes)}
    found: set[tuple[int, int, int]] = set()

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for k in edges:
        level, a, b = shared[k], root(k - 1), root(k)
        big, small = classes.pop(a, None) or Positions(suffixes[a]), classes.pop(b, None) or Positions(suffixes[b])
        if big.size < small.size:
            a, b, big, small = b, a, small, big
        rest = list(small)
        for x, following in zip(rest, rest[1:] + [len(words)]):
            for other in big.add(x):
                if other < 0 or other > following:
                    continue
                i, j = min(x, other), max(x, other)
                d = j - i
                if d <= level and d + level >= LEAST and d + level >= TIMES * d:
                    # a neighbour that came with x is not new
                    if root(member[other]) == a and (i == 0 or words[i - 1] != words[j - 1]):
                        found.add((i, d + level, d))
        parent[b] = a
        classes[a] = big
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_numbers(h: np.ndarray, doc_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, at): the words of all texts, numbered per text, with one number of its
    own after each text; at[k] is the place of word k."""
    count = np.diff(doc_words)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(h)) + doc
    _, number = np.unique(textflat.mix64(h ^ textflat.mix64(doc.astype(np.uint64) * textflat._C1)), return_inverse=True)
    out = np.empty(len(h) + len(count), np.int64)
    out[at] = number + len(count)
    out[doc_words[1:] + np.arange(len(count))] = np.arange(len(count))
    return out, at


def runs_of(h: np.ndarray, doc_words: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, from the hashes of its words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(doc_words) - 1)]
    least = min(LEAST - 1, 2 * (TIMES - 1))
    if not len(h):
        return out
    numbers, _ = word_numbers(h, doc_words)
    # only a position whose first words occur again in its text has a common prefix that counts
    gram, where = textflat.window_hashes(numbers.view(np.uint64), np.array([0, len(numbers)]), least)
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    again = np.zeros(len(gram), bool)
    again[1:] |= same
    again[:-1] |= same
    shares = np.zeros(len(numbers), bool)
    shares[where[order[again]]] = True
    firsts = doc_words[:-1] + np.arange(len(out))
    texts = np.unique(np.searchsorted(firsts, np.flatnonzero(shares), side="right") - 1)
    if not len(texts):
        return out
    # the suffixes of the texts that hold such positions
    length = np.diff(np.append(firsts, len(numbers)))[texts]
    starts = np.cumsum(length) - length
    pick = np.repeat(firsts[texts] - starts, length) + np.arange(length.sum())
    part, shares = numbers[pick], shares[pick]
    suffixes = suffix_order(np.unique(part, return_inverse=True)[1])
    suffixes = suffixes[shares[suffixes]]
    doc = np.searchsorted(starts, suffixes, side="right") - 1
    by = np.argsort(doc, kind="stable")
    suffixes, doc = suffixes[by], doc[by]
    joined = np.zeros(len(suffixes), bool)
    joined[1:] = doc[1:] == doc[:-1]
    for k in range(least):
        word = part[np.minimum(suffixes + k, len(part) - 1)]
        joined[1:] &= word[1:] == word[:-1]
    cut = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        t = int(doc[lo])
        words = part[starts[t]:starts[t] + length[t]].tolist()
        out[int(texts[t])] = kruskal_runs(words, (suffixes[lo:hi] - starts[t]).tolist(), joined[lo:hi].tolist())
    return out


def collapsed(data: np.ndarray, off: np.ndarray, starts, ends, doc_words, gone: np.ndarray):
    """(bytes, offsets) of the kept words of each text, joined by one space."""
    count = np.diff(doc_words)
    doc = np.repeat(np.arange(len(count)), count)
    keep = np.flatnonzero(~gone)
    final = np.ones(len(keep), bool)
    final[:-1] = doc[keep[1:]] != doc[keep[:-1]]
    length = ends[keep] - starts[keep]
    size = length + ~final
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()), 0x20, np.uint8)
    total = int(length.sum())
    shift = np.repeat(starts[keep] - (np.cumsum(length) - length), length)
    back = np.repeat(to - (np.cumsum(length) - length), length)
    inner = np.arange(total)
    out[inner + back] = data[inner + shift]
    per = np.bincount(doc[keep], weights=size, minlength=len(count)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per)])


def _kernel(data: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """n_words, runs and collapsed text of each text."""
    starts, ends, doc_words = textflat.words(data, off)
    h = textflat.hash_spans(textflat.padded(data), starts, ends)
    found = runs_of(h, doc_words)
    gone = np.zeros(len(starts) + 1, np.int64)
    flat = []
    for k, runs in enumerate(found):
        for start, length, period in runs:
            gone[doc_words[k] + start + period] += 1
            gone[doc_words[k] + start + length] -= 1
            flat.append((start, length, period))
    out, out_off = collapsed(data, off, starts, ends, doc_words, np.cumsum(gone[:-1]) > 0)
    three = np.array(flat, np.int64).reshape(-1, 3)
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32()),
                                    pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(three[:, c])) for c in range(3)],
                                                               ["start", "length", "period"]))
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found),
                                            [None, pa.py_buffer(out_off.astype(np.int64)), pa.py_buffer(out)])
    return [pa.array(np.diff(doc_words)), runs, text.cast(pa.large_string()).cast(pa.string())]


def find_runs(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with a column ``runs`` (or that name with underscores,
    where taken): struct of n_words, the runs, and the text collapsed to the first period of each run."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    name = free_name(docs, "runs")
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(
        name, T.DataType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string"))])

    def run(batches):
        for batch in batches:
            for part in textflat.pieces(batch, "text", PART_BYTES):
                n_words, runs, text = _kernel(*textflat.flat(part.column(len(kept))))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.StructArray.from_arrays([n_words, runs, text], ["n_words", "runs", "collapsed"])],
                    names=[*kept, name])

    return docs.select(*kept, "text").mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where the texts of one doc_id in ten turn periodic: with
    h = crc32(doc_id) divisible by 10 and n words, each word i >= a becomes
    word a + (i - a) % p, a = (h // 10) % n, p = 1 + (n - a) // (3 + (h // 10) % 8)."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = (docs.where((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
               .select("doc_id", words.alias("w"), F.floor(h / 10).alias("g"))
               .select("doc_id", "w", "g", F.size("w").cast("long").alias("n"))
               .select("doc_id", "w", "n", "g", (F.col("g") % F.col("n")).alias("a"))
               .selectExpr("doc_id", "w", "n", "a", "1 + (n - a) div (3 + g % 8) AS p")
               .selectExpr("doc_id", "array_join(transform(sequence(0L, n - 1), "
                           "i -> element_at(w, int(1 + if(i < a, i, a + (i - a) % p)))), ' ') AS text"))
    rest = docs.where(~F.coalesce((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return rest.select("doc_id", "text").unionByName(changed)


@register("op13_kruskal_runs")
def op13_kruskal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    # greatest length, then smallest start, then smallest period
    longest = F.expr("array_max(transform(runs.runs, r -> struct(r.length AS length, -r.start AS back, -r.period AS small)))")
    lines = F.expr("concat_ws('', transform(runs.runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.select("doc_id", F.col("runs.n_words").alias("n_words"), F.size("runs.runs").cast("long").alias("n_runs"),
                        longest.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("runs.collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.small")).alias("period"),
        F.expr("1000 * best.length div -best.small").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
