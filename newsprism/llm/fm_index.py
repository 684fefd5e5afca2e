"""Benchmark decontamination by an FM-index of each training shard.

Words are runs of digits, lower-cased letters and non-ASCII characters.  A
phrase is ``PHRASE`` consecutive words of a benchmark text, or the whole text
if it has fewer; a document word is hit if it lies inside an occurrence of a phrase.

1. Distinct benchmark texts become word-hash lists, cut into overlapping parts and
   dealt to blocks of at most ``BLOCK_WORDS`` words.  A block (its size is counted
   first) is the only thing that is broadcast; more blocks mean more passes, each
   one adding its hits to what the passes before it found.
2. A task cuts its documents into shards of ``SHARD_BYTES`` (a longer text alone).
   Words outside the block's vocabulary cannot be in a phrase: they part the shard into
   sequences, and those shorter than the shortest phrase are left out.  The
   others are indexed: suffix order by prefix doubling (each sequence ends with a
   separator of its own), the Burrows-Wheeler transform in a wavelet matrix of rank bit
   vectors, and the text position of every ``SAMPLE``-th symbol and of each sequence start.
3. All phrases are searched backwards at once, two ranks a step; the suffix
   ranges that stay are located by last-to-first steps to the next sampled position.
4. Occurrences are merged to spans.  Phrases with the same benchmark texts share an
   owner number; documents carry the owners they hold, and the item lists are made
   once for each distinct set of owners, by joins.

Defined results: null has no words; empty documents and items have none; items
with a null id mark words and are not listed; repeated items count once; every row
of ``docs`` has one result, repeated rows and rows without doc_id too; an empty
benchmark hits nothing; further columns are passed on.  Memory of a
task follows the shard, or the longest text.  Words stand for their 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table
from . import textflat
from .groups import Scratch, bounded_batches, free_name
from .registry import register
from .suffix_order import suffix_order

PHRASE = 10
SHARD_BYTES = 8 << 20
#: words of a broadcast block (8 bytes each, and as much again for its phrases)
BLOCK_WORDS = 1 << 21
#: words of one part of a benchmark text
PART_WORDS = 1 << 15
SAMPLE = 16

HITS = "struct<n_words:bigint,n_hit:bigint,spans:array<struct<word:bigint,words:bigint,lo:bigint,hi:bigint>>,owners:array<bigint>>"

_BETWEEN = np.ones(256, bool)
_BETWEEN[0x30:0x3A] = _BETWEEN[0x61:0x7B] = _BETWEEN[0x80:] = False


class Bits:
    """Bit vector with rank: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        room = np.zeros((len(bits) // 64 + 1) * 64, bool)
        room[:len(bits)] = bits
        self.words = np.packbits(room, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Numbers of a given width, one bit vector a level from the highest bit on."""

    def __init__(self, values: np.ndarray, width: int):
        self.levels = []
        for b in range(width - 1, -1, -1):
            one = (values >> b) & 1 == 1
            self.levels.append((b, Bits(one), len(values) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i numbers end on the path of c: rank of c, plus a number that only c fixes."""
        for b, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> b) & 1 == 1, zeros + ones, i - ones)
        return i

    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The i-th number and its place."""
        c = np.zeros(len(i), np.int64)
        for b, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            c |= one.astype(np.int64) << b
        return c, i


class FMIndex:
    """FM-index of symbols 1..size; zeros part the sequences, and the last one is a zero."""

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        n = len(symbols)
        ends = symbols == 0
        values = symbols + int(ends.sum())
        values[ends] = np.arange(int(ends.sum()))
        order = suffix_order(values)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size + 1))])
        self.last = WaveletMatrix(symbols[order - 1], size.bit_length())
        every = np.arange(size + 1)
        self.shift = self.first[:-1] - self.last.place(every, np.zeros(size + 1, np.int64))
        known = (order % sample == 0) | ends[order - 1]
        self.known, self.position, self.n = Bits(known), order[known], n

    def search(self, stream: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of the phrases stream[start : start + length] that occur, by
        backward search: the suffixes lo..hi-1 begin with the phrase."""
        who = np.arange(len(start))
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        done = []
        for step in range(1, int(length.max(initial=0)) + 1):
            c = stream[start[who] + length[who] - step]
            lo = self.shift[c] + self.last.place(c, lo)
            hi = self.shift[c] + self.last.place(c, hi)
            stay = lo < hi
            who, lo, hi = who[stay], lo[stay], hi[stay]
            full = length[who] == step
            done.append((who[full], lo[full], hi[full]))
            who, lo, hi = who[~full], lo[~full], hi[~full]
            if not len(who):
                break
        if not done:
            return who, lo, hi
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one, which are added."""
        out = np.zeros(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            known = self.known.get(rows)
            out[todo[known]] = self.position[self.known.rank(rows[known])] + steps
            todo, rows = todo[~known], rows[~known]
            c, at = self.last.follow(rows)
            rows = self.shift[c] + at
            steps += 1
        return out


def _text_words(col):
    data, off = textflat.flat(col)
    low = textflat.lower_ascii(data)
    starts, ends, doc_words = textflat.words(low, off, _BETWEEN)
    return starts, ends, doc_words, textflat.hash_spans(textflat.padded(low), starts, ends), off


def _parts(texts: DataFrame) -> DataFrame:
    """(class, part, words) of (class, text): the word hashes in parts that overlap by a phrase less one word."""
    def run(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                _, _, doc_words, h, _ = _text_words(piece.column(1))
                cls, part, rows = [], [], []
                for k, name in enumerate(piece.column(0).to_pylist()):
                    own = h[doc_words[k]:doc_words[k + 1]].view(np.int64)
                    for at in range(0, max(len(own) - PHRASE + 1, min(len(own), 1)), PART_WORDS):
                        cls.append(name)
                        part.append(at)
                        rows.append(own[at:at + PART_WORDS + PHRASE - 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls, pa.int64()), pa.array(part, pa.int64()), pa.array(rows, pa.list_(pa.int64()))],
                    names=["class", "part", "words"])

    return texts.select("class", "text").mapInArrow(run, "class bigint, part bigint, words array<bigint>")


class Block:
    """Phrases of one block in numbers: vocabulary, word stream, phrase starts and lengths, and the owner of each phrase."""

    def __init__(self, rows: pa.Table, base: int):
        words = rows.column("words").combine_chunks()
        off = words.offsets.to_numpy()
        h = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        count = np.diff(off)
        self.vocabulary, number = np.unique(h, return_inverse=True)
        self.stream = number.astype(np.int64) + 1
        full = np.maximum(count - PHRASE + 1, 0)
        short = np.flatnonzero((count > 0) & (count < PHRASE))
        part = np.concatenate([np.repeat(np.arange(len(count)), full), short])
        inner = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
        start = off[part] + np.concatenate([inner, np.zeros(len(short), np.int64)])
        length = np.minimum(count[part], PHRASE)
        # one phrase for equal ones, by two hashes of its words
        a, b = length.astype(np.uint64), ~length.astype(np.uint64)
        for k in range(PHRASE):
            word = np.where(k < length, h[np.minimum(start + k, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else a
            a, b = textflat.mix64(a * textflat._C1 + word), textflat.mix64((b ^ word) * textflat._C3)
        _, first, phrase = np.unique(np.stack([a, b], axis=1), axis=0, return_index=True, return_inverse=True)
        self.start, self.length = start[first].astype(np.int64), length[first].astype(np.int64)
        # phrases with the same texts have one owner number
        cls = rows.column("class").to_numpy()[part] if len(part) else np.zeros(0, np.int64)
        pair = np.unique(np.stack([phrase.ravel().astype(np.int64), cls], axis=1), axis=0)
        name = textflat.mix64(pair[:, 1].astype(np.uint64) + np.uint64(1))
        cut = np.flatnonzero(np.diff(pair[:, 0], prepend=-1))
        if len(cut):
            sets = np.stack([np.add.reduceat(name, cut), np.bitwise_xor.reduceat(textflat.mix64(name), cut),
                             np.diff(np.append(cut, len(pair))).astype(np.uint64)], axis=1)
            _, example, owner = np.unique(sets, axis=0, return_index=True, return_inverse=True)
            self.owner = owner.ravel().astype(np.int64) + base
            size = np.diff(np.append(cut, len(pair)))[example]
            at = np.repeat(cut[example] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.members = pa.table({"owner": np.repeat(np.arange(len(example)) + base, size), "class": pair[at, 1]})
        else:
            self.owner = np.zeros(0, np.int64)
            self.members = pa.table({"owner": pa.array([], pa.int64()), "class": pa.array([], pa.int64())})


def occurrences(block: Block, h: np.ndarray, doc_words: np.ndarray):
    """(word, words, owner) of every occurrence of the block's phrases in a shard of texts."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(block.start):
        return none, none, none
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    known = block.vocabulary[at] == h
    # sequences of known words inside one text, as long as the shortest phrase at least
    begins = np.zeros(len(h) + 1, bool)
    begins[doc_words[:-1]] = True
    place = np.flatnonzero(known)
    if not len(place):
        return none, none, none
    new = (np.diff(place, prepend=-2) != 1) | begins[place]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(place)))
    keep = np.repeat(size >= block.length.min(), size)
    place, new = place[keep], new[keep]
    if not len(place):
        return none, none, none
    to = np.arange(len(place)) + np.cumsum(new) - 1
    symbols = np.zeros(len(place) + int(new.sum()), np.int64)
    symbols[to] = at[place] + 1
    word_at = np.zeros(len(symbols), np.int64)
    word_at[to] = place
    index = FMIndex(symbols, len(block.vocabulary))
    phrase, lo, hi = index.search(block.stream, block.start, block.length)
    count = hi - lo
    rows = np.arange(count.sum()) + np.repeat(lo - (np.cumsum(count) - count), count)
    which = np.repeat(phrase, count)
    return word_at[index.locate(rows)], block.length[which], block.owner[which]


def _merged(starts, ends, doc_words, off, covered: np.ndarray):
    """Covered words as (spans per text, word, words, lo, hi) with byte positions inside texts."""
    n = len(covered)
    inner = np.zeros(n + 1, bool)
    inner[doc_words] = True
    change = np.diff(covered.astype(np.int8), prepend=0)
    first = np.flatnonzero(covered & ((change == 1) | inner[:n]))
    last = np.flatnonzero(covered & (np.append(~covered[1:], True) | inner[1:])) if n else first
    doc = np.searchsorted(doc_words, first, side="right") - 1
    return np.bincount(doc, minlength=len(off) - 1), first - doc_words[doc], last - first + 1, starts[first] - off[doc], ends[last] - off[doc]


def _list(values: pa.Array, count: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values)


def _pass(docs: DataFrame, keep: list[str], text: str, hits: str, value) -> DataFrame:
    """``docs`` with the hits of one block added to what column ``hits`` holds (if it is there)."""
    before = hits in docs.columns
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(hits, T.DataType.fromDDL(HITS))])

    def run(batches):
        block = value.value
        for batch in batches:
            for part in textflat.pieces(batch, text, SHARD_BYTES):
                starts, ends, doc_words, h, off = _text_words(part.column(part.schema.get_field_index(text)))
                word, words, owner = occurrences(block, h, doc_words)
                doc = np.searchsorted(doc_words, word, side="right") - 1
                if before:
                    old = part.column(part.schema.get_field_index(hits))
                    spans, owners = old.field("spans"), old.field("owners")
                    n, m = np.diff(spans.offsets.to_numpy()), np.diff(owners.offsets.to_numpy())
                    inner = spans.flatten()
                    word = np.concatenate([word, inner.field("word").to_numpy() + np.repeat(doc_words[:-1], n)])
                    words = np.concatenate([words, inner.field("words").to_numpy()])
                    doc = np.concatenate([doc, np.repeat(np.arange(len(m)), m)])
                    owner = np.concatenate([owner, owners.flatten().to_numpy()])
                covered = np.zeros(len(h) + 1, np.int64)
                np.add.at(covered, word, 1)
                np.add.at(covered, word + words, -1)
                covered = np.cumsum(covered[:-1]) > 0
                count, *spans = _merged(starts, ends, doc_words, off, covered)
                total = np.concatenate([[0], np.cumsum(covered)])
                pair = np.unique(np.stack([doc, owner], axis=1), axis=0)
                found = pa.StructArray.from_arrays(
                    [pa.array(np.diff(doc_words), pa.int64()), pa.array(np.diff(total[doc_words]), pa.int64()),
                     _list(pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in spans], ["word", "words", "lo", "hi"]), count),
                     _list(pa.array(np.ascontiguousarray(pair[:, 1]), pa.int64()), np.bincount(pair[:, 0], minlength=part.num_rows))],
                    ["n_words", "n_hit", "spans", "owners"])
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in keep], found],
                                                 names=[*keep, hits])

    return docs.select(*dict.fromkeys([*keep, text, *([hits] if before else [])])).mapInArrow(run, schema)


def _blocks(parts: DataFrame) -> tuple[DataFrame, int]:
    """(class, part, words, block) and the number of blocks, none of them above ``BLOCK_WORDS``."""
    size = F.size("words").cast("long")
    total = parts.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // BLOCK_WORDS))
    while True:
        dealt = parts.withColumn("block", F.pmod(F.xxhash64("class", "part"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= max(BLOCK_WORDS, PART_WORDS + PHRASE):
            return dealt, n
        n *= 2


def marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], hits: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(documents, members): columns ``keep`` and the struct ``hits`` (n_words, n_hit, spans of words and
    bytes, owners) of every document; members are (owner, class, item_id)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    texts = scratch.put(items.select("text").distinct().withColumn("class", F.monotonically_increasing_id()), "texts")
    parts, n = _blocks(scratch.put(_parts(texts), "parts"))
    owners = None
    for b in range(n):
        block = Block(parts.where(F.col("block") == b).select("class", "words").toArrow(), b << 32)
        value = spark.sparkContext.broadcast(block)
        final = b == n - 1
        kept = keep if final else list(dict.fromkeys([*keep, "text"]))
        docs = scratch.put(_pass(docs, kept, "text", hits, value), f"marked-{b}")
        if b:
            scratch.drop(f"marked-{b - 1}")
        value.destroy()
        own = spark.createDataFrame(block.members)
        owners = own if owners is None else scratch.put(owners.unionByName(own), f"owners-{b}")
    members = (owners.join(texts, "class").join(items, "text").select("owner", "class", "item_id"))
    return docs, members


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) of every document: items are the
    ids whose phrases occur, sorted as strings; spans are merged (word, words, lo, hi), in
    words and bytes of the text."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    found, members = marked(docs.select("doc_id", "text"), benchmark, ["doc_id"], "hits", scratch)
    found = found.select("doc_id", "hits.*")
    # the lists are made once for each distinct set of owners, and joined to the documents that have any
    lists = (found.where("size(owners) > 0").select("owners").distinct()
             .select("owners", F.explode("owners").alias("owner")).join(members, "owner")
             .groupBy("owners").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    none = F.array().cast("array<string>")
    listed = found.where("size(owners) > 0").join(lists, "owners").unionByName(
        found.where("size(owners) = 0").withColumn("items", none))
    return listed.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit span cut out of its text (from the first byte of its first word to the last
    byte of its last); ``n_chars`` follows.  Rows stay, also those of which little is left."""
    bounded_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    columns, hits = docs.columns, free_name(docs, "hits")
    found, _ = marked(docs, benchmark, columns, hits, scratch)
    schema, text = docs.select(*columns).schema, columns.index("text")

    def cut(batches):
        for batch in batches:
            old = batch.column(text).to_pylist()
            new = []
            for t, s in zip(old, batch.column(len(columns)).field("spans").to_pylist()):
                if s:
                    raw, at, rest = t.encode(), 0, []
                    for span in s:
                        rest.append(raw[at:span["lo"]])
                        at = span["hi"]
                    t = b"".join([*rest, raw[at:]]).decode()
                new.append(t)
            arrays = batch.columns[:-1]
            arrays[text] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = found.select(*columns, hits).mapInArrow(cut, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns)
    return out


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
#: phrases as strings of words, joined by equality; doc_id names a row
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), {PHRASE}) AS n, unnest(range(1, greatest(len(w) - {PHRASE - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0),
phrases AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM starts),
places AS (SELECT doc_id, w, l.n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM phrases) l WHERE len(w) >= l.n),
hits AS (SELECT s.doc_id, s.i, s.n, p.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM places) s
         JOIN phrases p ON s.n = p.n AND s.p = p.p),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits))
          GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


@register("op11_fm_decontaminate", sql=ORACLE)
def op11_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))
