"""BPE encoding and decoding by batched merge rounds.

The distinct words of a batch are encoded together: the symbols of all of
them lie in one flat array.  A round looks up the rank of every neighbouring
pair by binary search over the sorted pair keys, takes the lowest rank of each
word and merges its occurrences from the left; words without a known pair are
done.  The word-level vocabulary drops white space, so texts are cut at
ASCII white space first and only distinct words are read further.

A word of more than ``HEAP_SYMBOLS`` symbols is merged with a queue instead
(same order of merges), since rounds over one huge word would be quadratic.

Defined results: a null or empty text has no tokens and decodes to the empty
string; special-token strings inside a text become their ids, as the public
library does; equal texts get equal ids; an empty table gives an empty table.
Words are told apart by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import textflat
from .groups import bounded_batches
from .registry import register

#: distinct words that one worker remembers
CACHE_WORDS = 300_000
HEAP_SYMBOLS = 1024


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 stands
    for itself, the others take the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a word-level BPE file of the public library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.no_rank = len(pairs)
        self.known: dict[int, tuple[bytes, bytes]] = {}

    # -- words -> tokens -------------------------------------------------

    def split(self, word: str) -> list:
        """Special ids (int) and pre-tokens (bytes) of one piece of raw text."""
        out: list = []
        for part in (self.cut.split(word) if self.cut and "<" in word else [word]):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                part = part.lower() if part.isascii() else "".join(c.lower() for c in part)
                out += [m.encode() for m in self.pattern.findall(part)]
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.no_rank)

    def merge(self, pretokens: list[bytes]) -> list[np.ndarray]:
        """Token ids of each pre-token (not empty), by rounds over all at once."""
        if not pretokens:
            return []
        size = np.array([len(p) for p in pretokens], dtype=np.int64)
        raw = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        owner = np.repeat(np.arange(len(size)), size)
        sym = self.inner[raw]
        end = np.cumsum(size) - 1
        sym[end] = self.last[raw[end]]
        result: list = [None] * len(size)
        huge = size > HEAP_SYMBOLS
        if huge.any():
            lo = np.cumsum(size) - size
            for w in np.flatnonzero(huge):
                result[w] = self._queue(sym[lo[w]:lo[w] + size[w]])
            stay = ~huge[owner]
            sym, owner = sym[stay], owner[stay]
        done_sym, done_owner = [], []
        while len(sym):
            rank = np.full(len(sym), self.no_rank, dtype=np.int64)
            if len(sym) > 1:
                same = owner[1:] == owner[:-1]
                rank[:-1][same] = self.rank_of(sym[:-1][same], sym[1:][same])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = lowest == self.no_rank
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                sym, owner, rank, lowest = sym[~over], owner[~over], rank[~over], lowest[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == lowest)
            # of neighbouring hits (a run of one symbol) every second one merges, from the left
            run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
            nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[nth % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, owner = sym[stay], owner[stay]
        if done_sym:
            sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
            order = np.argsort(owner, kind="stable")
            sym, owner = sym[order], owner[order]
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            for w, ids in zip(owner[first].tolist(), np.split(sym, first[1:])):
                result[w] = ids
        return result

    def _queue(self, sym: np.ndarray) -> np.ndarray:
        sym, n = sym.tolist(), len(sym)
        rank = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[k], i, k) for i in range(n - 1) if (k := (sym[i] << 20) | sym[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, i, k = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (sym[i] << 20) | sym[j] != k:
                continue
            sym[i], alive[j] = int(self.merged[r]), False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (q := (sym[a] << 20) | sym[after[a]]) in rank:
                    heapq.heappush(heap, (rank[q], a, q))
        return np.array([s for s, a in zip(sym, alive) if a], dtype=np.int64)

    def read(self, hashes: list[int], spelled) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit, decoded bytes) of each distinct word."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [k for k, h in enumerate(hashes) if h not in self.known]
        parts = [self.split(spelled(k)) for k in new]
        pre = list({p: None for ps in parts for p in ps if isinstance(p, bytes)})
        ids = dict(zip(pre, (a.tolist() for a in self.merge(pre))))
        for k, ps in zip(new, parts):
            word = [i for p in ps for i in (ids[p] if isinstance(p, bytes) else [p])]
            self.known[hashes[k]] = (np.array(word, dtype="<u4").tobytes(), self.decode(word).encode())
        return [self.known[h] for h in hashes]

    # -- tokens -> text --------------------------------------------------

    def decode(self, ids) -> str:
        """The library's decode of a file without a decoder: tokens and blanks."""
        return " ".join(self.tokens[i] for i in ids)

    # -- batches of texts ------------------------------------------------

    def encode_column(self, col: pa.Array):
        """Yields (ids as little-endian 32-bit, decoded bytes) of each text."""
        data, off = textflat.flat(col)
        starts, ends, doc_words = textflat.words(data, off)
        uniq, first, inv = np.unique(textflat.hash_spans(textflat.padded(data), starts, ends),
                                     return_index=True, return_inverse=True)
        raw = data.tobytes()
        lo, hi = starts[first].tolist(), ends[first].tolist()
        read = self.read(uniq.tolist(), lambda k: raw[lo[k]:hi[k]].decode("utf-8", "replace"))
        ids, texts = [a for a, _ in read], [b for _, b in read]
        inv, doc_words = inv.tolist(), doc_words.tolist()
        for a, b in zip(doc_words, doc_words[1:]):
            at = inv[a:b]
            yield b"".join([ids[k] for k in at]), b" ".join([t for k in at if (t := texts[k])])


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                ids = [np.frombuffer(a, "<u4").astype(np.int32) for a, _ in bpe.encode_column(piece.column(1))]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    path = path or vocabulary_path()

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every text; returns counts and SHA-256 digests."""
    bounded_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                count, a, b = [], [], []
                for ids, text in bpe.encode_column(piece.column(1)):
                    count.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(count, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@register("op8_bpe_rounds")
def op8_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
