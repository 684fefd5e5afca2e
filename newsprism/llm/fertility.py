"""Quality rules by tokeniser fertility.

Two public vocabularies read every word of a text.  Per text this gives the
characters per token of both, the share of byte-fallback tokens and the
entropy of the token distribution.  Each language and length class (power of
two of the word count) has its own rejection bands: the median of the class
and a spread taken below it, both over the distinct texts of the whole
input that pass the base rules.

A text is rejected when its entropy lies ``FAR`` spreads under the median,
when entropy and characters per token are both ``NEAR`` spreads under it, when
characters per token alone are ``EXTREME`` spreads under it, or when the
byte-fallback share is over ``FALLBACK``.  A base rule (too few words, too
many words inside repeated 8-word windows) rejects before that.

Defined results: a null or empty text has no words and fails the base rule;
a null language is a class of its own; an empty table gives an empty table;
equal texts get equal verdicts; further columns pass through whatever their
names are.  Line and window equality is by 64-bit hashes inside one text.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_and_reload
from ..sources.tables import table
from . import textflat
from .groups import bounded_batches, free_name
from .registry import register

MIN_WORDS, MAX_REPEAT_PCT = 20, 30
FAR, NEAR, EXTREME, FALLBACK = 4.0, 2.0, 12.0, 0.10
#: smallest spread of a band: characters per token, entropy in bits
FLOOR_CPT, FLOOR_ENTROPY = 0.04, 0.12
#: classes (languages times at most 64 lengths) that may be broadcast
MAX_BROADCAST_BANDS = 10_000
#: decimals of a metric when texts of a class are ranked
DIGITS = 4
#: words whose tokens one worker remembers
CACHE_WORDS = 300_000

METRICS = T.StructType([T.StructField(n, T.LongType()) for n in
                        ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "n_tokens", "n_tokens_2", "n_fallback")] + [T.StructField("entropy", T.DoubleType())])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def vocabularies() -> tuple[str, str]:
    """Default paths: a byte-fallback piece model and a byte-level rank file."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class _Vocabulary:
    """Both tokenisers and a bounded memory of the words they have read."""

    def __init__(self, piece_path: str, rank_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.size = self.piece.vocab_size()
        self.is_byte = np.array([self.piece.is_byte(i) for i in range(self.size)])
        self.known: dict[int, tuple[np.ndarray, int]] = {}

    def read(self, hashes: list[int], spelled) -> list[tuple[np.ndarray, int]]:
        """(piece ids, number of ranks tokens) of each word; ``spelled(k)`` gives its text."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = [k for k, h in enumerate(hashes) if h not in self.known]
        texts = [spelled(k) for k in new]
        for k, ids, other in zip(new, self.piece.encode(texts, num_threads=1),
                                 (len(self.ranks.encode_ordinary(" " + t)) for t in texts)):
            self.known[hashes[k]] = (np.array(ids, dtype=np.int32), other)
        return [self.known[h] for h in hashes]


@functools.lru_cache(maxsize=2)
def _vocabulary(piece_path: str, rank_path: str) -> _Vocabulary:
    return _Vocabulary(piece_path, rank_path)


def _sums(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _dup_lines(data, buf, off, starts, rows) -> np.ndarray:
    breaks = np.flatnonzero(data == 10)
    lo = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    doc = np.searchsorted(off[1:], lo, side="right") if len(lo) else lo
    keep = (lo < len(data)) & (doc < rows)
    lo, doc = lo[keep], doc[keep]
    lo, first = np.unique(lo, return_index=True)
    doc = doc[first]
    after = np.append(breaks, len(data))
    hi = np.minimum(after[np.searchsorted(breaks, lo)], off[1:][doc])
    worded = np.searchsorted(starts, lo) < np.searchsorted(starts, hi)
    lo, hi, doc = lo[worded], hi[worded], doc[worded]
    key = textflat.mix64(textflat.hash_spans(buf, lo, hi) + textflat.mix64(doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=rows) - np.bincount(doc[first], minlength=rows)


def _repeat_words(h, doc_words, rows) -> np.ndarray:
    win, at = textflat.window_hashes(h, doc_words, 8)
    if not len(win):
        return np.zeros(rows, np.int64)
    count = np.diff(doc_words)
    doc = np.repeat(np.arange(rows), count)
    key = textflat.mix64(win + textflat.mix64(doc[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(key), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    edge = np.zeros(len(h) + 1, np.int32)
    edge[at[again]] += 1
    np.subtract.at(edge, at[again] + 8, 1)
    return _sums(np.cumsum(edge[:-1]) > 0, doc_words)


def measure(col: pa.Array, vocabulary: _Vocabulary) -> dict[str, np.ndarray]:
    """The metrics of a batch of texts."""
    rows = len(col)
    data, off = textflat.flat(col)
    buf = textflat.padded(data)
    starts, ends, doc_words = textflat.words(data, off)
    n_words = np.diff(doc_words)
    h = textflat.hash_spans(buf, starts, ends)
    inside = ~textflat._WS[data]
    out = {"n_words": n_words, "word_chars": _sums(inside & ((data & 0xC0) != 0x80), off),
           "n_symbols": _sums(_SYMBOL[data], off), "n_dup_lines": _dup_lines(data, buf, off, starts, rows),
           "n_repeat_words": _repeat_words(h, doc_words, rows)}
    uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    lo, hi = starts[first].tolist(), ends[first].tolist()
    read = vocabulary.read(uniq.tolist(), lambda k: raw[lo[k]:hi[k]].decode("utf-8", "replace"))
    size = np.array([len(a) for a, _ in read], dtype=np.int64)
    other = np.array([b for _, b in read], dtype=np.int64)
    ids = np.concatenate([a for a, _ in read]) if read else np.zeros(0, np.int32)
    at = np.cumsum(size) - size
    doc = np.repeat(np.arange(rows), n_words)
    per_word = size[inv] if len(inv) else np.zeros(0, np.int64)
    shift = np.cumsum(per_word) - per_word
    flat_ids = ids[np.repeat((at[inv] if len(inv) else shift) - shift, per_word) + np.arange(per_word.sum())]
    token_doc = np.repeat(doc, per_word)
    n_tokens = np.bincount(token_doc, minlength=rows)
    key = np.sort(token_doc * vocabulary.size + flat_ids)
    edge = np.flatnonzero(np.diff(key, prepend=-1))
    run = np.diff(np.append(edge, len(key)))
    part = np.bincount(key[edge] // vocabulary.size, weights=run * np.log2(run), minlength=rows)
    total = np.maximum(n_tokens, 1)
    out |= {"n_tokens": n_tokens, "n_fallback": np.bincount(token_doc, weights=vocabulary.is_byte[flat_ids],
                                                            minlength=rows).astype(np.int64),
            "n_tokens_2": np.bincount(doc, weights=other[inv] if len(inv) else None, minlength=rows).astype(np.int64),
            "entropy": np.maximum(np.log2(total) - part / total, 0.0)}
    return out


def annotate(docs: DataFrame, name: str, paths: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the struct column ``name`` of metrics of its ``text``."""
    paths = paths or vocabularies()
    schema = T.StructType([*docs.schema.fields, T.StructField(name, METRICS)])

    def run(batches):
        vocabulary = _vocabulary(*paths)
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                got = measure(piece.column(piece.schema.get_field_index("text")), vocabulary)
                metric = pa.StructArray.from_arrays(
                    [pa.array(got[f.name], pa.float64() if f.name == "entropy" else pa.int64())
                     for f in METRICS.fields], names=METRICS.names)
                yield pa.RecordBatch.from_arrays([*piece.columns, metric], names=[*piece.schema.names, name])

    return docs.mapInArrow(run, schema)


def class_bands(distinct: DataFrame, names: list[str]) -> DataFrame:
    """Per class (l, k) and metric the values at ranks 0.5 and 0.2, as an array:
    read off the cumulative counts of values rounded to ``DIGITS``, so they do
    not depend on how rows are split up."""
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), F.round(n, DIGITS).alias("v")) for n in names]))
    counts = distinct.select("l", "k", one.alias("e")).groupBy("l", "k", "e.m", "e.v").count()
    group = Window.partitionBy("l", "k", "m")
    ranked = counts.select("l", "k", "m", "v", F.sum("count").over(group.orderBy("v")).alias("upto"),
                           F.sum("count").over(group).alias("n"))
    at = {n: lambda parts, n=n: F.min(F.when((F.col("m") == n) & (F.col("upto") * parts >= F.col("n")), F.col("v"))) for n in names}
    return ranked.groupBy("l", "k").agg(*[F.array(at[n](2), at[n](5)).alias(n) for n in names])


def with_verdict(docs: DataFrame, carry: list[str] | None = None,
                 paths: tuple[str, str] | None = None) -> tuple[DataFrame, str]:
    """(rows with a verdict, name of the verdict column).

    The verdict is a struct: the metrics, ``base_failed``, ``kept`` and the
    distances from the class medians in spreads.  ``docs`` needs ``text`` and
    ``lang``; ``carry`` names the columns that stay (default: all).
    """
    bounded_batches(docs.sparkSession)
    carry = carry or docs.columns
    name, key = free_name(docs, "verdict"), free_name(docs, "text_key")
    rows = annotate(docs.withColumn(key, F.xxhash64("text")), name, paths)
    rows = write_and_reload(rows.select(*dict.fromkeys([*carry, "lang"]), key, name), "fertility")
    m = lambda f: F.col(f"{name}.{f}")
    failed = (m("n_words") < MIN_WORDS) | (100 * m("n_repeat_words") > MAX_REPEAT_PCT * m("n_words"))
    known = F.coalesce(F.col("lang"), F.lit(""))
    length_class = F.floor(F.log2(F.greatest(m("n_words"), F.lit(1)).cast("double"))).cast("int")
    cpt = m("word_chars") / F.greatest(m("n_tokens"), F.lit(1))
    cpt_2 = m("word_chars") / F.greatest(m("n_tokens_2"), F.lit(1))
    values = {"cpt": cpt, "cpt_2": cpt_2, "entropy": m("entropy")}
    # one row per distinct text, so a hot group of copies cannot move the bands
    distinct = (rows.where(~failed).groupBy(known.alias("l"), length_class.alias("k"), F.col(key).alias("t"))
                .agg(*[F.min(v).alias(n) for n, v in values.items()]))
    bands = write_and_reload(class_bands(distinct, list(values)), "bands")
    if bands.count() <= MAX_BROADCAST_BANDS:  # else a shuffled join, which a hot class skews
        bands = F.broadcast(bands)
    mid = lambda n: F.col(f"b.{n}")[0]
    spread = lambda n, floor: F.greatest((F.col(f"b.{n}")[0] - F.col(f"b.{n}")[1]) / 0.8416, F.lit(floor))
    joined = rows.alias("r").join(bands.alias("b"), (known == F.col("b.l")) & (length_class == F.col("b.k")), "left")
    z = {"cpt": (cpt - mid("cpt")) / spread("cpt", FLOOR_CPT),
         "cpt_2": (cpt_2 - mid("cpt_2")) / spread("cpt_2", FLOOR_CPT),
         "entropy": (m("entropy") - mid("entropy")) / spread("entropy", FLOOR_ENTROPY)}
    low = F.least(z["cpt"], z["cpt_2"])
    rejected = ((z["entropy"] < -FAR) | ((z["entropy"] < -NEAR) & (low < -NEAR)) | (low < -EXTREME)
                | (m("n_fallback") > FALLBACK * m("n_tokens")))
    verdict = F.struct(*[m(f).alias(f) for f in METRICS.names], failed.alias("base_failed"),
                       (~failed & ~F.coalesce(rejected, F.lit(False))).alias("kept"),
                       *[v.alias(f"z_{n}") for n, v in z.items()])
    return joined.select(*[F.col(f"r.`{c}`") for c in carry], verdict.alias(name)), name


def keep_good(docs: DataFrame) -> DataFrame:
    """Pipeline stage: the rows whose text is kept, all columns unchanged."""
    columns = docs.columns
    rows, name = with_verdict(docs)
    return rows.where(F.col(f"{name}.kept")).select(*columns)


@register("op10_fertility")
def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows, v = with_verdict(docs, carry=["doc_id"])
    return rows.select("doc_id", *[F.col(f"{v}.{c}") for c in
                                   ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "base_failed", "kept", "n_tokens", "n_fallback", "entropy")])
