"""Interpolated modified Kneser-Ney bigram model with memory-mapped hash arrays.

Spark counts the word pairs: each task adds up its own pairs first and sends
one sorted run a bucket, so a frequent pair is one entry a task.  A bucket (a range of
context hashes) merges its runs and writes its model files: sorted pair hashes
with counts, and sorted context hashes with what the discounts need.  Words are
merged the same way into sorted word hashes with counts and continuation
counts.  Workers map these files into memory and look pairs up by binary search.

Sums are 64-bit; a single run's counts, bounded by ``RUN_TOKENS``, are 32-bit.  Three discounts come from the counts of counts, for the pairs and for the
continuation counts, which interpolate with the uniform distribution over the
vocabulary and one unknown word.  A text's tokens are its lower-cased words and one end mark;
the first word's context is a start mark.  Words and pairs are told apart by 64-bit hashes.

The order is 2: counts of longer n-grams, nearly all distinct, would not fit
the disk budget (README).  Model files lie in the shared folder; they are written under
a temporary name and renamed, so repeated tasks do no harm.

Defined results: null and empty texts are one end mark; without training texts every
token has probability one over the vocabulary and the unknown word; repeated rows count each; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import table
from . import textflat
from .groups import Scratch, bounded_batches, whole_groups
from .registry import register

#: texts per bucket on average; tokens that a task adds up before it sends them
BUCKET_TEXTS, RUN_TOKENS = 4000, 3_000_000
START, END = np.uint64(0x5BD1E995A7C4F1D3), np.uint64(0xC2B2AE3D27D4EB4F)


def _local(uri: str) -> str | None:
    """The path of a file URI or plain path, None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def save(directory: str, name: str, values: np.ndarray) -> None:
    path, tmp = f"{directory}/{name}", f"{directory}/.{name}-{uuid.uuid4().hex[:8]}"
    if _local(directory):
        os.makedirs(_local(directory), exist_ok=True)
        values.tofile(_local(tmp))
        os.replace(_local(tmp), _local(path))
        return
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(directory)
    store.create_dir(at)
    with store.open_output_stream(f"{at}/.{tmp.rsplit('/', 1)[1]}") as out:
        out.write(values.tobytes())
    store.move(f"{at}/.{tmp.rsplit('/', 1)[1]}", f"{at}/{name}")


@functools.lru_cache(maxsize=4096)
def mapped(directory: str, name: str, kind: str) -> np.ndarray:
    """One model array, memory-mapped (fetched once per worker from stores that cannot be mapped)."""
    path = _local(f"{directory}/{name}")
    if path is not None:
        return _map(path, kind)
    from pyarrow import fs
    store, at = fs.FileSystem.from_uri(f"{directory}/{name}")
    with tempfile.TemporaryDirectory() as folder:  # a mapped file stays readable after its name is gone
        fs.copy_files(at, os.path.join(folder, name), source_filesystem=store)
        return _map(os.path.join(folder, name), kind)


def _map(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textflat.mix64(textflat.mix64(context) + word)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their contexts, offsets of the texts) of a batch of texts."""
    data, off = textflat.flat(col)
    starts, ends, doc_words = textflat.words(data, off)
    h = textflat.hash_spans(textflat.padded(textflat.lower_ascii(data)), starts, ends)
    word = np.insert(h, doc_words[1:], END)
    first = doc_words + np.arange(len(doc_words))
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = START
    return word, context, first


def _runs(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, contexts, n, words, counts): sorted runs of pair counts; contexts
    and the number of their pairs, then the words and counts of the pairs."""
    def flush(word, context):
        known, code = np.unique(np.concatenate([word, context]), return_inverse=True)
        code = code.astype(np.uint64)
        pair = np.sort((code[len(word):] << np.uint64(32)) | code[:len(word)])
        edge = np.flatnonzero(np.diff(pair, prepend=~pair[:1]))
        count = np.diff(np.append(edge, len(pair))).astype(np.uint32)
        pair = pair[edge]
        left, right = known[pair >> np.uint64(32)], known[pair & np.uint64(0xFFFFFFFF)]
        bucket = bucket_of(left, buckets)  # ascending: the codes follow the hashes
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for a, b in zip(cut, cut[1:]):
            ctx = np.append(np.flatnonzero(np.diff(left[a:b], prepend=~left[a:a + 1])), b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a])], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (
                    left[a:b][ctx[:-1]], np.diff(ctx).astype(np.uint32), right[a:b], count[a:b])]],
                names=["bucket", "contexts", "n", "words", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                word, context, _ = tokens(piece.column(0))
                held.append((word, context))
                size += len(word)
                if size >= RUN_TOKENS:
                    yield from flush(*(np.concatenate(x) for x in zip(*held)))
                    held, size = [], 0
        if size:
            yield from flush(*(np.concatenate(x) for x in zip(*held)))

    return docs.select("text").mapInArrow(run, "bucket int, contexts binary, n binary, words binary, counts binary")


def _column(part: pa.Table, name: str, kind) -> np.ndarray:
    data, _ = textflat.flat(part.column(name))
    return np.frombuffer(data.tobytes(), kind)


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [int((counts > 2).sum()), len(counts), int(counts.sum())]


def _merge_pairs(runs: DataFrame, directory: str, buckets: int) -> DataFrame:
    """Writes the pair and context files; returns the runs of words
    (bucket, words, counts, contexts) and the counts of counts (bucket -1)."""
    def run(batches):
        for part in whole_groups(batches, "bucket"):
            ids = part.column("bucket").to_numpy()
            for b in np.unique(ids).tolist():
                one = part.filter(pa.array(ids == b))
                context = np.repeat(_column(one, "contexts", np.uint64), _column(one, "n", np.uint32))
                word, count = _column(one, "words", np.uint64), _column(one, "counts", np.uint32).astype(np.int64)
                key = pair_key(context, word)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
                key, count = key[first], np.add.reduceat(count[order], first)
                context, word = context[order[first]], word[order[first]]
                small = np.minimum(count, 255).astype(np.uint8)
                save(directory, f"pair_keys-{b}", key)
                save(directory, f"pair_counts-{b}", small)
                save(directory, f"pair_more-{b}", count[count > 254])
                names, code = np.unique(context, return_inverse=True)
                total = np.bincount(code, weights=count)
                kinds = [np.bincount(code, weights=w) for w in (count == 1, count == 2, count > 2)]
                save(directory, f"context_keys-{b}", names)
                save(directory, f"context_counts-{b}", np.stack([total, *kinds], axis=1).astype(np.int64))
                stats = _of_counts(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1], pa.int32()), *[pa.array([np.array(stats, np.int64).tobytes()], pa.binary())] * 3],
                    names=["bucket", "words", "counts", "contexts"])
                names, code = np.unique(word, return_inverse=True)
                total, kinds = np.bincount(code, weights=count).astype(np.int64), np.bincount(code)
                at = bucket_of(names, buckets)
                cut = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
                for x, y in zip(cut, cut[1:]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(at[x])], pa.int32()), *[pa.array([v[x:y].tobytes()], pa.binary()) for v in (names, total, kinds)]],
                        names=["bucket", "words", "counts", "contexts"])

    return (runs.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(run, "bucket int, words binary, counts binary, contexts binary"))


def _merge_words(runs: DataFrame, directory: str) -> DataFrame:
    """Writes the word files; returns the counts of continuation counts with N and V."""
    def run(batches):
        for part in whole_groups(batches, "bucket"):
            ids = part.column("bucket").to_numpy()
            for b in np.unique(ids).tolist():
                one = part.filter(pa.array(ids == b))
                names, code = np.unique(_column(one, "words", np.uint64), return_inverse=True)
                total = np.bincount(code, weights=_column(one, "counts", np.int64))
                kinds = np.bincount(code, weights=_column(one, "contexts", np.int64))
                save(directory, f"word_keys-{b}", names)
                save(directory, f"word_counts-{b}", np.stack([total, kinds], axis=1).astype(np.int64))
                stats = [*_of_counts(kinds), int(total.sum())]
                yield pa.RecordBatch.from_arrays([pa.array([np.array(stats, np.int64).tobytes()], pa.binary())], names=["stats"])

    return runs.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "stats binary")


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = n[:4]
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(v, 0.1), k) for k, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


class Model:
    """Where the files are, how many buckets, and the sums over all of them."""

    def __init__(self, directory: str, buckets: int, pairs: list[int], words: list[int]):
        self.directory, self.buckets = directory, buckets
        self.pair_cut, self.word_cut = discounts(pairs), discounts(words)
        self.types, self.vocabulary, self.tokens = words[6], words[5], words[7]
        n1, n2, more = words[0], words[1], words[4]
        spare = self.word_cut[1] * n1 + self.word_cut[2] * n2 + self.word_cut[3] * more
        self.uniform = (spare / self.types if self.types else 1.0) / (self.vocabulary + 1)

    def _find(self, kind: str, h: np.ndarray, at: np.ndarray):
        """Yields (rows of h found, places, bucket) bucket by bucket."""
        order = np.lexsort((h, at))
        cut = np.append(np.flatnonzero(np.diff(at[order], prepend=-1)), len(order))
        for x, y in zip(cut, cut[1:]):
            rows, b = order[x:y], int(at[order[x]])
            try:
                keys = mapped(self.directory, f"{kind}_keys-{b}", "u8")
            except FileNotFoundError:  # a bucket without any training pair
                continue
            if len(keys):
                place = np.minimum(np.searchsorted(keys, h[rows]), len(keys) - 1)
                ok = keys[place] == h[rows]
                yield rows[ok], place[ok], b

    def words(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, continuation counts) of word hashes."""
        out = np.zeros((len(word), 2), np.int64)
        for rows, place, b in self._find("word", word, bucket_of(word, self.buckets)):
            out[rows] = mapped(self.directory, f"word_counts-{b}", "i8").reshape(-1, 2)[place]
        return out[:, 0], out[:, 1]

    def probabilities(self, word: np.ndarray, context: np.ndarray, continuation: np.ndarray) -> np.ndarray:
        """P(word | context)."""
        low = self.uniform + np.maximum(continuation - self.word_cut[np.minimum(continuation, 3)], 0) / max(1, self.types)
        names, code = np.unique(context, return_inverse=True)
        of = np.zeros((len(names), 4))
        for rows, place, b in self._find("context", names, bucket_of(names, self.buckets)):
            of[rows] = mapped(self.directory, f"context_counts-{b}", "i8").reshape(-1, 4)[place]
        total = of[code, 0]
        spare = (of[:, 1:] @ self.pair_cut[1:])[code]
        seen = np.flatnonzero(total > 0)
        key = pair_key(context[seen], word[seen])
        count = np.zeros(len(seen), np.int64)
        for rows, place, b in self._find("pair", key, bucket_of(context[seen], self.buckets)):
            small = mapped(self.directory, f"pair_counts-{b}", "u1")
            got = small[place].astype(np.int64)
            big = np.flatnonzero(got == 255)
            if len(big):
                nth = np.searchsorted(np.flatnonzero(small == 255), place[big])
                got[big] = mapped(self.directory, f"pair_more-{b}", "i8")[nth]
            count[rows] = got
        out = low.copy()
        cut = np.maximum(count - self.pair_cut[np.minimum(count, 3)], 0)
        out[seen] = (cut + spare[seen] * low[seen]) / total[seen]
        return out


def train(docs: DataFrame) -> Model:
    """Counts all texts of ``docs`` and writes the model to the shared folder."""
    spark = docs.sparkSession
    bounded_batches(spark)
    directory, scratch = scratch_path(spark, "kneser_ney"), Scratch(spark)
    buckets = max(4, -(-docs.count() // BUCKET_TEXTS))
    runs = scratch.put(_merge_pairs(_runs(docs, buckets), directory, buckets), "word_runs")
    pairs = np.zeros(7, np.int64)
    # a few numbers a bucket
    for r in runs.where("bucket = -1").select("counts").collect():
        pairs += np.frombuffer(r.counts, np.int64)
    words = np.zeros(8, np.int64)
    for r in scratch.put(_merge_words(runs, directory), "word_stats").collect():
        words += np.frombuffer(r.stats, np.int64)
    scratch.drop("word_runs", "word_stats")
    return Model(directory, buckets, pairs.tolist(), words.tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every whole text."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in textflat.pieces(batch, "text"):
                word, context, first = tokens(piece.column(1))
                names, code = np.unique(word, return_inverse=True)
                count, continuation = model.words(names)
                base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.vocabulary + 1)))[code]
                p = np.log10(model.probabilities(word, context, continuation[code]))
                n = np.diff(first)
                sums = [np.add.reduceat(x, first[:-1]) if len(n) else np.zeros(0) for x in ((count > 0)[code].astype(np.int64), base, p)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n, pa.int64()), pa.array(sums[0], pa.int64()),
                     pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(sums[1]), pa.array(sums[2]),
                     pa.array(10.0 ** np.minimum(-sums[2] / n, 300))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
                             "score double, perplexity double"))


@register("op5_kneser_ney")
def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    scored = score(docs, train(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         "perplexity")
