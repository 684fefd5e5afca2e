"""Topic models (K1-K5).

* ``limited_vocabulary``: terms in at least ``min_df`` documents and at most
  ``max_df`` of them, English stop words removed, the ``max_features`` most
  frequent by total count (term as tie-break) - a grouping plus a top-k.
* ``tfidf_limited``: TF-IDF restricted to that vocabulary.
* ``lda_topics``: MLlib online LDA on term counts of the vocabulary.
* ``nmf_topics``: non-negative matrix factorisation by alternating least squares
  with elastic-net terms.  W (documents x k) is solved anew in every pass, where its
  documents are; H (k x vocabulary, at most k x max_features) is solved on the driver
  from sums and broadcast - its size is bounded by the vocabulary limit, not by the data.
"""

from __future__ import annotations

import math
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import stop_words
from ..session import cut_lineage
from . import blocks as BL
from .features import term_array

#: texts that a task of a pass reads
PART_TEXTS = 2_500
LEAST_SCANS = "spark.sql.files.minPartitionNum"


def doc_terms(docs: DataFrame, id_col: str, text_col: str, remove_stop_words: bool = True) -> DataFrame:
    """(id, term) rows, one per occurrence, stop words removed after the explode."""
    ex = (docs.select(F.col(id_col), F.explode_outer(term_array(F.col(text_col))).alias("term"))
          .where(F.col("term").isNotNull()))
    if remove_stop_words:
        ex = ex.where(~F.col("term").isin(list(stop_words("english"))))
    return ex


def term_totals(dealt: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, total, df): occurrences of each term and the ids with it, of texts dealt by id.

    A task sorts its texts by id and counts them a batch at a time, so what leaves it is a row a batch and
    distinct term, and no table of (id, term) pairs is kept.  Of an id whose texts go on in the next batch,
    the terms so far are kept."""
    terms = dealt.sortWithinPartitions(id_col).select(id_col, F.array_join(term_array(F.col(text_col)), " ").alias("terms"))

    def run(batches):
        last, seen = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, split = batch.column(0), pc.split_pattern(pc.if_else(pc.equal(batch.column(1), ""), None, batch.column(1)), " ")
            coded = split.flatten().dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            of = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            pairs = of[pc.list_parent_indices(split).to_numpy()].astype(np.int64) * max(len(words), 1) + code
            pairs.sort()
            row, word = np.divmod(pairs[np.flatnonzero(np.diff(pairs, prepend=-1))], max(len(words), 1))
            df = np.bincount(word, minlength=len(words))
            ends = [ids[0].as_py(), ids[-1].as_py()]
            first, end = (word[row == of[at]] for at in (0, -1))
            if last == (ends[0],):
                df[[w for w, t in zip(first, words.take(pa.array(first)).to_pylist()) if t in seen]] -= 1
            if last != (ends[1],):
                seen = set()
            seen.update(words.take(pa.array(end)).to_pylist())
            last = (ends[1],)
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code, minlength=len(words))), pa.array(df)], names=["term", "total", "df"])

    parts = terms.mapInArrow(run, "term string, total bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def limited_vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_df: int = 2,
                       max_df: float = 0.95, max_features: int = 1000) -> DataFrame:
    """(term, total, df, term_rank) of the limited vocabulary (K1)."""
    # texts are dealt by id before they are cut: they are shorter than their terms
    dealt = docs.select(id_col, text_col).repartition(id_col)
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    stats = term_totals(dealt, id_col, text_col).where(~F.col("term").isin(list(stop_words("english"))))
    kept = stats.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    top = kept.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    return top.withColumn("term_rank", F.row_number().over(Window.orderBy(F.desc("total"), F.asc("term"))))


def tfidf_limited(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, weight) on the limited vocabulary; the vocabulary (at most
    ``max_features`` rows) is broadcast (K2)."""
    tf = (doc_terms(docs, id_col, text_col).join(F.broadcast(vocab.select("term", "df")), "term")
          .groupBy(id_col, "term", "df").agg(F.count(F.lit(1)).alias("tf")))
    n_docs = docs.agg(F.count(F.lit(1))).scalar()
    w = tf.select(id_col, "term", (F.col("tf") * (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def count_vectors(docs: DataFrame, vocab_terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tf vector) over a fixed vocabulary - JVM-side CountVectorizerModel."""
    cv = CountVectorizerModel.from_vocabulary(vocab_terms, inputCol="_terms", outputCol="features")
    sw = list(stop_words("english"))
    terms = F.filter(term_array(F.col(text_col)), lambda x: ~x.isin(sw))
    return cv.transform(docs.select(F.col(id_col), terms.alias("_terms"))).select(id_col, "features")


def dealt_evenly(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """The texts in ``parts`` equal parts, each in order, however the table's files are cut."""
    docs = docs.select(id_col, text_col)
    return docs if parts < 2 else docs.repartition(parts, id_col, text_col).sortWithinPartitions(id_col, text_col)


@contextmanager
def files_apart(spark, parts: int):
    """Scans of ``parts`` even files read each in a task of its own; else small files are put together, at times
    into a few more tasks than there are cores."""
    before = spark.conf.get(LEAST_SCANS, None)
    if parts >= 2:
        spark.conf.set(LEAST_SCANS, str(parts))
    try:
        yield
    finally:
        spark.conf.unset(LEAST_SCANS) if before is None else spark.conf.set(LEAST_SCANS, before)


def lda_topics(docs: DataFrame, vocab_terms: list[str], k: int = 10, max_iter: int = 5,
               learning_offset: float = 50.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text"):
    """Online LDA (K3), ``max_iter`` passes over all texts, ``PART_TEXTS`` to a task; returns (model,
    term-count vectors)."""
    parts = math.ceil(docs.count() / PART_TEXTS)
    vec = cut_lineage(count_vectors(dealt_evenly(docs, id_col, text_col, parts), vocab_terms, id_col, text_col))
    lda = LDA(k=k, maxIter=max_iter, optimizer="online", subsamplingRate=1.0, learningOffset=learning_offset, seed=seed,
              featuresCol="features")
    with files_apart(docs.sparkSession, parts):
        return lda.fit(vec), vec


def topic_top_terms(model, vocab_terms: list[str], n: int = 20) -> DataFrame:
    """(topic, rank, term, weight): the ``n`` heaviest terms per topic (K5)."""
    spark = model.describeTopics(1).sparkSession
    topics = model.describeTopics(n)
    ex = topics.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "tw"))
    names = spark.createDataFrame(list(enumerate(vocab_terms)), "idx INT, term STRING")
    return (ex.select("topic", (F.col("rank") + 1).alias("rank"), F.col("tw.termIndices").alias("idx"),
                      F.col("tw.termWeights").alias("weight"))
            .join(F.broadcast(names), "idx").select("topic", "rank", "term", "weight"))


def _least_squares(target: np.ndarray, gram: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None,
                   sweeps: int = 200, tol: float = 1e-7) -> np.ndarray:
    """Rows v >= 0 that minimise 0.5 v gram v' - v target' + l1 |v| + 0.5 l2 |v|^2, by sweeps over the coordinates."""
    v = np.zeros_like(target) if start is None else start.copy()
    for _ in range(sweeps):
        moved = 0.0
        for c in range(gram.shape[0]):
            new = np.maximum(0.0, (target[:, c] - l1 - v @ gram[:, c] + v[:, c] * gram[c, c]) / max(gram[c, c] + l2, 1e-12))
            moved = max(moved, float(np.abs(new - v[:, c]).max(initial=0.0)))
            v[:, c] = new
        if moved <= tol * max(float(v.max(initial=0.0)), 1e-12):
            break
    return v


def nmf_topics(x: DataFrame, terms: list[str], k: int = 10, alpha: float = 0.1, l1_ratio: float = 0.5,
               max_iter: int = 200, tol: float = 1e-4, seed: int = 1, id_col: str = "doc_id"):
    """NMF of the non-negative long matrix x(id, term, weight) (K4), minimising 0.5||X - WH||^2 + l1 (|W| + |H|) +
    0.5 l2 (||W||^2 + ||H||^2) by alternating non-negative least squares with coordinate descent.

    The rows of X are packed into blocks once.  An iteration is one pass: the W row of each document follows from
    its X row and the broadcast H, and only the sums W'X and W'W leave the task; from them the driver
    solves for H (k x vocabulary, bounded by the vocabulary limit).  Nothing of W is kept between passes.  Stops
    when the reconstruction error falls by less than ``tol`` of its first value.  Returns
    (H, W DataFrame (id, w array), error history)."""
    spark, m = x.sparkSession, len(terms)
    l1, l2 = alpha * l1_ratio, alpha * (1.0 - l1_ratio)
    idx = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term STRING, j INT")
    rows = (x.join(F.broadcast(idx), "term").groupBy(F.col(id_col).cast("long").alias("doc"))
            .agg(F.collect_list(F.struct("j", F.col("weight").cast("double").alias("v"))).alias("e")))

    def columns(batch):
        e = batch.column(1)
        inner = e.flatten()
        return ([batch.column(0).to_numpy()], np.concatenate([[0], np.cumsum(np.diff(e.offsets.to_numpy()))]),
                inner.field("j").to_numpy(), inner.field("v").to_numpy())

    packed = BL.pack(rows, columns, ["doc"])

    def squares(out, raw):
        value = BL.entries(raw)[2]
        out[0] += np.array([float(value @ value), float(value.sum()), len(value)])

    x_sq, total, n = BL.summed(packed, squares, 1, 3)[0]
    h = np.abs(np.random.default_rng(seed).standard_normal((k, m))) * np.sqrt((total / n if n else 0.0) / k)
    history: list[tuple[int, float]] = []
    for it in range(max_iter):
        gram = h @ h.T

        def one_pass(out, raw, h=h, gram=gram):
            off, index, value = BL.entries(raw)
            w = _least_squares(BL.products(off, index, value, h.T), gram, l1, l2)
            BL.add_transposed(out[:m], off, index, value, w)
            out[m:] += w.T @ w

        sums = BL.summed(packed, one_pass, m + k, k)
        wtx, wtw = sums[:m], sums[m:]
        err = float(np.sqrt(max(x_sq - 2 * float(np.sum(wtx.T * h)) + float(np.sum(wtw * gram)), 0.0)))
        history.append((it + 1, err))
        h = _least_squares(wtx, wtw, l1, l2, h.T).T
        if it and history[-2][1] - err < tol * max(history[0][1], 1e-12):
            break
    gram = h @ h.T

    def loadings(batches):
        for raw in BL.rows_of(batches):
            w = _least_squares(BL.products(*BL.entries(raw), h.T), gram, l1, l2)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw["doc"], np.int64)), pa.array(list(w), pa.list_(pa.float64()))],
                                             names=[id_col, "w"])

    return h, packed.mapInArrow(loadings, f"`{id_col}` bigint, w array<double>"), history


def nmf_top_terms(h: np.ndarray, terms: list[str], spark, n: int = 20) -> DataFrame:
    rows = []
    for t in range(h.shape[0]):
        order = np.argsort(-h[t], kind="stable")[:n]
        rows += [(t, r + 1, terms[j], float(h[t, j])) for r, j in enumerate(order)]
    return spark.createDataFrame(rows, "topic INT, rank INT, term STRING, weight DOUBLE")
