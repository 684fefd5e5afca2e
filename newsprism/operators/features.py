"""Feature families (F1-F13) in canonical long form.

Every family returns ``(id, family, feature, value)``: one row per non-zero
cell of the reference's sparse matrix, feature names ``prefix_value``.  The
model form (sparse vectors + a name table) is built from the long form in
``operators.vectors``.

Scale notes
-----------
* Nothing is keyed by a hot value inside a window: per-term document
  frequencies and per-domain counts are ``groupBy`` aggregates (partial
  aggregation map-side) joined back on the key, where AQE broadcasts a small
  side and splits a skewed one.  Windows are used only keyed by document.
* Lexicons (stop words, emotion words, grammar rules) are fixed-size inputs:
  they are broadcast after a size check; the misspelling dictionary is a
  DataFrame of any size and is joined without a hint (AQE decides at runtime
  from its measured size).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.lexicons import AFFECTS, stop_words
from ..session import cut_lineage, shuffles_removed
from .joins import broadcast_checked

FAMILY_PREFIX = {
    "author": "auth", "tags": "tag", "tfidf": "text", "title": "title",
    "domain_endings": "domain", "word_count": "word_count", "misspellings": "misspellings",
    "grammar_mistakes": "grammar_mistakes", "lshash": "lsh", "source_count": "source_count",
    "sentiment": "sent",
}

#: shared terms, documents and dictionary words that may be broadcast
MANY_TERMS, MANY_DOCS, MANY_WORDS = 1_000_000, 2_000_000, 1_000_000

LONG_COLS = ["family", "feature", "value"]


def _long(df: DataFrame, id_col: str, family: str, feature: Column, value: Column) -> DataFrame:
    return df.select(F.col(id_col), F.lit(family).alias("family"), feature.alias("feature"),
                     value.cast("double").alias("value"))


# ------------------------------------------------------------------ F1 multi-hot

def multi_hot(df: DataFrame, id_col: str, col: str, prefix: str, family: str | None = None) -> DataFrame:
    """Multi-hot counts of a comma list: no trimming, '' is a category and
    repeats within a row add up (F1, P12)."""
    ex = df.select(F.col(id_col), F.explode(F.split(F.coalesce(F.col(col), F.lit("")), ",", -1)).alias("v"))
    counts = ex.groupBy(id_col, "v").agg(F.count(F.lit(1)).alias("n"))
    return _long(counts, id_col, family or prefix, F.concat(F.lit(prefix + "_"), F.col("v")), F.col("n"))


def domain_endings(df: DataFrame, id_col: str = "article_id", url_col: str = "url") -> DataFrame:
    """Multi-hot of the domain ending of each url (F1 on P3)."""
    return multi_hot(df.select(id_col, U.domain_ending(url_col).alias("_end")), id_col, "_end", "domain", "domain")


# ------------------------------------------------------------------ F2 TF-IDF

TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def term_array(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_PATTERN), 0)


def ngram_terms(df: DataFrame, id_col: str, text_col: str, ngram: int = 1,
                remove_stop_words: bool = False) -> DataFrame:
    """(id, term) rows: every 1..ngram-gram of the token sequence.  n-grams are
    slices of the token array beside the tokens (cut once, no union, no shuffle);
    stop words, when removed, go before the n-grams are formed."""
    toks = term_array(F.col(text_col))
    if remove_stop_words:
        sw = list(stop_words("english"))
        toks = F.filter(toks, lambda x: ~x.isin(sw))
    def grams(n: int) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size("_s") - n + 1), lambda i: F.concat_ws(" ", F.slice("_s", i, n)))
        return F.when(F.size("_s") >= n, many).otherwise(F.array().cast("array<string>"))

    base, terms = df.select(F.col(id_col), toks.alias("_s")), F.col("_s")
    if ngram > 1:
        terms = F.concat(terms, *[grams(n) for n in range(2, ngram + 1)])
    # explode_outer + null filter: a plain explode makes the optimizer add a
    # size(...) > 0 filter that evaluates the tokenising regex a second time
    return base.select(id_col, F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())


def term_counts(df: DataFrame, id_col: str, text_col: str, ngram: int = 1, remove_stop_words: bool = False) -> DataFrame:
    """(id, term, tf), written: it feeds both sides of the document-frequency join, and is tokenised once.  Texts are
    dealt by id before they are cut: they are shorter than their terms."""
    df = df.select(id_col, text_col).repartition(id_col)
    terms = ngram_terms(df, id_col, text_col, ngram, remove_stop_words)
    return cut_lineage(terms.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(term, df) of term counts."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weigh(tf: DataFrame, dfreq: DataFrame, n_docs, id_col: str) -> DataFrame:
    """(id, term, weight): raw tf x (ln((1+N)/(1+df)) + 1), rows L2-normalised; terms without a document frequency
    have no weight."""
    w = (tf.join(dfreq, "term")
         .select(id_col, "term",
                 (F.col("tf") * (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0)).alias("w")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def tfidf_weights(df: DataFrame, id_col: str, text_col: str, ngram: int = 1,
                  remove_stop_words: bool = False) -> DataFrame:
    """(id, term, weight) of the texts, with their own document frequencies.  Most terms stand in one text, so where the
    others are few the frequencies above 1 are broadcast, and so are the norms: no term moves.
    Else terms move to their frequencies, for the norms and for the weights; shuffle files go with their job."""
    with shuffles_removed(df.sparkSession):
        tf = term_counts(df, id_col, text_col, ngram, remove_stop_words)
        n_docs = df.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
        shared = cut_lineage(document_frequencies(tf).where("df > 1"))
        idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.coalesce("df", F.lit(1)))) + 1.0
        few = shared.count() <= MANY_TERMS
        w = tf.join(F.broadcast(shared) if few else shared, "term", "left").select(id_col, "term", (F.col("tf") * idf).alias("w"))
        norms = cut_lineage(w.groupBy(F.col(id_col).alias("_id")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm")))
    return w.join(broadcast_checked(norms, MANY_DOCS), F.col(id_col).eqNullSafe(F.col("_id"))).select(
        id_col, "term", (F.col("w") / F.col("_norm")).alias("weight"))


def tfidf(df: DataFrame, id_col: str, text_col: str, prefix: str = "text", ngram: int = 1,
          remove_stop_words: bool = False, family: str | None = None, weights: DataFrame | None = None) -> DataFrame:
    """TF-IDF in long form; ``weights`` are those of ``tfidf_weights`` if already built."""
    w = tfidf_weights(df, id_col, text_col, ngram, remove_stop_words) if weights is None else weights
    return _long(w, id_col, family or prefix, F.concat(F.lit(prefix + "_"), F.col("term")), F.col("weight"))


# ------------------------------------------------------------------ F3 word count

def word_count(df: DataFrame, id_col: str = "article_id", text_col: str = "text") -> DataFrame:
    return _long(df, id_col, "word_count", F.lit("word_count"), T.word_count(text_col))


# ------------------------------------------------------------------ F4 misspellings

def _letters(text_col: str) -> Column:
    """The text with everything but letters turned into spaces."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^A-Za-z]+", " "))


def letter_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word) with non-letters turned into spaces; one row per occurrence,
    and one null-word row for texts without words."""
    return df.select(F.col(id_col), F.explode_outer(F.array_remove(F.split(_letters(text_col), " "), "")).alias("word"))


#: bytes with everything but ASCII letters turned into spaces, and lower-cased too
_SPACED = bytes(b if chr(b).isascii() and chr(b).isalpha() else 32 for b in range(256))
_LOWERED = _SPACED.lower()


def _cut_words(text, table: bytes) -> list[bytes]:
    """The letter words of an Arrow string; bytes beyond ASCII are no letters."""
    return text.as_buffer().to_pybytes().translate(table).split() if text.is_valid else []


def _distinct_words(batches):
    """(word, _d): in how many texts of a batch each lower-case letter word is found."""
    for batch in batches:
        found = Counter()
        for text in batch.column(0):
            found.update(set(_cut_words(text, _LOWERED)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "_d"])


def corpus_dictionary(df: DataFrame, id_col: str, text_col: str, min_share: float = 0.005) -> DataFrame:
    """A spelling dictionary learned from a corpus: lower-case letter words
    found in at least ``min_share`` of the documents (stands in for a word
    list).  A share keeps the dictionary, and so the misspelling rate, alike at
    every corpus size.  A text's words are made distinct and counted in its batch; only rows that
    share their id are brought together for it."""
    rows = df.select(id_col, text_col)
    twice = cut_lineage(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("_twice")))
    same = F.col(id_col).eqNullSafe(F.col("_twice"))
    once = rows.join(twice, same, "left_anti").select(F.col(text_col).cast("string")).mapInArrow(_distinct_words, "word string, _d bigint")
    again = letter_words(rows.join(twice, same, "left_semi"), id_col, text_col).select(id_col, F.lower("word").alias("word")).distinct()
    return (once.unionByName(again.where(F.col("word").isNotNull()).select("word", F.lit(1).cast("long").alias("_d")))
            .groupBy("word").agg(F.sum("_d").alias("_d"))
            .where(F.col("_d") >= F.lit(min_share) * df.agg(F.count(F.lit(1))).scalar()).select("word"))


def misspelling_rate(df: DataFrame, dictionary: DataFrame, id_col: str = "article_id",
                     text_col: str = "text") -> DataFrame:
    """Share of words whose lower-case form is not in ``dictionary``; words
    starting upper-case are skipped but counted; 0.0 without words (F4).
    A small dictionary is broadcast and a text's words are counted in its row, so only sums by text move; for a large one
    words are first reduced to distinct (id, lower word, capitalised) with a count."""
    d = cut_lineage(dictionary.select(F.col("word").alias("lw"), F.lit(True).alias("known")).distinct())
    if d.count() <= MANY_WORDS:
        words = frozenset(w.encode() for w in d.select("lw").where("lw IS NOT NULL").toArrow().column(0).to_pylist())
        known = df.sparkSession.sparkContext.broadcast(words)

        def count(batches):
            right = known.value
            for batch in batches:
                found, missed = [], []
                for text in batch.column(1):
                    mine = _cut_words(text, _SPACED)
                    found.append(len(mine))
                    missed.append(sum(w[0] > 96 and w.lower() not in right for w in mine))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), pa.array(missed, pa.int64())], names=["_id", "_words", "_miss"])

        kind = df.schema[id_col].dataType.simpleString()
        agg = (df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(count, f"_id {kind}, _words bigint, _miss bigint")
               .groupBy(F.col("_id").alias(id_col)).agg(F.sum("_words").alias("_words"), F.sum("_miss").alias("_miss")))
    else:
        w = letter_words(df, id_col, text_col).select(id_col, F.lower("word").alias("lw"), F.col("word").rlike("^[A-Z]").alias("cap"))
        j = w.groupBy(id_col, "lw", "cap").agg(F.count("lw").alias("n")).join(d, "lw", "left")
        agg = j.groupBy(id_col).agg(
            F.sum("n").alias("_words"),
            F.sum(F.when(~F.col("cap") & F.col("known").isNull() & F.col("lw").isNotNull(), F.col("n")).otherwise(0)).alias("_miss"))
    rate = F.when(F.col("_words") > 0, F.col("_miss") / F.col("_words")).otherwise(F.lit(0.0))
    return _long(agg, id_col, "misspellings", F.lit("misspellings"), rate)


# ------------------------------------------------------------------ F5 rule violations

def rule_violation_rate(df: DataFrame, rules: DataFrame, id_col: str = "article_id",
                        text_col: str = "text") -> DataFrame:
    """Rule hits (non-overlapping regex matches, summed over all rules) per
    whitespace word; 0.0 for empty texts (F5, re-aimed grammar check).  The
    rules are configuration; they are compiled into one projection of
    ``regexp_count`` terms, so no join is needed at all."""
    rows = rules.select("rule_id", "regex").orderBy("rule_id").collect()
    text = F.coalesce(F.col(text_col), F.lit(""))
    hits = F.lit(0).cast("long")
    for r in rows:
        hits = hits + F.regexp_count(text, F.lit(r["regex"]))
    wc = T.word_count(text)
    rate = F.when(wc > 0, hits / wc).otherwise(F.lit(0.0))
    return _long(df, id_col, "grammar_mistakes", F.lit("grammar_mistakes"), rate)


# ------------------------------------------------------------------ F6 cosine LSH

def plane_chunks(key: Column, bits: int, salt: str = "") -> list[Column]:
    """32-bit chunks of +/-1 hyperplane signs for ``key``: md5(salt key ':' k)
    gives 128 bits = four 32-bit chunks per k.  Identical in DuckDB."""
    out = []
    for c in range((bits + 31) // 32):
        k, part = divmod(c, 4)
        h = F.md5(F.concat(F.lit(salt), key.cast("string"), F.lit(f":{k}")))
        out.append(F.conv(F.substring(h, 1 + 8 * part, 8), 16, 10).cast("long"))
    return out


def _chunk_frame(rows: DataFrame, id_col: str, key_col: str, weight_col: str, bits: int,
                 salt: str) -> DataFrame:
    chunks = plane_chunks(F.col(key_col), bits, salt)
    return rows.select(F.col(id_col).alias("_id"), F.col(weight_col).cast("double").alias("_w"),
                       *[c.alias(f"_c{i}") for i, c in enumerate(chunks)])


def sign_dots(rows: DataFrame, id_col: str, key_col: str, weight_col: str, bits: int,
              salt: str = "") -> DataFrame:
    """(id, dot_0..dot_{bits-1}) as plain Spark aggregates (reference form,
    fine for a few dozen bits; ``lsh_signatures`` uses the vectorised kernel)."""
    base = _chunk_frame(rows, id_col, key_col, weight_col, bits, salt)
    aggs = []
    for b in range(bits):
        c, j = divmod(b, 32)
        bit = F.shiftright(F.col(f"_c{c}"), j).bitwiseAND(F.lit(1))
        aggs.append(F.sum(F.when(bit == 1, F.col("_w")).otherwise(-F.col("_w"))).alias(f"dot_{b}"))
    return base.groupBy("_id").agg(*aggs).withColumnRenamed("_id", id_col)


def signature_hex(dots: DataFrame, id_col: str, bits: int) -> DataFrame:
    """Pack sign bits (dot rounded to 9 digits >= 0) of ``sign_dots`` output
    into hex; bit 0 is the most significant bit of the first 32-bit word."""
    words = []
    for c in range((bits + 31) // 32):
        width = min(32, bits - 32 * c)
        acc = F.lit(0).cast("long")
        for j in range(width):
            on = (F.round(F.col(f"dot_{32 * c + j}"), 9) >= 0).cast("long")
            acc = acc + F.shiftleft(on, width - 1 - j)
        words.append(F.lpad(F.lower(F.hex(acc)), (width + 3) // 4, "0"))
    return dots.select(F.col(id_col), F.concat(*words).alias("signature"))


def _signature_kernel(bits: int):
    """mapInPandas body: rows arrive clustered and sorted by ``_id``; each
    document's weighted +/-1 sums are computed with numpy (bits unpacked from
    the 32-bit hash chunks) and its sign bits packed into hex.  Only the rows
    of the current document are carried across Arrow batches."""
    import numpy as np
    import pandas as pd

    n_chunks = (bits + 31) // 32
    shifts = np.arange(32, dtype=np.uint64)

    def signatures(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["_id"].to_numpy()
        w = pdf["_w"].to_numpy(dtype=np.float64)
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        words = []
        for c in range(n_chunks):
            width = min(32, bits - 32 * c)
            ch = pdf[f"_c{c}"].to_numpy().astype(np.uint64)
            on = ((ch[:, None] >> shifts[:width]) & np.uint64(1)).astype(np.float64)
            dots = np.add.reduceat((2.0 * on - 1.0) * w[:, None], starts, axis=0)
            bit = (np.round(dots, 9) >= 0).astype(np.uint64)
            word = (bit << np.arange(width - 1, -1, -1, dtype=np.uint64)[None, :]).sum(axis=1)
            words.append([format(int(x), f"0{(width + 3) // 4}x") for x in word])
        sig = ["".join(parts) for parts in zip(*words)]
        return pd.DataFrame({"_id": ids[starts], "signature": sig})

    def run(batches):
        carry = None
        for pdf in batches:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf["_id"].iloc[-1]
            tail = (pdf["_id"] == last).to_numpy()
            done, carry = pdf[~tail], pdf[tail]
            if len(done):
                yield signatures(done)
        if carry is not None and len(carry):
            yield signatures(carry)

    return run


def sign_signatures(rows: DataFrame, id_col: str, key_col: str, weight_col: str, bits: int,
                    salt: str = "") -> DataFrame:
    """(id, signature): sign bits of sum over keys of weight x hyperplane sign.

    The hash chunks are computed JVM-side; rows are clustered and sorted by
    document (free when the input is already partitioned that way, as after
    the TF-IDF row normalisation - Spark drops the redundant exchange/sort);
    the per-document reduction is a streaming numpy kernel."""
    # dealt and sorted before the chunks are made, which are many times as long as a row
    rows = rows.select(id_col, key_col, weight_col).repartition(id_col).sortWithinPartitions(id_col)
    base = _chunk_frame(rows, id_col, key_col, weight_col, bits, salt)
    out = base.mapInPandas(_signature_kernel(bits), f"_id {dict(rows.dtypes)[id_col]}, signature string")
    return out.withColumnRenamed("_id", id_col)


def lsh_signatures(weights: DataFrame, id_col: str, bits: int = 512, term_col: str = "term",
                   weight_col: str = "weight") -> DataFrame:
    """Cosine LSH signature (hex) of each row's weighted term vector."""
    return sign_signatures(weights, id_col, term_col, weight_col, bits)


def lsh_feature(df: DataFrame, id_col: str, text_col: str, bits: int = 512, ngram: int = 1,
                weights: DataFrame | None = None) -> DataFrame:
    """The signature as one multi-hot category ``lsh_<hex>``; ``weights`` are
    those of ``tfidf_weights`` if already built."""
    weights = tfidf_weights(df, id_col, text_col, ngram) if weights is None else weights
    sig = lsh_signatures(weights, id_col, bits)
    return _long(sig, id_col, "lsh", F.concat(F.lit("lsh_"), F.col("signature")), F.lit(1.0))


def lsh_bands(signatures: DataFrame, id_col: str, bands: int, bits: int) -> DataFrame:
    """Banding for candidate search: (id, band, band_key) with ``bands`` equal
    slices of the signature (hex digits); the last band takes the rest."""
    digits = bits // 4
    if not 1 <= bands <= digits:
        raise ValueError(f"bands must be from 1 to {digits}")
    per = digits // bands
    return signatures.select(F.col(id_col), F.posexplode(F.array(*[
        F.substring("signature", 1 + b * per, per if b < bands - 1 else digits) for b in range(bands)])).alias("band", "band_key"))


# ------------------------------------------------------------------ F7 source count

def netloc_counts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """(_netloc, _n): rows per netloc."""
    return df.select(U.url_netloc(url_col).alias("_netloc")).groupBy("_netloc").agg(F.count(F.lit(1)).alias("_n"))


def source_count(df: DataFrame, id_col: str = "article_id", url_col: str = "url", counts: DataFrame | None = None) -> DataFrame:
    """Number of rows with the same netloc, on every row (F7, G8); with ``counts`` from other rows, 0 for a netloc
    they do not have.  A groupBy + join instead of a window: a domain holding a third of all rows would
    otherwise sit in one task."""
    nl = df.select(F.col(id_col), U.url_netloc(url_col).alias("_netloc"))
    if counts is None:
        joined = nl.join(netloc_counts(df, url_col), "_netloc")
    else:
        joined = nl.join(counts, "_netloc", "left").fillna(0, ["_n"])
    return _long(joined, id_col, "source_count", F.lit("source_count"), F.col("_n"))


# ------------------------------------------------------------------ F8 emotion scores

def lexicon_matrix(lexicon: DataFrame, affects: list[str] | None = None) -> DataFrame:
    """(word, a_0..a_9): one row per lexicon word, 1 where associated."""
    affects = affects or AFFECTS
    return lexicon.groupBy("word").agg(*[
        F.max(F.when(F.col("affect") == a, 1).otherwise(0)).alias(f"a_{i}") for i, a in enumerate(affects)])


def emotion_scores(df: DataFrame, lexicon: DataFrame, id_col: str = "article_id", text_col: str = "text",
                   affects: list[str] | None = None, max_lexicon_words: int = 2_000_000) -> DataFrame:
    """Per affect, share of normalised tokens in its word set; zeros for
    texts without tokens (F8).  Output order trust, fear, ... anticipation."""
    affects = affects or AFFECTS
    # explode_outer keeps token-less texts as one null row (n = 0), so no join
    # back to the corpus is needed for their all-zero scores
    ex = df.select(F.col(id_col), F.explode_outer(T.raw_normal_tokens(F.col(text_col))).alias("token"))
    toks = ex.select(id_col, F.when(T.keep_token(F.col("token")), F.col("token")).alias("token"))
    lex = lexicon_matrix(lexicon, affects).withColumnRenamed("word", "token")
    if lex.limit(max_lexicon_words + 1).count() <= max_lexicon_words:  # broadcast to the tokens: only sums by text move
        j = toks.withColumn("n", F.col("token").isNotNull().cast("long")).join(F.broadcast(lex), "token", "left")
    else:
        j = toks.groupBy(id_col, "token").agg(F.count("token").alias("n")).join(lex, "token", "left")
    scores = j.groupBy(id_col).agg(F.sum("n").alias("_tot"),
                                   *[F.sum(F.col("n") * F.coalesce(F.col(f"a_{i}"), F.lit(0))).alias(f"_s{i}")
                                     for i in range(len(affects))])
    parts = []
    for i, a in enumerate(affects):
        v = F.when(F.col("_tot") > 0, F.col(f"_s{i}") / F.col("_tot")).otherwise(F.lit(0.0))
        parts.append(F.struct(F.lit(f"sent_{a}").alias("feature"), v.cast("double").alias("value")))
    return scores.select(F.col(id_col), F.lit("sent").alias("family"), F.inline(F.array(*parts)))


# ------------------------------------------------------------------ F9-F13

def assemble(parts: list[DataFrame]) -> DataFrame:
    """Stack families in long form."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_subset(features: DataFrame, families: list[str]) -> DataFrame:
    """Keep the named families (F11).  ``families`` are option names
    ('tfidf', 'tags', ...) or prefixes; asking for a family that was not built
    is an error, as in the reference."""
    prefixes = [FAMILY_PREFIX.get(f, f) for f in families]
    return features.where(F.col("family").isin(prefixes))


def family_counts(features: DataFrame) -> DataFrame:
    """Distinct feature names per family."""
    return features.groupBy("family").agg(F.countDistinct("feature").alias("n_features"))
