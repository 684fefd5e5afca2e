"""The options object and builder for the whole feature matrix.

``FeatureOptions`` carries the 11 family switches plus ``ngram`` /
``stop_words``; ``build_features`` returns the long form of every enabled
family over the fitting set (labelled articles and ground truth together, F10),
with an ``origin`` column to split them back.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import features as FT


@dataclass(frozen=True)
class FeatureOptions:
    tfidf: bool = True
    author: bool = True
    tags: bool = True
    title: bool = True
    ngram: int = 1
    domain_endings: bool = True
    word_count: bool = True
    misspellings: bool = True
    grammar_mistakes: bool = True
    lshash: bool = True
    source_count: bool = True
    sentiment: bool = True
    stop_words: bool = False
    lsh_bits: int = 512

    def families(self) -> list[str]:
        return [f.name for f in fields(self)
                if f.name in FT.FAMILY_PREFIX and getattr(self, f.name)]


# the option set of the studied feature sweep and time slices (fixed values of the task)
SWEEP_OPTIONS = FeatureOptions(domain_endings=False, author=False, source_count=False, tags=True,
                               misspellings=True, grammar_mistakes=False, word_count=False, tfidf=True,
                               ngram=1, lshash=False, title=True, sentiment=False, stop_words=False)


def build_features(corpus: DataFrame, opts: FeatureOptions, dictionary: DataFrame | None = None,
                   rules: DataFrame | None = None, lexicon: DataFrame | None = None,
                   id_col: str = "article_id", state: FittedFeatures | None = None) -> DataFrame:
    """Long-form features (id, family, feature, value) of every enabled family; statistics over rows (document
    frequencies, source counts) are those of ``corpus``, or of ``state``."""
    def weights(col: str, stop: bool) -> DataFrame:
        if state is None:
            return FT.tfidf_weights(corpus, id_col, col, opts.ngram, stop)
        tf = FT.term_counts(corpus, id_col, col, opts.ngram, stop)
        return FT.weigh(tf, state.terms[col if stop == opts.stop_words else f"{col}_all"], F.lit(float(state.n_docs)), id_col)

    parts: list[DataFrame] = []
    shared = None
    if opts.lshash and (state is not None or opts.tfidf and not opts.stop_words):  # both may read the same body weights
        shared = cut_lineage(weights("text", False))
    if opts.author:
        parts.append(FT.multi_hot(corpus, id_col, "authors", "auth"))
    if opts.tags:
        parts.append(FT.multi_hot(corpus, id_col, "tags", "tag"))
    if opts.tfidf:
        parts.append(FT.tfidf(corpus, id_col, "text", "text", weights=weights("text", opts.stop_words)
                              if shared is None or opts.stop_words else shared))
    if opts.title:
        parts.append(FT.tfidf(corpus, id_col, "title", "title", weights=weights("title", opts.stop_words)))
    if opts.domain_endings:
        parts.append(FT.domain_endings(corpus, id_col, "url"))
    if opts.word_count:
        parts.append(FT.word_count(corpus, id_col, "text"))
    if opts.misspellings:
        if dictionary is None:
            raise ValueError("misspellings needs a dictionary table")
        parts.append(FT.misspelling_rate(corpus, dictionary, id_col, "text"))
    if opts.grammar_mistakes:
        if rules is None:
            raise ValueError("grammar_mistakes needs a rules table")
        parts.append(FT.rule_violation_rate(corpus, rules, id_col, "text"))
    if opts.lshash:
        parts.append(FT.lsh_feature(corpus, id_col, "text", opts.lsh_bits, opts.ngram, weights=shared))
    if opts.source_count:
        parts.append(FT.source_count(corpus, id_col, "url", counts=None if state is None else state.sources))
    if opts.sentiment:
        if lexicon is None:
            raise ValueError("sentiment needs an emotion lexicon")
        parts.append(FT.emotion_scores(corpus, lexicon, id_col, "text"))
    if not parts:
        raise ValueError("no feature family enabled")
    return FT.assemble(parts)


@dataclass
class FittedFeatures:
    """What a fit on some rows knows (F14): document frequencies, number of rows, source counts and the feature names
    found, as tables in a folder.  It transforms other rows, which change nothing in it: an unseen term or category has no
    feature, an unseen source counts 0."""
    opts: FeatureOptions
    path: str
    n_docs: int
    terms: dict[str, DataFrame]
    sources: DataFrame
    names: DataFrame | None = None

    @staticmethod
    def load(spark, path: str, opts: FeatureOptions) -> FittedFeatures:
        """The state that ``fit_features`` saved in ``path``."""
        terms = spark.read.parquet(f"{path}/terms")
        kinds = ["text", "title", *(["text_all"] if opts.stop_words else [])]
        return FittedFeatures(opts, path, spark.read.parquet(f"{path}/rows").first().n,
                              {k: terms.where(F.col("kind") == k).select("term", "df") for k in kinds},
                              spark.read.parquet(f"{path}/sources"), spark.read.parquet(f"{path}/names"))

    def transform(self, rows: DataFrame, dictionary: DataFrame | None = None, rules: DataFrame | None = None,
                  lexicon: DataFrame | None = None, id_col: str = "article_id") -> DataFrame:
        """Long-form features of ``rows`` with the fitted statistics and names."""
        found = build_features(rows, self.opts, dictionary, rules, lexicon, id_col, state=self)
        return found.join(self.names, ["family", "feature"], "left_semi").select(id_col, "family", "feature", "value")


def fit_features(rows: DataFrame, opts: FeatureOptions, path: str, dictionary: DataFrame | None = None, rules: DataFrame | None = None,
                 lexicon: DataFrame | None = None, id_col: str = "article_id") -> FittedFeatures:
    """Fit the statistics and feature names on ``rows`` and save them in ``path``."""
    spark = rows.sparkSession
    kinds = [("text", "text", opts.stop_words), ("title", "title", opts.stop_words)]
    if opts.stop_words:  # signatures are made of all words
        kinds.append(("text_all", "text", False))
    for k, (kind, col, stop) in enumerate(kinds):
        counts = FT.document_frequencies(FT.term_counts(rows, id_col, col, opts.ngram, stop))
        counts.select(F.lit(kind).alias("kind"), "term", "df").write.mode("overwrite" if k == 0 else "append").partitionBy("kind").parquet(f"{path}/terms")
    rows.agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows")
    FT.netloc_counts(rows).write.mode("overwrite").parquet(f"{path}/sources")
    terms = spark.read.parquet(f"{path}/terms")
    state = FittedFeatures(opts, path, spark.read.parquet(f"{path}/rows").first().n,
                           {k: terms.where(F.col("kind") == k).select("term", "df") for k, _, _ in kinds}, spark.read.parquet(f"{path}/sources"))
    built = build_features(rows, opts, dictionary, rules, lexicon, id_col, state=state)
    built.select("family", "feature").distinct().write.mode("overwrite").parquet(f"{path}/names")
    return FittedFeatures.load(spark, path, opts)


def partial_features(features: DataFrame, built: FeatureOptions, **include: bool) -> DataFrame:
    """Subset of families (F11): error for a family that was not built."""
    wanted = []
    for name, on in include.items():
        if not on:
            continue
        if not getattr(built, name):
            raise ValueError(f"cannot include feature set {name!r}: it was not built")
        wanted.append(name)
    if not wanted:
        raise ValueError("empty feature selection")
    return FT.feature_subset(features, wanted)


def with_origin(features: DataFrame, corpus: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Attach origin/label of each row for the split back."""
    return features.join(corpus.select(id_col, "origin", "label"), id_col)


def round_values(features: DataFrame, digits: int = 6) -> DataFrame:
    return features.withColumn("value", F.round("value", digits))
