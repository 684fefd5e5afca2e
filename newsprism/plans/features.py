"""Feature families in long form (F1-F13) over the fitting set (labelled
articles + ground truth), each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from ..operators.featureset import FeatureOptions, SWEEP_OPTIONS, build_features, fit_features, partial_features
from ..operators.splits import train_test_split
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import io as IO
from ..sources import views as V
from ..sources.tables import table
from . import sqlfeatures as SF
from .catalog import register

LONG = ["article_id", "family", "feature", "value"]


def _corpus(spark, sf):
    return V.labelled_corpus(spark, sf)


def _dictionary(spark, sf):
    return FT.corpus_dictionary(table(spark, sf, "documents"), "doc_id", "text")


def _round(df):
    return df.select(*[F.round(c, 6).alias(c) if c == "value" else F.col(c) for c in df.columns])


def _sql(ctes: list[str], final: str) -> str:
    return V.with_articles(",\n" + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + final)


def _family_sql(builder, *args):
    def make():
        ctes, name = builder(*args)
        return _sql(ctes, f"SELECT article_id, family, feature, round(value, 6) AS value FROM {name}")
    return make


@register("multi_hot", sql=lambda: _sql(
    SF.multi_hot("labelled", "authors", "auth", "fa")[0] + SF.multi_hot("labelled", "tags", "tag", "ft")[0],
    "SELECT * FROM fa UNION ALL SELECT * FROM ft"))
def multi_hot(spark, sf):
    c = _corpus(spark, sf)
    return _round(FT.multi_hot(c, "article_id", "authors", "auth").unionByName(FT.multi_hot(c, "article_id", "tags", "tag")))


@register("multi_hot_domain", sql=_family_sql(SF.domain_endings, "labelled", "fd"))
def multi_hot_domain(spark, sf):
    return _round(FT.domain_endings(_corpus(spark, sf)))


@register("tfidf", sql=_family_sql(SF.tfidf, "labelled", "text", "text", "fx"))
def tfidf(spark, sf):
    return _round(FT.tfidf(_corpus(spark, sf), "article_id", "text", "text"))


@register("tfidf_bigrams", sql=_family_sql(SF.tfidf, "labelled", "text", "text", "fx", 2))
def tfidf_bigrams(spark, sf):
    return _round(FT.tfidf(_corpus(spark, sf), "article_id", "text", "text", ngram=2))


@register("tfidf_stopwords", sql=_family_sql(SF.tfidf, "labelled", "text", "text", "fx", 1, True))
def tfidf_stopwords(spark, sf):
    return _round(FT.tfidf(_corpus(spark, sf), "article_id", "text", "text", remove_stop_words=True))


@register("title_tfidf", sql=_family_sql(SF.tfidf, "labelled", "title", "title", "fx"))
def title_tfidf(spark, sf):
    return _round(FT.tfidf(_corpus(spark, sf), "article_id", "title", "title"))


@register("misspelling_rate", sql=lambda: _sql(
    SF.corpus_dictionary("dict") + SF.misspellings("labelled", "dict", "fm")[0],
    "SELECT article_id, family, feature, round(value, 6) AS value FROM fm"))
def misspelling_rate(spark, sf):
    return _round(FT.misspelling_rate(_corpus(spark, sf), _dictionary(spark, sf)))


@register("rule_violation_rate", sql=_family_sql(SF.rule_violations, "labelled", "fg"))
def rule_violation_rate(spark, sf):
    return _round(FT.rule_violation_rate(_corpus(spark, sf), FX.grammar_rules(spark)))


@register("lsh_signature", sql=lambda: _sql(
    SF.tfidf_weights("labelled", "text", "w") + SF.sign_dots("w", "term", "weight", 512, "s") + [SF.signature_hex("s", 512)],
    "SELECT id AS article_id, signature FROM s"))
def lsh_signature(spark, sf):
    w = FT.tfidf_weights(_corpus(spark, sf), "article_id", "text")
    return FT.lsh_signatures(w, "article_id", 512)


@register("lsh_buckets", sql=lambda: _sql(
    SF.tfidf_weights("labelled", "text", "w") + SF.sign_dots("w", "term", "weight", 512, "s") + [SF.signature_hex("s", 512)],
    """SELECT CAST(r.b AS BIGINT) AS band, substr(s.signature, 1 + r.b * 4, 4) AS band_key, count(*) AS n_docs
       FROM s CROSS JOIN range(0, 32) r(b) GROUP BY r.b, band_key"""))
def lsh_buckets(spark, sf):
    w = FT.tfidf_weights(_corpus(spark, sf), "article_id", "text")
    bands = FT.lsh_bands(FT.lsh_signatures(w, "article_id", 512), "article_id", 32, 512)
    return (bands.groupBy(F.col("band").cast("long").alias("band"), "band_key")
            .agg(F.count(F.lit(1)).alias("n_docs")))


@register("lsh_embeddings", sql=lambda: "WITH " + ",\n".join(
    ["ev AS (SELECT vec_id, unnest(range(0, len(embedding))) AS d, unnest(embedding) AS e FROM embeddings)"]
    + SF.sign_dots("ev", "d", "e", 64, "s", salt="dim", id_col="vec_id") + [SF.signature_hex("s", 64)])
    + "\nSELECT id AS vec_id, signature FROM s")
def lsh_embeddings(spark, sf):
    emb = table(spark, sf, "embeddings")
    rows = emb.select("vec_id", F.posexplode("embedding").alias("d", "e"))
    return FT.sign_signatures(rows, "vec_id", "d", "e", 64, salt="dim")


@register("source_count", sql=_family_sql(SF.source_count, "labelled", "fs"))
def source_count(spark, sf):
    return _round(FT.source_count(_corpus(spark, sf)))


@register("sentiment_scores", sql=_family_sql(SF.sentiment, "labelled", "fe"))
def sentiment_scores(spark, sf):
    # the lexicon goes through its file format
    path = scratch_path(spark, "lexicon")
    FX.emotion_lexicon(spark).withColumn("association", F.lit(1)).write.option("sep", "\t").csv(path)
    return _round(FT.emotion_scores(_corpus(spark, sf), IO.read_emotion_lexicon(spark, path)))


def full_features(spark, sf, opts: FeatureOptions | None = None):
    return build_features(_corpus(spark, sf), opts or FeatureOptions(), dictionary=_dictionary(spark, sf),
                          rules=FX.grammar_rules(spark), lexicon=FX.emotion_lexicon(spark))


def _all_sql(final):
    def make():
        ctes, names = SF.all_families("labelled")
        return _sql(ctes + [f"feat AS ({SF.union_sql(names)})"], final)
    return make


@register("assemble_features", sql=_all_sql(
    "SELECT article_id, family, feature, round(value, 6) AS value FROM feat"))
def assemble_features(spark, sf):
    return _round(full_features(spark, sf))


@register("feature_subset", sql=_all_sql(
    "SELECT article_id, family, feature, round(value, 6) AS value FROM feat "
    "WHERE family IN ('tag', 'misspellings', 'text', 'title')"))
def feature_subset(spark, sf):
    feats = full_features(spark, sf)
    sub = partial_features(feats, FeatureOptions(), tags=True, misspellings=True, tfidf=True, title=True)
    return _round(sub)


@register("feature_family_counts", sql=_all_sql(
    "SELECT family, count(DISTINCT feature) AS n_features FROM feat GROUP BY family"))
def feature_family_counts(spark, sf):
    return FT.family_counts(full_features(spark, sf))


@register("sweep_features", sql=_all_sql(
    "SELECT article_id, family, feature, round(value, 6) AS value FROM feat "
    "WHERE family IN ('tag', 'misspellings', 'text', 'title')"))
def sweep_features(spark, sf):
    """The feature set of the studied sweep and time slices, built directly."""
    return _round(full_features(spark, sf, SWEEP_OPTIONS))


# ------------------------------------------------------------------ fitted state

FITTED_OPTIONS = FeatureOptions(author=False, tags=True, tfidf=True, title=True, domain_endings=True, word_count=False, misspellings=True,
                                grammar_mistakes=False, lshash=False, source_count=True, sentiment=False)


def _fitted_sql(fit_on: str) -> str:
    """Features of all labelled articles with statistics and names of the fit rows only."""
    fit = "train" if fit_on == "train" else "any"
    ctes = ["""fsp AS (SELECT *, CASE WHEN substr(md5(CAST(article_id AS VARCHAR)), 1, 2) < 'cc' THEN 'train' ELSE 'test' END AS split
                       FROM labelled_articles)""",
            "ffit AS (SELECT * FROM fsp" + (" WHERE split = 'train')" if fit == "train" else ")")]
    names = []
    for col, prefix in (("text", "text"), ("title", "title")):
        w = SF.tfidf_weights("fsp", col, f"w_{col}")
        w[3] = f"w_{col}_df AS (SELECT term, count(*) AS df FROM w_{col}_tf WHERE id IN (SELECT article_id FROM ffit) GROUP BY term)"
        w[4] = f"w_{col}_n AS (SELECT count(*) AS n FROM ffit)"
        ctes += [*w, f"""f_{col} AS (SELECT id AS article_id, '{prefix}' AS family, '{prefix}_' || term AS feature, weight AS value FROM w_{col})"""]
        names.append(f"f_{col}")
    ctes += SF.corpus_dictionary("f_dict")
    for part, name in (SF.multi_hot("fsp", "tags", "tag", "f_tag"), SF.domain_endings("fsp", "f_domain"), SF.misspellings("fsp", "f_dict", "f_mis")):
        ctes += part
        names.append(name)
    from ..sources.views import netloc_sql
    ctes.append(f"f_cnt AS (SELECT {netloc_sql('url')} AS netloc, count(*) AS n FROM ffit GROUP BY 1)")
    ctes.append(f"""f_src AS (SELECT a.article_id, 'source_count' AS family, 'source_count' AS feature, CAST(coalesce(c.n, 0) AS DOUBLE) AS value
                    FROM (SELECT article_id, {netloc_sql('url')} AS netloc FROM fsp) a LEFT JOIN f_cnt c ON a.netloc = c.netloc)""")
    names.append("f_src")
    ctes.append(f"feat AS ({SF.union_sql(names)})")
    ctes.append("known AS (SELECT DISTINCT family, feature FROM feat WHERE article_id IN (SELECT article_id FROM ffit))")
    return _sql(ctes, """SELECT f.article_id, s.split, f.family, f.feature, round(f.value, 6) AS value FROM feat f
                         JOIN known k ON f.family = k.family AND f.feature = k.feature JOIN fsp s ON f.article_id = s.article_id""")


def fitted_features(spark, sf, fit_on: str = "train"):
    """Features of all labelled articles by a saved fit on the training rows, or on all of them."""
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on must be 'train' or 'all'")
    rows = train_test_split(V.labelled_articles(spark, sf))
    own = {"dictionary": _dictionary(spark, sf)}
    state = fit_features(rows.where(F.col("split") == "train") if fit_on == "train" else rows, FITTED_OPTIONS,
                         scratch_path(spark, "fitted_features"), **own)
    found = _round(state.transform(rows, **own))
    return found.join(rows.select("article_id", "split"), "article_id").select("article_id", "split", "family", "feature", "value")


@register("fitted_features_train", sql=lambda: _fitted_sql("train"))
def fitted_features_train(spark, sf):
    return fitted_features(spark, sf, "train")


@register("fitted_features_all", sql=lambda: _fitted_sql("all"))
def fitted_features_all(spark, sf):
    return fitted_features(spark, sf, "all")
