"""Stop-word language detection.

Per row: distinct lower-case word/punctuation tokens; for each language the
number of them in its stop-word set; the language with most hits wins, ties
and rows without hits go to the earliest language in list order.

Plan: explode the distinct tokens (codegen'd), broadcast-join the fixed
stop-word table (about 2,500 rows, a proven bound), and count hits per
language with conditional counts in ONE aggregation keyed by the row id.
Exploded rows of one document are produced by one task, so the partial
aggregation collapses them map-side and the shuffle carries about one row
per document.  A left join keeps rows without any hit.  Higher-order array
functions are avoided on purpose: they run interpreted, outside codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import LANGUAGES, stop_words
from ..functions.text import wordpunct_tokens


def stopword_table(spark: SparkSession, languages: list[str] | None = None) -> DataFrame:
    langs = languages or LANGUAGES
    rows = [(w, i) for i, lang in enumerate(langs) for w in stop_words(lang)]
    return spark.createDataFrame(rows, "word STRING, lang_idx INT")


def stopword_hits(df: DataFrame, id_col: str, text_col: str, languages: list[str] | None = None) -> DataFrame:
    """(id, hits_0 .. hits_{k-1}): distinct stop words of each language in the row."""
    langs = languages or LANGUAGES
    words = df.select(F.col(id_col), F.explode_outer(F.array_distinct(wordpunct_tokens(F.lower(F.col(text_col))))).alias("word"))
    joined = words.join(F.broadcast(stopword_table(df.sparkSession, langs)), "word", "left")
    return joined.groupBy(id_col).agg(*[
        F.count_if(F.col("lang_idx") == i).alias(f"hits_{i}") for i in range(len(langs))])


def detect_language(df: DataFrame, id_col: str, text_col: str, languages: list[str] | None = None) -> DataFrame:
    """(id, language): most hits; ties and no hits -> earliest in list order."""
    langs = languages or LANGUAGES
    hits = stopword_hits(df, id_col, text_col, langs)
    best = F.greatest(*[F.struct(F.col(f"hits_{i}").alias("h"), F.lit(-i).alias("neg_idx"), F.lit(lang).alias("language"))
                        for i, lang in enumerate(langs)])
    return hits.select(id_col, best["language"].alias("language"))


def language_ratios(df: DataFrame, id_col: str, text_col: str, languages: list[str] | None = None) -> DataFrame:
    """Long form (id, language, hits) for every language."""
    langs = languages or LANGUAGES
    hits = stopword_hits(df, id_col, text_col, langs)
    return hits.select(id_col, F.inline(F.array(*[
        F.struct(F.lit(lang).alias("language"), F.col(f"hits_{i}").alias("hits")) for i, lang in enumerate(langs)])))
