"""Text normalisation, tokens and language detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import language as L
from ..operators import tokens as TK
from ..sources.tables import table
from . import sqltext as S
from .catalog import register


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@register("normalize_text", sql=lambda: "WITH " + S.normalize_ctes("documents", "doc_id", "text").strip() + """
SELECT id AS doc_id, array_to_string(toks, ' ') AS normalized FROM nz_tok""")
def normalize_text(spark, sf):
    return _docs(spark, sf).select("doc_id", T.normalize_text("text").alias("normalized"))


@register("tokens", sql=lambda: "WITH " + S.normalize_ctes("documents", "doc_id", "text").strip() + """
, ex AS (SELECT id, unnest(toks) AS token FROM nz_tok)
SELECT id AS doc_id, token, count(*) AS n FROM ex GROUP BY id, token""")
def tokens(spark, sf):
    return TK.normalized_token_counts(_docs(spark, sf), "doc_id", "text")


# the table has no apostrophes: the turn's number picks an opening put before its text
OPENINGS = ["I can't say ", "They're here and we'll see ", "Don't ", "it's what you've said ", "She'd've gone "]
OPENED_SQL = f"({S.sql_list(OPENINGS)}[CAST((conv_id + turn) % {len(OPENINGS)} + 1 AS INTEGER)] || text)"


def opened_text():
    nth = (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(OPENINGS))) + 1).cast("int")
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in OPENINGS]), nth), F.col("text"))


@register("expand_contractions", sql=lambda: "WITH " + S.normalize_ctes("conversations", "conv_id * 1000 + turn", OPENED_SQL).strip() + """
SELECT a.id AS row_id, c.t AS expanded FROM nz_a a JOIN nz_c c ON a.id = c.id""")
def expand_contractions(spark, sf):
    conv = table(spark, sf, "conversations")
    return conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
                       T.expand_contractions(T.remove_non_ascii(opened_text())).alias("expanded"))


@register("fold_accents", sql=f"""
SELECT doc_id, {S.fold_accents_sql('text')} AS folded FROM documents""")
def fold_accents(spark, sf):
    return _docs(spark, sf).select("doc_id", T.fold_accents("text").alias("folded"))


@register("wordpunct_tokens", sql=f"""
WITH ex AS (SELECT doc_id, unnest({S.wordpunct_sql('text')}) AS token FROM documents)
SELECT doc_id, token, count(*) AS n FROM ex GROUP BY doc_id, token""")
def wordpunct_tokens(spark, sf):
    return TK.token_counts(_docs(spark, sf), "doc_id", T.wordpunct_tokens("text"))


@register("strip_special_tokens", sql=lambda: f"""
WITH ex AS (SELECT doc_id, unnest(list_filter(list_transform({S.split_tokens_sql('text')},
                 lambda x: translate(x, {S.sql_str(S.PUNCTUATION)}, '')), lambda x: x <> '')) AS token FROM documents)
SELECT doc_id, token, count(*) AS n FROM ex GROUP BY doc_id, token""")
def strip_special_tokens(spark, sf):
    return TK.token_counts(_docs(spark, sf), "doc_id", T.strip_special_tokens("text"))


_LANG_TOKENS = f"list_distinct({S.wordpunct_sql('lower(d.text)')})"


@register("language_ratios", sql=lambda: f"""
WITH t AS (SELECT d.doc_id, {_LANG_TOKENS} AS toks FROM documents d)
SELECT t.doc_id, sw.language, CAST(len(list_filter(t.toks, lambda x: list_contains(sw.words, x))) AS BIGINT) AS hits
FROM t CROSS JOIN {S.languages_values_sql()}""")
def language_ratios(spark, sf):
    return L.language_ratios(_docs(spark, sf), "doc_id", "text")


@register("detect_language", sql=lambda: f"""
WITH t AS (SELECT d.doc_id, {_LANG_TOKENS} AS toks FROM documents d),
h AS (SELECT t.doc_id, sw.language, sw.idx, len(list_filter(t.toks, lambda x: list_contains(sw.words, x))) AS hits
      FROM t CROSS JOIN {S.languages_values_sql()})
SELECT doc_id, arg_max(language, hits * 1000 - idx) AS language FROM h GROUP BY doc_id""")
def detect_language(spark, sf):
    return L.detect_language(_docs(spark, sf), "doc_id", "text")


@register("stem_by_table", sql=lambda: "WITH " + S.normalize_ctes("documents", "doc_id", "text").strip() + r"""
, ex AS (SELECT id, unnest(toks) AS token FROM nz_tok)
, st AS (SELECT token, regexp_replace(token, '(ations|ation|ings|ing|edly|ed|ly|ies|es|s)$', '') AS s FROM (SELECT DISTINCT token FROM ex))
, mp AS (SELECT token, CASE WHEN length(s) >= 2 THEN s ELSE token END AS stem FROM st)
SELECT ex.id AS doc_id, mp.stem, count(*) AS n FROM ex JOIN mp USING (token) GROUP BY ex.id, mp.stem""")
def stem_by_table(spark, sf):
    words = TK.dealt_tokens(_docs(spark, sf), "doc_id", "text")
    stems = TK.suffix_stems(words.select("token").distinct())
    return TK.stem_by_table(words, stems, "doc_id")
