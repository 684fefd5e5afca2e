"""DuckDB twins of the text column functions, generated from the same Python
constants as the Spark side (so the two can never drift apart)."""

from __future__ import annotations

from ..functions.lexicons import CONTRACTIONS, LANGUAGES, PUNCTUATION, TOKEN_SPLITS, sql_list, sql_str, stop_words
from ..functions.text import ACCENT_FROM, ACCENT_TO, contraction_pattern

WP_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def contraction_map_sql() -> str:
    return "MAP {" + ", ".join(f"{sql_str(k)}: {sql_str(v)}" for k, v in CONTRACTIONS) + "}"


def normalize_ctes(src: str, id_col: str, text_col: str, prefix: str = "nz") -> str:
    """CTE chain ``{prefix}_tok(id, toks)``: the N11 token array of each row."""
    pat = sql_str(contraction_pattern())
    grp = sql_str("(" + contraction_pattern() + ")")
    splits = "t1"
    for a, b in TOKEN_SPLITS:
        splits = f"regexp_replace({splits}, '(?i)\\b({a})({b})\\b', '\\1 \\2', 'g')"
    stops = sql_list(stop_words("english"))
    return f"""
{prefix}_a AS (SELECT {id_col} AS id, regexp_replace({text_col}, '[^\\x00-\\x7f]', '', 'g') AS t FROM {src}),
{prefix}_b AS (SELECT id, t, regexp_split_to_array(t, {pat}) AS p,
                      list_transform(regexp_extract_all(t, {grp}, 1),
                                     lambda x: substr(x, 1, 1) || substr(coalesce({contraction_map_sql()}[x], {contraction_map_sql()}[lower(x)]), 2)) AS r
               FROM {prefix}_a),
{prefix}_c AS (SELECT id, CASE WHEN instr(t, '''') > 0
                           THEN array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || coalesce(r[i], '')), '')
                           ELSE t END AS t FROM {prefix}_b),
{prefix}_d AS (SELECT id, lower(translate(t, {sql_str(PUNCTUATION)}, '')) AS t1 FROM {prefix}_c),
{prefix}_e AS (SELECT id, trim(regexp_replace({splits}, '\\s+', ' ', 'g')) AS t2 FROM {prefix}_d),
{prefix}_tok AS (SELECT id, list_filter(string_split(t2, ' '),
                      lambda x: x <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains({stops}, x)) AS toks
                 FROM {prefix}_e)"""


def split_tokens_sql(t: str) -> str:
    s = t
    for a, b in TOKEN_SPLITS:
        s = f"regexp_replace({s}, '(?i)\\b({a})({b})\\b', '\\1 \\2', 'g')"
    return f"list_filter(string_split(trim(regexp_replace({s}, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def wordpunct_sql(t: str) -> str:
    return f"regexp_extract_all({t}, {sql_str(WP_PATTERN)})"


def languages_values_sql() -> str:
    rows = ", ".join(f"({sql_str(lang)}, {i}, {sql_list(stop_words(lang))})" for i, lang in enumerate(LANGUAGES))
    return f"(VALUES {rows}) AS sw(language, idx, words)"


def fold_accents_sql(t: str) -> str:
    return f"regexp_replace(translate({t}, {sql_str(ACCENT_FROM)}, {sql_str(ACCENT_TO)}), '[^\\x00-\\x7f]', '', 'g')"
