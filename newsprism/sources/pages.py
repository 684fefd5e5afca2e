"""Fetched web page -> article record (S12), as column expressions.

Title from ``<title>``; text from all ``<article>`` parts (else ``<body>``) with
scripts, styles, navigation, footers and comments removed, block ends turned
into newlines, remaining tags dropped, a fixed set of entities decoded,
spaces collapsed; whole unless ``max_chars`` is given.  Every pattern is one the Java
regex engine and RE2 read the same way, so the DuckDB twin is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: entities decoded, in order ('&amp;' last so that '&amp;lt;' stays '&lt;')
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
            ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&")]
REMOVED_BLOCKS = ["script", "style", "nav", "footer"]


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def page_title(html: Column) -> Column:
    return _strip(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html: Column, max_chars: int | None = None) -> Column:
    art = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<article[^>]*>(.*?)</article>"), F.lit(1)), "\n")
    body = F.when(art != "", art).otherwise(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1))
    for tag in REMOVED_BLOCKS:
        body = F.regexp_replace(body, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    body = F.regexp_replace(body, r"(?i)<(?:br|/p|/h[1-6]|/li|/div)[^>]*>", "\n")
    body = F.regexp_replace(body, r"<[^>]*>", "")
    body = decode_entities(body)
    body = F.regexp_replace(body, r"[ \t]+", " ")
    body = F.regexp_replace(body, r" *\n[ \n]*", "\n")
    return _strip(body) if max_chars is None else F.substring(_strip(body), 1, max_chars)


def pages_to_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, lang) of each fetched page."""
    h = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", page_title(h).alias("title"), page_text(h).alias("text"),
                        F.regexp_extract(h, r"(?i)<html[^>]*\blang=\"([^\"]*)\"", 1).alias("lang"))


# ---------------------------------------------------------------- SQL twin

def _sql_decode(c: str) -> str:
    for ent, ch in ENTITIES:
        c = f"replace({c}, '{ent}', '{ch.replace(chr(39), chr(39) * 2)}')"
    return c


def _sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def pages_to_articles_sql(src: str = "pages") -> str:
    h = "coalesce(html, '')"
    title = _sql_strip(_sql_decode(f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"))
    art = f"array_to_string(regexp_extract_all({h}, '(?is)<article[^>]*>(.*?)</article>', 1), chr(10))"
    body = f"CASE WHEN {art} <> '' THEN {art} ELSE regexp_extract({h}, '(?is)<body[^>]*>(.*?)</body>', 1) END"
    for tag in REMOVED_BLOCKS:
        body = f"regexp_replace({body}, '(?is)<{tag}[^>]*>.*?</{tag}>', '', 'g')"
    body = f"regexp_replace({body}, '(?s)<!--.*?-->', '', 'g')"
    body = f"regexp_replace({body}, '(?i)<(?:br|/p|/h[1-6]|/li|/div)[^>]*>', chr(10), 'g')"
    body = f"regexp_replace({body}, '<[^>]*>', '', 'g')"
    body = _sql_decode(body)
    body = f"regexp_replace({body}, '[ \\t]+', ' ', 'g')"
    body = f"regexp_replace({body}, ' *\\n[ \\n]*', chr(10), 'g')"
    text = _sql_strip(body)
    lang = f"regexp_extract({h}, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1)"
    return f"SELECT page_id, url, {title} AS title, {text} AS text, {lang} AS lang FROM {src}"
