"""DuckDB twins of the feature families, generated from the same constants
as the Spark operators.  Each builder returns a list of CTE definitions and
the name of the CTE holding ``(article_id, family, feature, value)``."""

from __future__ import annotations

from ..functions.lexicons import AFFECTS, sql_list, stop_words
from ..operators.features import TERM_PATTERN
from ..sources.fixtures import EMOTION_LEXICON, GRAMMAR_RULES
from .sqltext import normalize_ctes


def multi_hot(src: str, col: str, prefix: str, name: str) -> tuple[list[str], str]:
    return [f"""{name} AS (
  SELECT article_id, '{prefix}' AS family, '{prefix}_' || v AS feature, CAST(count(*) AS DOUBLE) AS value
  FROM (SELECT article_id, unnest(string_split(coalesce({col}, ''), ',')) AS v FROM {src})
  GROUP BY article_id, v)"""], name


def domain_endings(src: str, name: str) -> tuple[list[str], str]:
    from ..sources.views import netloc_sql
    inner = f"(SELECT article_id, regexp_extract({netloc_sql('url')}, '[.](.+)$', 1) AS dend FROM {src})"
    return multi_hot(inner, "dend", "domain", name)


def tfidf_weights(src: str, text_col: str, name: str, ngram: int = 1, remove_stop_words: bool = False) -> list[str]:
    """CTEs ending in ``{name}(id, term, weight)``."""
    arr = f"regexp_extract_all(lower(coalesce({text_col}, '')), '{TERM_PATTERN}')"
    if remove_stop_words:
        arr = f"list_filter({arr}, lambda x: NOT list_contains({sql_list(stop_words('english'))}, x))"
    grams = [f"SELECT id, unnest(t) AS term FROM {name}_arr"]
    for n in range(2, ngram + 1):
        joined = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
        grams.append(f"SELECT id, unnest(list_transform(range(1, len(t) - {n - 2}), lambda i: {joined})) AS term FROM {name}_arr")
    return [
        f"{name}_arr AS (SELECT article_id AS id, {arr} AS t FROM {src})",
        f"{name}_tok AS ({' UNION ALL '.join(grams)})",
        f"{name}_tf AS (SELECT id, term, count(*) AS tf FROM {name}_tok GROUP BY id, term)",
        f"{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term)",
        f"{name}_n AS (SELECT count(*) AS n FROM {src})",
        f"""{name}_w AS (SELECT t.id, t.term, t.tf * (ln((1.0 + n.n) / (1.0 + d.df)) + 1.0) AS w
              FROM {name}_tf t JOIN {name}_df d ON t.term = d.term CROSS JOIN {name}_n n)""",
        f"""{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {name}_w)""",
    ]


def tfidf(src: str, text_col: str, prefix: str, name: str, ngram: int = 1,
          remove_stop_words: bool = False) -> tuple[list[str], str]:
    ctes = tfidf_weights(src, text_col, name + "_wt", ngram, remove_stop_words)
    ctes.append(f"""{name} AS (SELECT id AS article_id, '{prefix}' AS family, '{prefix}_' || term AS feature,
                     weight AS value FROM {name}_wt)""")
    return ctes, name


def word_count(src: str, name: str) -> tuple[list[str], str]:
    return [f"""{name} AS (SELECT article_id, 'word_count' AS family, 'word_count' AS feature,
                 CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS DOUBLE) AS value FROM {src})"""], name


def corpus_dictionary(name: str, min_share: float = 0.005) -> list[str]:
    return [f"""{name} AS (
  SELECT word FROM (
    SELECT DISTINCT doc_id, lower(unnest(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ' '),
                                                     lambda x: x <> ''))) AS word FROM documents)
  GROUP BY word HAVING count(*) >= {min_share} * (SELECT count(*) FROM documents))"""]


def misspellings(src: str, dict_name: str, name: str) -> tuple[list[str], str]:
    return [
        f"""{name}_w AS (SELECT article_id, unnest(list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')), ' '),
                                                  lambda x: x <> '')) AS word FROM {src})""",
        f"""{name}_a AS (SELECT w.article_id, count(*) AS words,
                 sum(CASE WHEN NOT regexp_matches(w.word, '^[A-Z]') AND d.word IS NULL THEN 1 ELSE 0 END) AS miss
                 FROM {name}_w w LEFT JOIN {dict_name} d ON lower(w.word) = d.word GROUP BY w.article_id)""",
        f"""{name} AS (SELECT s.article_id, 'misspellings' AS family, 'misspellings' AS feature,
                 CASE WHEN coalesce(a.words, 0) > 0 THEN a.miss / a.words ELSE 0.0 END AS value
                 FROM {src} s LEFT JOIN {name}_a a ON s.article_id = a.article_id)""",
    ], name


def rule_violations(src: str, name: str) -> tuple[list[str], str]:
    hits = " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{r.replace(chr(39), chr(39) * 2)}'))"
                      for _, r in sorted(GRAMMAR_RULES))
    wc = "len(regexp_extract_all(coalesce(text, ''), '\\S+'))"
    return [f"""{name} AS (SELECT article_id, 'grammar_mistakes' AS family, 'grammar_mistakes' AS feature,
                 CASE WHEN {wc} > 0 THEN ({hits}) / {wc} ELSE 0.0 END AS value FROM {src})"""], name


def sign_dots(rows: str, key: str, weight: str, bits: int, name: str, salt: str = "", id_col: str = "id") -> list[str]:
    chunks = []
    for c in range((bits + 31) // 32):
        k, part = divmod(c, 4)
        chunks.append(f"('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR) || ':{k}'), {1 + 8 * part}, 8))::BIGINT AS c{c}")
    sums = []
    for b in range(bits):
        c, j = divmod(b, 32)
        sums.append(f"sum(CASE WHEN (c{c} >> {j}) & 1 = 1 THEN w ELSE -w END) AS d{b}")
    return [
        f"{name}_c AS (SELECT {id_col} AS id, CAST({weight} AS DOUBLE) AS w, {', '.join(chunks)} FROM {rows})",
        f"{name}_d AS (SELECT id, {', '.join(sums)} FROM {name}_c GROUP BY id)",
    ]


def signature_hex(name: str, bits: int) -> str:
    words = []
    for c in range((bits + 31) // 32):
        width = min(32, bits - 32 * c)
        terms = " + ".join(f"(CASE WHEN round(d{32 * c + j}, 9) >= 0 THEN 1 ELSE 0 END::BIGINT << {width - 1 - j})"
                           for j in range(width))
        words.append(f"lpad(lower(hex({terms})), {(width + 3) // 4}, '0')")
    return f"{name} AS (SELECT id, {' || '.join(words)} AS signature FROM {name}_d)"


def lsh_text(src: str, name: str, bits: int = 512) -> tuple[list[str], str]:
    ctes = tfidf_weights(src, "text", name + "_wt")
    ctes += sign_dots(name + "_wt", "term", "weight", bits, name + "_sig")
    ctes.append(signature_hex(name + "_sig", bits))
    ctes.append(f"""{name} AS (SELECT id AS article_id, 'lsh' AS family, 'lsh_' || signature AS feature, 1.0::DOUBLE AS value
                 FROM {name}_sig)""")
    return ctes, name


def source_count(src: str, name: str) -> tuple[list[str], str]:
    from ..sources.views import netloc_sql
    return [
        f"{name}_n AS (SELECT article_id, {netloc_sql('url')} AS netloc FROM {src})",
        f"{name}_c AS (SELECT netloc, count(*) AS n FROM {name}_n GROUP BY netloc)",
        f"""{name} AS (SELECT a.article_id, 'source_count' AS family, 'source_count' AS feature, CAST(c.n AS DOUBLE) AS value
                 FROM {name}_n a JOIN {name}_c c ON a.netloc = c.netloc)""",
    ], name


def lexicon_values() -> str:
    body = ", ".join(f"('{w}', '{a}')" for w, a in EMOTION_LEXICON)
    return f"(VALUES {body}) AS lx(word, affect)"


def sentiment(src: str, name: str) -> tuple[list[str], str]:
    nz = normalize_ctes(src, "article_id", "text", prefix=name + "_nz").strip().rstrip(",")
    mat = ", ".join(f"max(CASE WHEN affect = '{a}' THEN 1 ELSE 0 END) AS a{i}" for i, a in enumerate(AFFECTS))
    sums = ", ".join(f"sum(c.n * coalesce(m.a{i}, 0)) AS s{i}" for i in range(len(AFFECTS)))
    rows = " UNION ALL ".join(
        f"SELECT s.article_id, 'sent' AS family, 'sent_{a}' AS feature, "
        f"CASE WHEN coalesce(g.tot, 0) > 0 THEN g.s{i} / g.tot ELSE 0.0 END AS value FROM {src} s LEFT JOIN {name}_g g ON s.article_id = g.id"
        for i, a in enumerate(AFFECTS))
    return [
        nz,
        f"{name}_cnt AS (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(toks) AS token FROM {name}_nz_tok) GROUP BY id, token)",
        f"{name}_m AS (SELECT word, {mat} FROM {lexicon_values()} GROUP BY word)",
        f"{name}_g AS (SELECT c.id, sum(c.n) AS tot, {sums} FROM {name}_cnt c LEFT JOIN {name}_m m ON c.token = m.word GROUP BY c.id)",
        f"{name} AS ({rows})",
    ], name


def all_families(src: str = "labelled") -> tuple[list[str], list[str]]:
    """CTEs and part names of the default (all families on) feature matrix."""
    parts = [
        multi_hot(src, "authors", "auth", "f_auth"),
        multi_hot(src, "tags", "tag", "f_tag"),
        tfidf(src, "text", "text", "f_text"),
        tfidf(src, "title", "title", "f_title"),
        domain_endings(src, "f_domain"),
        word_count(src, "f_wc"),
    ]
    dict_cte = corpus_dictionary("f_dict")
    mis = misspellings(src, "f_dict", "f_mis")
    parts += [(dict_cte + mis[0], mis[1]), rule_violations(src, "f_gram"), lsh_text(src, "f_lsh"),
              source_count(src, "f_src"), sentiment(src, "f_sent")]
    ctes, names = [], []
    for c, n in parts:
        ctes += c
        names.append(n)
    return ctes, names


def union_sql(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT article_id, family, feature, value FROM {n}" for n in names)
