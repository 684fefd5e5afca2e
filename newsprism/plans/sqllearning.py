"""DuckDB twins of the SQL-form naive Bayes path and its reports."""

from __future__ import annotations

from . import sqlfeatures as SF

SWEEP_FAMILIES = [("tag", "tags"), ("misspellings", "spell"), ("text", "tfidf"), ("title", "title")]


def sweep_feature_ctes(src: str = "labelled") -> list[str]:
    """CTEs ending in ``feat(article_id, family, feature, value)`` for the
    studied sweep families (tags, misspellings, text, title)."""
    parts = [SF.multi_hot(src, "tags", "tag", "f_tag"), SF.tfidf(src, "text", "text", "f_text"),
             SF.tfidf(src, "title", "title", "f_title")]
    mis = SF.misspellings(src, "f_dict", "f_mis")
    parts.append((SF.corpus_dictionary("f_dict") + mis[0], mis[1]))
    ctes, names = [], []
    for c, n in parts:
        ctes += c
        names.append(n)
    ctes.append(f"feat AS ({SF.union_sql(names)})")
    return ctes


SPLIT_CTE = """sp AS (SELECT article_id, label, title, url, text,
       CASE WHEN substr(md5(CAST(article_id AS VARCHAR)), 1, 2) < 'cc' THEN 'train' ELSE 'test' END AS split
       FROM labelled_articles)"""


def nb_ctes(alpha: float = 1.0, feat: str = "feat", group: str | None = None, train: str = "tr",
            test: str = "te", prefix: str = "nb") -> list[str]:
    """CTEs ending in ``{prefix}_pred(article_id, [grp,] label, s0, s1)``.
    ``feat`` / ``train`` / ``test`` carry the group column when ``group`` is set."""
    g = group
    gk = f"{g}, " if g else ""
    on = (lambda a, b: f"{a}.{g} = {b}.{g}") if g else (lambda a, b: "TRUE")
    a = repr(float(alpha))
    return [
        f"{prefix}_v AS (SELECT {gk}count(DISTINCT feature) AS v FROM {feat} {'GROUP BY ' + g if g else ''})",
        f"{prefix}_cnt AS (SELECT {gk}label, count(*) AS nc FROM {train} GROUP BY {gk}label)",
        f"{prefix}_tot AS (SELECT {gk}sum(nc) AS n FROM {prefix}_cnt {'GROUP BY ' + g if g else ''})",
        f"""{prefix}_sums AS (SELECT {'f.' + g + ', ' if g else ''}t.label, f.feature, sum(f.value) AS s
              FROM {feat} f JOIN {train} t ON f.article_id = t.article_id {'AND f.' + g + ' = t.' + g if g else ''}
              GROUP BY {'f.' + g + ', ' if g else ''}t.label, f.feature)""",
        f"{prefix}_totc AS (SELECT {gk}label, sum(s) AS t FROM {prefix}_sums GROUP BY {gk}label)",
        f"""{prefix}_cls AS (SELECT {'c.' + g + ', ' if g else ''}c.label, ln(c.nc / tt.n) AS log_prior,
              coalesce(tc.t, 0.0) + {a} * vv.v AS denom
              FROM {prefix}_cnt c JOIN {prefix}_tot tt ON {on('c', 'tt')}
              LEFT JOIN {prefix}_totc tc ON tc.label = c.label {'AND tc.' + g + ' = c.' + g if g else ''}
              JOIN {prefix}_v vv ON {on('c', 'vv')})""",
        f"""{prefix}_theta AS (SELECT {'s.' + g + ', ' if g else ''}s.feature,
              max(CASE WHEN s.label = 0 THEN ln((s.s + {a}) / c.denom) END) AS lt0,
              max(CASE WHEN s.label = 1 THEN ln((s.s + {a}) / c.denom) END) AS lt1
              FROM {prefix}_sums s JOIN {prefix}_cls c ON s.label = c.label {'AND s.' + g + ' = c.' + g if g else ''}
              GROUP BY {'s.' + g + ', ' if g else ''}s.feature)""",
        f"""{prefix}_cc AS (SELECT {gk}max(CASE WHEN label = 0 THEN log_prior END) AS p0,
              max(CASE WHEN label = 0 THEN ln({a} / denom) END) AS d0,
              max(CASE WHEN label = 1 THEN log_prior END) AS p1,
              max(CASE WHEN label = 1 THEN ln({a} / denom) END) AS d1
              FROM {prefix}_cls {'GROUP BY ' + g if g else ''})""",
        f"""{prefix}_lk AS (SELECT f.article_id, {'f.' + g + ', ' if g else ''}
              sum(f.value * coalesce(th.lt0, cc.d0)) AS l0, sum(f.value * coalesce(th.lt1, cc.d1)) AS l1
              FROM {feat} f JOIN {test} te ON f.article_id = te.article_id {'AND f.' + g + ' = te.' + g if g else ''}
              LEFT JOIN {prefix}_theta th ON th.feature = f.feature {'AND th.' + g + ' = f.' + g if g else ''}
              JOIN {prefix}_cc cc ON {on('cc', 'f')}
              GROUP BY f.article_id{', f.' + g if g else ''})""",
        f"""{prefix}_pred AS (SELECT te.article_id, {'te.' + g + ', ' if g else ''}te.label,
              coalesce(cc.p0, '-inf'::DOUBLE) + coalesce(lk.l0, 0.0) AS s0,
              coalesce(cc.p1, '-inf'::DOUBLE) + coalesce(lk.l1, 0.0) AS s1
              FROM {test} te LEFT JOIN {prefix}_lk lk ON lk.article_id = te.article_id {'AND lk.' + g + ' = te.' + g if g else ''}
              JOIN {prefix}_cc cc ON {on('cc', 'te')})""",
    ]


PRED_SELECT = ("CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS prediction, "
               "1.0 / (1.0 + exp(s0 - s1)) AS prob_1")


def sweep_settings_sql(families=SWEEP_FAMILIES) -> str:
    """Non-empty subsets of the built families: (setting, family)."""
    rows = []
    k = len(families)
    for m in range(1, 2 ** k):
        for i, (fam, _) in enumerate(families):
            if m >> (k - 1 - i) & 1:
                rows.append(f"({m}, '{fam}')")
    return f"(VALUES {', '.join(rows)}) AS st(setting, family)"
