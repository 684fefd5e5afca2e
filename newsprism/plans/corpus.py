"""Scans, URL and text scalars, corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import stats as G
from ..operators.splits import split_by_date, train_test_split
from ..sources import io as IO
from ..sources import views as V
from ..sources.tables import table
from .catalog import register

wa = V.with_articles

ARTICLE_COLS = ["article_id", "title", "authors", "publish_date", "url", "text", "tags"]


@register("scan_articles", sql=wa("""
SELECT article_id, title, authors, publish_date, url, text, tags, label FROM articles"""))
def scan_articles(spark, sf):
    return V.articles(spark, sf).select(*ARTICLE_COLS, "label")


@register("limit_offset", sql=wa("""
SELECT article_id, title, url, publish_date FROM all_articles ORDER BY article_id LIMIT 5 OFFSET 11"""))
def limit_offset(spark, sf):
    # a window of rows by position needs an order key; the feature is the limit
    return (V.articles(spark, sf, include_ground_truth=True)
            .select("article_id", "title", "url", "publish_date")
            .orderBy("article_id").offset(11).limit(5))


@register("csv_round_trip", sql=wa("""
SELECT article_id, title, authors, publish_date, url, text, tags FROM articles"""))
def csv_round_trip(spark, sf):
    df = V.articles(spark, sf).select(*ARTICLE_COLS)
    return IO.csv_round_trip(df, "articles_csv")


@register("url_netloc", sql=f"""
SELECT page_id, url, {V.netloc_sql('url')} AS netloc FROM pages""")
def url_netloc(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", U.url_netloc("url").alias("netloc"))


@register("url_base", sql=f"""
SELECT page_id, {V.netloc_sql('url')} AS netloc, {V.base_url_sql('url')} AS base_url FROM pages""")
def url_base(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_netloc("url").alias("netloc"),
                                            U.url_base("url").alias("base_url"))


@register("domain_ending", sql=f"""
SELECT page_id, regexp_extract({V.netloc_sql('url')}, '[.](.+)$', 1) AS domain_ending FROM pages""")
def domain_ending(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.domain_ending("url").alias("domain_ending"))


@register("word_count", sql=f"""
SELECT doc_id, {V.word_count_sql('text')} AS word_count FROM documents""")
def word_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.word_count("text").alias("word_count"))


@register("fix_separators", sql=wa("""
, raw AS (SELECT * FROM raw_articles)
SELECT article_id, regexp_replace(authors, '([a-z])([A-Z])', '\\1,\\2', 'g') AS authors,
       regexp_replace(tags, '([a-z])([A-Z])', '\\1,\\2', 'g') AS tags
FROM raw"""))
def fix_separators(spark, sf):
    raw = V.raw_articles(spark, sf)
    return raw.select("article_id", T.fix_separators("authors").alias("authors"),
                      T.fix_separators("tags").alias("tags"))


@register("fill_missing", sql="""
SELECT d.doc_id, coalesce(l.quality_text, '') AS quality_text
FROM documents d LEFT JOIN (SELECT doc_id, CAST(quality AS VARCHAR) AS quality_text FROM labels) l
  ON d.doc_id = l.doc_id""")
def fill_missing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality_text"))
    return docs.join(lab, "doc_id", "left").select("doc_id", T.fill_missing("quality_text").alias("quality_text"))


@register("date_range", sql=wa("""
SELECT article_id, strftime(date, '%Y-%m-%d %H:%M:%S') AS date FROM articles
WHERE date >= TIMESTAMP '2017-03-01' AND date <= TIMESTAMP '2017-03-10'"""))
def date_range(spark, sf):
    a = V.articles(spark, sf, start_date="2017-03-01", end_date="2017-03-10")
    return a.select("article_id", F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("date"))


@register("preview_text", sql="""
SELECT doc_id, substr(replace(text, chr(10), ' '), 1, 150) AS preview FROM documents""")
def preview_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview("text").alias("preview"))


@register("global_stats", sql=wa("""
SELECT count(*) AS n_articles, count(DISTINCT base_url) AS n_sources,
       round(avg(word_count), 6) AS mean_word_count,
       CAST(count_if(authors = '') AS BIGINT) AS missing_authors, CAST(count_if(title = '') AS BIGINT) AS missing_titles,
       CAST(count_if(text = '') AS BIGINT) AS missing_texts
FROM labelled_articles"""))
def global_stats(spark, sf):
    return G.global_stats(V.labelled_articles(spark, sf))


@register("source_word_stats", sql=wa("""
SELECT base_url, count(*) AS n, round(avg(word_count), 6) AS mean_wc,
       round(stddev_samp(word_count), 6) AS std_wc
FROM labelled_articles GROUP BY base_url ORDER BY n DESC, base_url"""))
def source_word_stats(spark, sf):
    return G.word_count_stats(V.labelled_articles(spark, sf))


@register("top_sources", sql=wa("""
SELECT base_url, count(*) AS n FROM labelled_articles GROUP BY base_url ORDER BY n DESC, base_url LIMIT 10"""))
def top_sources(spark, sf):
    return G.top_sources(V.labelled_articles(spark, sf), 10)


@register("top_sources_articles", sql=wa("""
, top AS (SELECT base_url FROM labelled_articles GROUP BY base_url ORDER BY count(*) DESC, base_url LIMIT 10)
SELECT article_id, base_url FROM labelled_articles WHERE base_url IN (SELECT base_url FROM top)"""))
def top_sources_articles(spark, sf):
    lab = V.labelled_articles(spark, sf)
    top = G.top_sources(lab, 10).select("base_url")
    return lab.join(F.broadcast(top), "base_url", "left_semi").select("article_id", "base_url")


_BOX_SQL = """
, q AS (SELECT {k}, count(*) AS n, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
               quantile_cont({v}, 0.75) AS q3 FROM sel GROUP BY {k})
SELECT q.{k}, q.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(CAST(min(CASE WHEN {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {v} END) AS DOUBLE), 6) AS whisker_lo,
       round(CAST(max(CASE WHEN {v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {v} END) AS DOUBLE), 6) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT ({v} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers
FROM sel JOIN q USING ({k}) GROUP BY q.{k}, q.n, q1, median, q3"""


@register("wordcount_box", sql=wa("""
, top AS (SELECT base_url FROM labelled_articles GROUP BY base_url ORDER BY count(*) DESC, base_url LIMIT 10)
, sel AS (SELECT base_url, word_count FROM labelled_articles WHERE base_url IN (SELECT base_url FROM top))""")
    + _BOX_SQL.format(k="base_url", v="word_count"))
def wordcount_box(spark, sf):
    return G.wordcount_box(V.labelled_articles(spark, sf), 10)


@register("articles_by_source_label", sql=wa("""
, sel AS (SELECT base_url, label, count(*) AS n_articles FROM labelled_articles GROUP BY base_url, label
          HAVING count(*) > 5)""") + _BOX_SQL.format(k="label", v="n_articles").replace(
    "SELECT q.label, q.n,", "SELECT q.label, q.n AS n_sources,"))
def articles_by_source_label(spark, sf):
    return G.articles_by_source_label(V.labelled_articles(spark, sf), 5)


@register("missing_by_source", sql=wa("""
SELECT base_url, CAST(count_if(authors = '') AS BIGINT) AS no_author, CAST(count_if(text = '') AS BIGINT) AS no_text,
       CAST(count_if(title = '') AS BIGINT) AS no_title
FROM labelled_articles GROUP BY base_url
HAVING count_if(authors = '') <> 0 OR count_if(text = '') <> 0 OR count_if(title = '') <> 0"""))
def missing_by_source(spark, sf):
    return G.missing_by_source(V.labelled_articles(spark, sf))


@register("wordcount_density", sql=wa("""
, h AS (SELECT label, word_count, count(*) AS n FROM labelled_articles GROUP BY label, word_count)
, b AS (SELECT label, min(word_count) AS mn, max(word_count) AS mx, sum(n) AS total FROM h GROUP BY label)
, g AS (SELECT h.label, h.word_count, h.n, b.mn, b.mx, b.total, t.gi
        FROM h JOIN b ON h.label = b.label CROSS JOIN range(0, 100) t(gi))
, x AS (SELECT label, gi, (mn - 9.0) + gi * ((mx - mn + 18.0) / 99) AS xv, word_count, n, total FROM g)
SELECT label, gi AS grid_idx, round(min(xv), 6) AS x,
       round(sum(n * exp(-0.5 * ((xv - word_count) / 3.0) * ((xv - word_count) / 3.0))
                 / (3.0 * sqrt(2 * pi()) * total)), 6) AS density
FROM x GROUP BY label, gi"""))
def wordcount_density(spark, sf):
    return G.kde_density(V.labelled_articles(spark, sf), "label", "word_count", bandwidth=3.0, grid_size=100)


@register("split_by_date", sql=wa("""
SELECT article_id, CASE WHEN date < TIMESTAMP '2017-03-01' THEN 'before' ELSE 'after' END AS side
FROM labelled_articles WHERE date IS NOT NULL"""))
def split_by_date_q(spark, sf):
    lab = V.labelled_articles(spark, sf)
    before, after = split_by_date(lab, "2017-03-01")
    return (before.select("article_id", F.lit("before").alias("side"))
            .unionByName(after.select("article_id", F.lit("after").alias("side"))))


@register("train_test_split", sql=wa("""
SELECT article_id, CASE WHEN substr(md5(CAST(article_id AS VARCHAR)), 1, 2) < 'cc' THEN 'train' ELSE 'test' END AS split
FROM labelled_articles"""))
def train_test_split_q(spark, sf):
    lab = V.labelled_articles(spark, sf)
    return train_test_split(lab, "article_id").select("article_id", "split")


@register("label_by_domain", sql=wa(f"""
, nl AS (SELECT article_id, {V.netloc_sql('url')} AS netloc, label FROM articles)
, dom AS (SELECT netloc AS domain, CASE WHEN avg(label) > 0.5 THEN 1.0::DOUBLE WHEN avg(label) < 0.5 THEN 0.0::DOUBLE END AS label
          FROM nl WHERE label IS NOT NULL GROUP BY netloc)
SELECT nl.article_id, nl.netloc, dom.label FROM nl JOIN dom ON nl.netloc = dom.domain WHERE dom.label IS NOT NULL"""))
def label_by_domain(spark, sf):
    """Label every article by its exact netloc through a headerless
    ``domain,label`` CSV (blank label = unknown) and drop unlabelled rows
    (P10, P11, S4, J1).  The domain table is derived from the labelled
    articles: majority label per netloc, blank on a tie."""
    from ..operators.joins import lookup_left
    from ..session import scratch_path
    nl = V.articles(spark, sf).select("article_id", U.url_netloc("url").alias("netloc"), "label")
    m = F.avg("label")
    dom = (nl.where(F.col("label").isNotNull()).groupBy("netloc")
           .agg(F.when(m > 0.5, "1").when(m < 0.5, "0").otherwise("").alias("label_txt")))
    path = scratch_path(spark, "url_labels")
    dom.select("netloc", "label_txt").write.mode("overwrite").option("header", False).csv(path)
    labels = IO.read_url_labels(spark, path).withColumnRenamed("domain", "netloc")
    j = lookup_left(nl.select("article_id", "netloc"), labels, "netloc")
    return j.where(F.col("label").isNotNull()).select("article_id", "netloc", "label")
