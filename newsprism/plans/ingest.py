"""Ingest, routing and page parsing.

The stand-ins for the scraper's inputs are derived from ``pages``:
stored url sets of earlier runs (articles: page_id % 6 = 0, bad: % 6 = 3,
old: % 9 = 0), this run's candidate listing (every page, pages with
page_id % 7 = 0 listed twice), and a ground-truth list whose lines repeat some
urls with a conflicting label later in the file (first line wins).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..session import scratch_path
from ..sources import io as IO
from ..sources import pages as PG
from ..sources import views as V
from ..sources.tables import table
from ..streaming import ingest as IN
from .catalog import register


def _pages(spark, sf):
    return table(spark, sf, "pages")


def stored_sets(spark, sf):
    p = _pages(spark, sf).select("page_id", "url")
    return [p.where(F.col("page_id") % 6 == 0), p.where(F.col("page_id") % 6 == 3), p.where(F.col("page_id") % 9 == 0)]


def candidates(spark, sf):
    p = _pages(spark, sf).select("page_id", "url")
    return p.unionByName(p.where(F.col("page_id") % 7 == 0))


def gt_list(spark, sf):
    p = _pages(spark, sf).select("page_id", "url")
    first = p.where(F.col("page_id") % 10 == 3).select("url", (F.col("page_id") % 2).cast("int").alias("label"),
                                                       (F.col("page_id") * 2).alias("line_no"))
    again = p.where(F.col("page_id") % 20 == 3).select("url", (1 - F.col("page_id") % 2).cast("int").alias("label"),
                                                       (F.col("page_id") * 2 + 1).alias("line_no"))
    return first.unionByName(again)


SEEN_SQL = """SELECT url FROM pages WHERE page_id % 6 = 0 UNION SELECT url FROM pages WHERE page_id % 6 = 3
              UNION SELECT url FROM pages WHERE page_id % 9 = 0"""


@register("pages_to_articles", sql=PG.pages_to_articles_sql("pages"))
def pages_to_articles(spark, sf):
    return PG.pages_to_articles(_pages(spark, sf))


@register("seen_urls", sql=SEEN_SQL)
def seen_urls(spark, sf):
    return IN.seen_urls(stored_sets(spark, sf))


@register("ingest_new_urls", sql=f"""
WITH cand AS (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 7 = 0)
SELECT DISTINCT url FROM cand WHERE url NOT IN ({SEEN_SQL})""")
def ingest_new_urls(spark, sf):
    return IN.new_urls(candidates(spark, sf), IN.seen_urls(stored_sets(spark, sf)))


@register("ground_truth_csv", sql="""
WITH l AS (SELECT url, CAST(page_id % 2 AS INTEGER) AS label, page_id * 2 AS line_no FROM pages WHERE page_id % 10 = 3
           UNION ALL
           SELECT url, CAST(1 - page_id % 2 AS INTEGER) AS label, page_id * 2 + 1 AS line_no FROM pages WHERE page_id % 20 = 3)
SELECT url, arg_min(label, line_no) AS label FROM l GROUP BY url""")
def ground_truth_csv(spark, sf):
    """The list as headerless CSV files in line order, read back with line
    positions; the first line of a url wins (S5)."""
    path = scratch_path(spark, "ground_truth")
    (gt_list(spark, sf).repartitionByRange("line_no").sortWithinPartitions("line_no").select("url", "label")
     .write.option("header", False).csv(path))
    return J.first_seen(IO.read_ground_truth_urls(spark, path), "url", "line_no").select("url", "label")


@register("word_lines", sql="""
WITH w AS (SELECT unnest(string_split_regex(text, '[ \t\n\r\f\v]+')) AS word FROM benchmark)
SELECT CAST(length(word) AS INTEGER) AS n_chars, count(*) AS n FROM w WHERE word <> '' GROUP BY 1""")
def word_lines(spark, sf):
    """Words of ``benchmark`` as a line file with white space around them and
    blank lines, read back as stripped lines (S6)."""
    path = scratch_path(spark, "word_lines")
    words = F.split("text", r"[ \t\n\r\f\x0B]+")
    (table(spark, sf, "benchmark").select(F.explode(words).alias("word"))
     .select(F.concat(F.lit(" \t"), "word", F.lit("\t ")).alias("value")).write.text(path))
    return IO.read_lines(spark, path).groupBy(F.length("word").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))


@register("ground_truth_first_seen", sql="""
WITH l AS (SELECT url, CAST(page_id % 2 AS INTEGER) AS label, page_id * 2 AS line_no FROM pages WHERE page_id % 10 = 3
           UNION ALL
           SELECT url, CAST(1 - page_id % 2 AS INTEGER) AS label, page_id * 2 + 1 AS line_no FROM pages WHERE page_id % 20 = 3),
f AS (SELECT url, arg_min(label, line_no) AS label FROM l GROUP BY url)
SELECT url, label FROM f WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 30 = 3)""")
def ground_truth_first_seen(spark, sf):
    stored_gt = _pages(spark, sf).where(F.col("page_id") % 30 == 3).select("url")
    return IN.ground_truth_first_seen(gt_list(spark, sf), stored_gt)


def article_rows(raw):
    """Parsed-article rows for routing from the article view."""
    return raw.select("article_id", "url", "text",
                      F.when(F.col("origin") == "ground_truth", F.col("label")).alias("gt_label"),
                      F.try_to_timestamp(F.nullif(F.col("publish_date"), F.lit(""))).alias("date"))


def _lang_sql():
    from .sqltext import languages_values_sql, wordpunct_sql
    return f"""
, lt AS (SELECT d.doc_id, list_distinct({wordpunct_sql('lower(d.text)')}) AS toks FROM documents d)
, lh AS (SELECT lt.doc_id, sw.language, sw.idx, len(list_filter(lt.toks, lambda x: list_contains(sw.words, x))) AS hits
         FROM lt CROSS JOIN {languages_values_sql()})
, lang AS (SELECT doc_id, arg_max(language, hits * 1000 - idx) AS language FROM lh GROUP BY doc_id)
, routed AS (
  SELECT r.article_id,
         CASE WHEN r.text IS NULL OR r.text = '' THEN 'bad'
              WHEN r.origin = 'ground_truth' THEN 'ground_truth'
              WHEN lang.language <> 'english' THEN 'bad'
              WHEN coalesce(try_cast(nullif(r.publish_date, '') AS TIMESTAMP) >= TIMESTAMP '{IN.DEFAULT_CUTOFF}', false) THEN 'articles'
              ELSE 'old' END AS route
  FROM raw_articles r LEFT JOIN lang ON r.article_id = lang.doc_id)"""


@register("route_articles", sql=lambda: V.with_articles(_lang_sql() + "\nSELECT article_id, route FROM routed"))
def route_articles(spark, sf):
    return IN.route_articles(article_rows(V.raw_articles(spark, sf))).select("article_id", "route")


@register("route_counts", sql=lambda: V.with_articles(_lang_sql() + """
, allr AS (SELECT * FROM (VALUES ('bad'), ('ground_truth'), ('articles'), ('old')) t(route))
SELECT a.route, coalesce(c.n, 0) AS n FROM allr a
LEFT JOIN (SELECT route, count(*) AS n FROM routed GROUP BY route) c ON a.route = c.route"""))
def route_counts(spark, sf):
    return IN.route_counts(IN.route_articles(article_rows(V.raw_articles(spark, sf))))


@register("stream_route_articles", sql=lambda: V.with_articles(_lang_sql() + "\nSELECT article_id, route FROM routed"))
def stream_route_articles(spark, sf):
    """The routing as a Structured Streaming job over the documents files
    (availableNow trigger, foreachBatch append to a route-partitioned store);
    returns the store, which must equal the batch routing."""
    labels = table(spark, sf, "labels")

    def prepare(stream):
        return article_rows(V.raw_articles_from(stream, labels))

    source, file_glob = IN.table_source(spark, sf, "documents")
    store = IN.stream_route(spark, source, prepare, file_glob=file_glob)
    return spark.read.parquet(store).select("article_id", "route")
