"""Article-shaped views over the driver's tables, with their DuckDB twins.

``documents`` stands in for the scraped ``articles`` / ``ground_truth``
tables.  The mapping (all deterministic):

* article_id   = doc_id
* title        = first line of text
* authors/tags = comma lists drawn from small name tables by doc_id; some are
                 glued without separator (exercises ``fix_separators``), some
                 are empty
* publish_date = ISO text, 2017-02-20 + doc_id % 45 days + doc_id % 24 hours;
                 '' when doc_id % 11 = 0 (unknown date)
* url          = http://www.<source>.example.com/<doc_id>
* label        = 1 - labels.quality (1 = fake), null without a label row
* origin       = 'ground_truth' for labelled documents with doc_id % 10 = 3,
                 else 'articles'
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from .tables import table

# fixed values: the small name tables the view draws from (invented fixtures)
AUTHOR_FIRST = ["Ann Lee", "Bob Stone", "Cara Diaz", "Dan Moss", "Eve Park"]
AUTHOR_SECOND = ["Fay Wu", "Gus Hale", "Hal Ito"]
TAG_FIRST = ["Politics", "World", "Science", "Health", "Sports", "Media"]
TAG_SECOND = ["Economy", "Opinion", "Local", "Tech"]


def _pick(names, idx):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (idx + F.lit(1)).cast("int"))


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in article schema, before cleaning (authors/tags may be glued)."""
    return raw_articles_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def raw_articles_from(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The article mapping over any documents frame (batch or streaming);
    ``labels`` is joined as a static lookup (stream-static join)."""
    labels = labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("label"))
    d = F.col("doc_id")
    a1, a2 = _pick(AUTHOR_FIRST, d % 5), _pick(AUTHOR_SECOND, d % 3)
    t1, t2 = _pick(TAG_FIRST, d % 6), _pick(TAG_SECOND, d % 4)
    authors = (F.when(d % 7 == 0, F.lit(""))
               .when(d % 4 == 1, F.concat(a1, a2))
               .otherwise(F.concat_ws(",", a1, a2)))
    tags = (F.when(d % 9 == 0, F.lit(""))
            .when(d % 5 == 2, F.concat(t1, t2))
            .when(d % 5 == 3, F.concat_ws(",", t1, t2, t1))
            .otherwise(F.concat_ws(",", t1, t2)))
    ts = F.timestamp_add("HOUR", d % 24, F.date_add(F.lit("2017-02-20").cast("date"), (d % 45).cast("int")).cast("timestamp"))
    publish = F.when(d % 11 == 0, F.lit("")).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
    out = docs.select(
        d.alias("article_id"),
        F.substring_index(F.col("text"), "\n", 1).alias("title"),
        authors.alias("authors"),
        publish.alias("publish_date"),
        F.concat(F.lit("http://www."), F.col("source"), F.lit(".example.com/"), d.cast("string")).alias("url"),
        F.col("text"),
        tags.alias("tags"),
    )
    out = out.join(labels, out.article_id == labels.doc_id, "left").drop("doc_id")
    origin = F.when((F.col("article_id") % 10 == 3) & F.col("label").isNotNull(), "ground_truth").otherwise("articles")
    return out.withColumn("origin", origin)


def articles(spark: SparkSession, sf_dir: str, start_date: str | None = None,
             end_date: str | None = None, include_ground_truth: bool = False) -> DataFrame:
    """Cleaned, derived article rows (build_df + clean_data).

    Adds ``date`` (parsed publish date, null when unparseable), ``base_url``
    and ``word_count``; fixes separators in authors and tags.  Date bounds are
    inclusive and compared as timestamps, so a bare end date means its
    midnight; any bound drops undated rows.
    """
    df = raw_articles(spark, sf_dir)
    if not include_ground_truth:
        df = df.where(F.col("origin") == "articles")
    df = df.select(
        "article_id",
        *[T.fill_missing(c).alias(c) for c in ("title", "publish_date", "url", "text")],
        T.fix_separators(T.fill_missing("authors")).alias("authors"),
        T.fix_separators(T.fill_missing("tags")).alias("tags"),
        "label", "origin",
        F.try_to_timestamp(F.nullif(F.col("publish_date"), F.lit(""))).alias("date"),
    )
    if start_date:
        df = df.where(F.col("date") >= F.lit(start_date).cast("timestamp"))
    if end_date:
        df = df.where(F.col("date") <= F.lit(end_date).cast("timestamp"))
    return df.withColumn("base_url", U.url_base("url")).withColumn("word_count", T.word_count("text"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth rows: labelled documents with doc_id % 10 = 3."""
    return articles(spark, sf_dir, include_ground_truth=True).where(F.col("origin") == "ground_truth")


def labelled_articles(spark: SparkSession, sf_dir: str, start_date: str | None = None,
                       end_date: str | None = None) -> DataFrame:
    """Articles with a label (the frame the summaries and learners see)."""
    return articles(spark, sf_dir, start_date, end_date).where(F.col("label").isNotNull())


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled articles followed by ground truth (the feature-fitting set, F10)."""
    return articles(spark, sf_dir, include_ground_truth=True).where(F.col("label").isNotNull())


# ---------------------------------------------------------------- SQL twins

def _sql_pick(names, idx):
    return "[" + ", ".join("'" + n + "'" for n in names) + f"][({idx}) + 1]"


RAW_ARTICLES_SQL = f"""
raw_articles AS (
  SELECT d.doc_id AS article_id,
         split_part(d.text, chr(10), 1) AS title,
         CASE WHEN d.doc_id % 7 = 0 THEN ''
              WHEN d.doc_id % 4 = 1 THEN {_sql_pick(AUTHOR_FIRST, 'd.doc_id % 5')} || {_sql_pick(AUTHOR_SECOND, 'd.doc_id % 3')}
              ELSE {_sql_pick(AUTHOR_FIRST, 'd.doc_id % 5')} || ',' || {_sql_pick(AUTHOR_SECOND, 'd.doc_id % 3')} END AS authors,
         CASE WHEN d.doc_id % 11 = 0 THEN ''
              ELSE strftime(TIMESTAMP '2017-02-20' + to_days(CAST(d.doc_id % 45 AS INTEGER)) + to_hours(CAST(d.doc_id % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') END AS publish_date,
         'http://www.' || d.source || '.example.com/' || CAST(d.doc_id AS VARCHAR) AS url,
         d.text AS text,
         CASE WHEN d.doc_id % 9 = 0 THEN ''
              WHEN d.doc_id % 5 = 2 THEN {_sql_pick(TAG_FIRST, 'd.doc_id % 6')} || {_sql_pick(TAG_SECOND, 'd.doc_id % 4')}
              WHEN d.doc_id % 5 = 3 THEN {_sql_pick(TAG_FIRST, 'd.doc_id % 6')} || ',' || {_sql_pick(TAG_SECOND, 'd.doc_id % 4')} || ',' || {_sql_pick(TAG_FIRST, 'd.doc_id % 6')}
              ELSE {_sql_pick(TAG_FIRST, 'd.doc_id % 6')} || ',' || {_sql_pick(TAG_SECOND, 'd.doc_id % 4')} END AS tags,
         1 - l.quality AS label,
         CASE WHEN d.doc_id % 10 = 3 AND l.quality IS NOT NULL THEN 'ground_truth' ELSE 'articles' END AS origin
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

NETLOC_SQL = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def netloc_sql(u: str) -> str:
    return NETLOC_SQL.format(u=u)


def base_url_sql(u: str) -> str:
    host = f"regexp_replace({netloc_sql(u)}, '^(www[.])+', '')"
    host = f"regexp_replace({host}, '([.][a-z]{{2,3}})+$', '')"
    return f"regexp_replace({host}, '^[a-z]+[.]', '')"


def word_count_sql(t: str) -> str:
    return f"len(regexp_extract_all(coalesce({t}, ''), '\\S+'))"


def fix_sep_sql(c: str) -> str:
    return f"regexp_replace({c}, '([a-z])([A-Z])', '\\1,\\2', 'g')"


ALL_ARTICLES_SQL = RAW_ARTICLES_SQL + f""",
all_articles AS (
  SELECT article_id, coalesce(title, '') AS title, coalesce(publish_date, '') AS publish_date,
         coalesce(url, '') AS url, coalesce(text, '') AS text,
         {fix_sep_sql("coalesce(authors, '')")} AS authors,
         {fix_sep_sql("coalesce(tags, '')")} AS tags,
         label, origin,
         try_cast(nullif(publish_date, '') AS TIMESTAMP) AS date,
         {base_url_sql('url')} AS base_url,
         {word_count_sql('text')} AS word_count
  FROM raw_articles
),
articles AS (SELECT * FROM all_articles WHERE origin = 'articles'),
ground_truth AS (SELECT * FROM all_articles WHERE origin = 'ground_truth'),
labelled_articles AS (SELECT * FROM articles WHERE label IS NOT NULL),
labelled AS (SELECT * FROM all_articles WHERE label IS NOT NULL)"""


def with_articles(body: str) -> str:
    """Prefix a query with the article CTEs."""
    return "WITH " + ALL_ARTICLES_SQL.strip() + "\n" + body
