"""Hand-traced cases for URL and text scalars (FIXTURES 3.1-3.7)."""

from pyspark.sql import functions as F

from newsprism.functions import text as T
from newsprism.functions import urls as U


def one_col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_netloc(spark):
    assert one_col(spark, ["http://u@h.com:80/c?x", "a b", "//h.org/x"], U.url_netloc) == ["u@h.com:80", "", "h.org"]


def test_url_base(spark):
    urls = ["http://www.bbc.com/news", "http://money.cnn.com/x", "http://cnn.com.de/", "http://abcnews.go.com",
            "http://dailymail.co.uk/ushome/", "http://news.google.com", "http://www.www.x.org",
            "https://www.4wrd-consulting.de/"]
    assert one_col(spark, urls, U.url_base) == ["bbc", "money", "cnn", "abcnews", "dailymail", "google", "x",
                                                 "4wrd-consulting"]


def test_domain_ending(spark):
    urls = ["http://www.cnn.com/a", "http://cnn.com/a", "http://localhost/a"]
    assert one_col(spark, urls, U.domain_ending) == ["cnn.com", "com", ""]


def test_word_count(spark):
    assert one_col(spark, ["  a b  c ", ""], T.word_count) == [3, 0]


def test_fix_separators(spark):
    assert one_col(spark, ["John SmithJane DoeMcDonald"], T.fix_separators) == ["John Smith,Jane Doe,Mc,Donald"]


def test_expand_contractions_reference_mode(spark):
    got = one_col(spark, ["can't", "I'd", "ain't", "'cause", "he'd've", "Won't"], T.expand_contractions)
    assert got == ["cannot", "I would", "as not", "'ecause", "he would've", "Will not"]


def test_expand_contractions_clean_mode(spark):
    got = one_col(spark, ["he'd've", "ain't", "I'd"], lambda c: T.expand_contractions(c, mode="clean"))
    assert got == ["he would have", "is not", "I would"]


def test_normalize_text(spark):
    got = one_col(spark, ["Quiet. quiet. rivers. flow. south. don't turn it any more. Old Mill! 42"], T.normalize_text)
    assert got == ["quiet quiet rivers flow south turn old mill"]


def test_preview(spark):
    assert one_col(spark, ["a\nb" + "x" * 200], T.preview) == ["a b" + "x" * 147]
