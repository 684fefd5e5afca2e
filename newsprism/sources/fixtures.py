"""Invented fixture tables for inputs the studied project reads from files it
does not ship (emotion lexicon, grammar rules).  They are small, fixed and
used both by the Spark side and, as VALUES, by the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: invented emotion lexicon (word, affect).  Real affect words,
# plus a few frequent fragments of the synthetic corpus so that checks see
# non-zero scores; 'ther' is both positive and negative on purpose.
EMOTION_LEXICON = [
    ("good", "positive"), ("good", "joy"), ("good", "trust"), ("bad", "negative"),
    ("bad", "sadness"), ("happy", "joy"), ("happy", "positive"), ("angry", "anger"),
    ("angry", "negative"), ("afraid", "fear"), ("crying", "sadness"), ("surprise", "surprise"),
    ("trust", "trust"), ("disgust", "disgust"), ("hope", "anticipation"), ("hope", "positive"),
    ("tion", "trust"), ("ing", "anticipation"), ("ble", "negative"), ("ble", "disgust"),
    ("ther", "positive"), ("ther", "negative"), ("thre", "fear"), ("thing", "joy"),
    ("ment", "sadness"), ("ering", "anger"), ("sch", "disgust"), ("eau", "surprise"),
]

# fixed values: invented grammar rules (rule_id, regex); patterns use only
# syntax on which Java regex and RE2 agree.
GRAMMAR_RULES = [
    ("R01_repeated_space", " {2,}"),
    ("R02_space_before_punct", " [,.;:!?]"),
    ("R03_lowercase_sentence_start", "[.!?] [a-z]"),
    ("R04_repeated_punct", "[!?.,]{2,}"),
    ("R05_no_space_after_comma", ",[A-Za-z]"),
    ("R06_a_before_vowel", "(^|[^A-Za-z])a [aeiouAEIOU]"),
    ("R07_an_before_consonant", "(^|[^A-Za-z])an [b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]"),
    ("R08_repeated_letters", "([a-z])[a-z]*[.]{3}"),
]


def emotion_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EMOTION_LEXICON, "word STRING, affect STRING")


def grammar_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRAMMAR_RULES, "rule_id STRING, regex STRING")


def values_sql(rows, names) -> str:
    """Rows as a DuckDB VALUES table expression."""
    def lit(v):
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(names)})"
