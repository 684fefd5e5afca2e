import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make_docs(spark):
    """(texts) or (dict of columns) -> documents table; further columns are added as given."""
    def make(texts, langs=None, sources=None, ids=None, **extra):
        n = len(texts)
        rows = [(ids[i] if ids else i, texts[i], langs[i] if langs else "en", sources[i] if sources else "s",
                 len(texts[i] or "")) + tuple(v[i] for v in extra.values()) for i in range(n)]
        schema = T.StructType([*DOCS.fields, *[T.StructField(k, T.StringType()) for k in extra]])
        return spark.createDataFrame(rows, schema)
    return make


@pytest.fixture(scope="session")
def as_table(tmp_path_factory):
    """Write a DataFrame as <dir>/<name>.parquet and return the directory."""
    def put(df, name="documents", at=None):
        at = at or str(tmp_path_factory.mktemp("sf"))
        df.write.parquet(f"{at}/{name}.parquet")
        return at
    return put
