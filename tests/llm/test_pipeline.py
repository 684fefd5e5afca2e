import pandas as pd

import __spark_entry__ as E
import corpus_pipeline as P

from .conftest import SF


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    columns, ids = docs.columns, [docs.count()]
    got = docs
    for name, stage in P.STAGES[:-1]:
        got = P.write_and_reload(stage(spark, got, ""), name)
        assert got.columns == columns and got.dtypes == docs.dtypes
        ids.append(got.count())
    assert ids == sorted(ids, reverse=True) and ids[1] < ids[0] and ids[3] < ids[2]
    text = {r.doc_id: r.text for r in got.collect()}
    packed = P.packing(spark, got, "").toPandas()
    assert set(packed.doc_id) == set(text)
    assert packed["size"].sum() == sum(len(t.split()) + 1 for t in text.values())


def test_registered_and_edges(spark, make_docs, as_table):
    assert E.queries()["pipeline"] is P.run and len(P.STAGES) == 5
    good = " ".join(f"water{i} stone{i % 7} and the river{i % 11}" for i in range(40))
    texts = [None, "", "x", good, good, good + " more", "12 34 " * 30] + [f"{good} tail{i}" for i in range(3)]
    at = as_table(make_docs(texts, language=["a"] * len(texts)))
    out = P.run(spark, at).toPandas()
    assert len(set(out.doc_id)) <= 3
    empty = as_table(make_docs(["a"]).limit(0))
    assert len(P.run(spark, empty).toPandas()) == 0
    assert isinstance(out, pd.DataFrame)
