import numpy as np
import pandas as pd

from newsprism.llm import byte_gru
from newsprism.llm.byte_gru import ByteGru

from .conftest import SF


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = ByteGru(["a", "b", "c"], hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y, w = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5), np.ones(5)
    _, grad = net.gradients(x, y, w)
    for k in ("Ef", "Ub", "Vf", "o", "Uf", "Eb"):
        at = (int(x[3, 2]), 5) if k[0] == "E" else tuple(0 for _ in net.w[k].shape)
        old = net.w[k][at]
        net.w[k][at] = old + 0.01
        up, _ = net.gradients(x, y, w)
        net.w[k][at] = old - 0.01
        down, _ = net.gradients(x, y, w)
        net.w[k][at] = old
        assert abs((up - down) / 0.02 - grad[k][at]) < 2e-3, k


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = pd.DataFrame([r.asDict() for r in byte_gru.op6_byte_gru(spark, sf).collect()]).set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    out = got[got.held_out]
    assert 0.15 < len(out) / len(got) < 0.35
    assert (out.lang_pred == docs.lang[out.index]).mean() > 0.97
    kept = byte_gru.in_one_language(spark.read.parquet(f"{sf}/documents.parquet")).count()
    assert kept > 0.97 * len(docs)


def test_edges(spark, make_docs, as_table):
    en, de = "the river was over there and the house ", "der fluss und das haus ist nicht schön "
    texts = [en * 5, de * 5, None, "", "123 !!", en, de, en * 2000, "ß", None]
    df = make_docs(texts, langs=["en", "de", "en", None, "en", None, "de", "en", None, None],
                   language=["x"] * 10, has_letter=["y"] * 10)
    got = {r.doc_id: r for r in byte_gru.op6_byte_gru(spark, as_table(df)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (2, 3, 4, 9))
    assert got[7].lang_pred == "en" and got[6].lang_pred == "de" and got[8].lang_pred in ("en", "de")
    kept = byte_gru.in_one_language(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 5, 6, 7}
    assert byte_gru.in_one_language(df.limit(0)).count() == 0
    one = byte_gru.train(make_docs([en], langs=["en"]))
    assert set(one.label_positions("the")) == {"en"} and ByteGru([]).label_positions("ab") == ["und"] * 2


def test_every_position_is_labelled_whatever_the_segments():
    net = ByteGru(["a", "b"])
    text = "é" * 400 + "xyz" * 90
    assert len(net.label_positions(text)) == len(text.encode())


def test_segments_against_one_pass_over_whole_texts(monkeypatch):
    monkeypatch.setattr(byte_gru, "SEGMENT", 100)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs = docs[docs.text.str.len() > 0]
    languages = sorted(docs.lang.dropna().unique())
    net = ByteGru(languages)
    net.fit([t[:400].encode() for t in docs.text], np.array([languages.index(x) for x in docs.lang]), steps=60)
    raws = [t.encode() for t in docs.text[:60]] + [b"", b"x"]
    p, votes = net.pooled(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]))
    same = total = 0
    for k, raw in enumerate(raws):
        if not raw:
            assert not p[k].any()
            continue
        x = np.frombuffer(raw, np.uint8)[:, None]
        q = net.logits(net.states(x, "f"), net.states(x[::-1], "b")[::-1])[:, 0]
        q = np.exp(q - q.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        labels = np.array([languages.index(x) for x in net.label_positions(raw.decode())])
        same += int((labels == q.argmax(axis=1)).sum())
        total += len(raw)
        assert abs(p[k] - q.mean(axis=0)).max() < 0.05 and p[k].argmax() == q.mean(axis=0).argmax()
        assert abs(votes[k] - np.bincount(q.argmax(axis=1), minlength=len(languages)) / len(raw)).max() < 0.05
        if len(raw) <= byte_gru.CONTEXT:
            assert abs(p[k] - q.mean(axis=0)).max() < 1e-4
    assert same / total > 0.99
