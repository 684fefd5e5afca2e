import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from newsprism.llm import bpe_rounds

from .conftest import SF


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe_rounds.vocabulary_path())


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_query_equals_library(spark, library):
    docs = pd.read_parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").set_index("doc_id")
    rows = bpe_rounds.op8_bpe_rounds(spark, SF.replace("0.001", "0.01")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, docs.text[r.doc_id])


def test_edges_and_round_trip(spark, make_docs, as_table, library):
    rng = random.Random(5)
    some = "abc'sDT'll  \t\nééΣİ  ٠½\U0001f600ﬁ<|>_-9Z中文กำ"
    texts = [None, "", " \n ", "a", "aaaaaaaaaaaa aaaa", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endof text|>",
             "I'd we'll they've 's't 123 4.5!!!", "ΟΔΟΣ", "ab" * 3000, "q" * 5001,
             "".join(rng.choice("abcdefgh") for _ in range(4000))]
    texts += ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    df = make_docs(texts, n_tokens=["x"] * len(texts))
    rows = bpe_rounds.op8_bpe_rounds(spark, as_table(df)).collect()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(library, texts[r.doc_id]), repr(texts[r.doc_id])[:80]
    ids = bpe_rounds.encode(df)
    back = {r.doc_id: r.text for r in bpe_rounds.decode(ids).collect()}
    for r in ids.collect():
        w = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == w and back[r.doc_id] == library.decode(w, skip_special_tokens=False)
    assert bpe_rounds.digests(df.limit(0)).count() == 0


def test_queue_equals_rounds(monkeypatch):
    bpe = bpe_rounds.WordBpe(bpe_rounds.vocabulary_path())
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcdehiorstn") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    rounds = bpe.merge(words)
    monkeypatch.setattr(bpe_rounds, "HEAP_SYMBOLS", 0)
    assert all(np.array_equal(a, b) for a, b in zip(rounds, bpe.merge(words)))
