"""Property tests on generated text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsprism.functions import text as T
from newsprism.functions.lexicons import stop_words


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=60), min_size=20, max_size=20))
def test_normalized_tokens_shape(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    toks = [t for r in df.select(T.normalize_tokens(F.col("t"))).collect() for t in r[0]]
    sw = set(stop_words("english"))
    for t in toks:
        # ASCII without white space, punctuation and capitals; control characters such as DEL are neither
        assert re.fullmatch(r"[a-z0-9\x00-\x1f\x7f]+", t) and not re.search(r"\s", t), t
        assert not t.isdigit()
        assert t not in sw

