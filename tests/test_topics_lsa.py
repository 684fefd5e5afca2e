"""Property checks for the rows-only topic and LSA operators (SURVEY 5: NMF
objective falls and stays non-negative; U'U = I; coordinates consistent)."""

import numpy as np
from pyspark.sql import functions as F

from newsprism.operators import lsa as LS
from newsprism.operators import topics as TP


def planted_matrix(spark, n_docs=24):
    rows = []
    for d in range(n_docs):
        group = d % 2
        for t in range(6):
            w = 1.0 + ((d + t) % 3) if (t < 3) == (group == 0) else 0.0
            if w:
                rows.append((d, f"t{t}", w))
    return spark.createDataFrame(rows, "doc_id LONG, term STRING, weight DOUBLE")


def test_nmf_error_falls_and_factors_nonnegative(spark):
    x = planted_matrix(spark)
    terms = [f"t{t}" for t in range(6)]
    h, w, hist = TP.nmf_topics(x, terms, k=2, alpha=0.0, l1_ratio=0.5, max_iter=30, tol=0.0, seed=1)
    errs = [e for _, e in hist]
    assert all(b <= a + 1e-9 for a, b in zip(errs, errs[1:]))
    assert errs[-1] < errs[0]
    assert (h >= 0).all()
    wmin = w.select(F.array_min("w").alias("m")).agg(F.min("m")).collect()[0][0]
    assert wmin >= 0 and w.count() == 24


def multiplicative_updates(X, h, l1, l2, passes):
    """Plain numpy NMF by multiplicative updates, as a bound for the error."""
    w = np.full((len(X), len(h)), float(np.sqrt(X.mean() / len(h))))
    for _ in range(passes):
        w = w * (X @ h.T) / np.maximum(w @ h @ h.T + l1 + l2 * w, 1e-12)
        h = h * (w.T @ X) / np.maximum(w.T @ w @ h + l1 + l2 * h, 1e-12)
    return 0.5 * ((X - w @ h) ** 2).sum() + l1 * (w.sum() + h.sum()) + 0.5 * l2 * ((w ** 2).sum() + (h ** 2).sum())


def test_nmf_objective_is_no_worse_than_multiplicative_updates(spark):
    rng = np.random.default_rng(9)
    X = (rng.random((40, 3)) ** 3) @ (rng.random((3, 15)) ** 3) + 0.02 * rng.random((40, 15))
    X[X < 0.05] = 0
    rows = [(i + 7, f"t{j}", float(X[i, j])) for i in range(40) for j in range(15) if X[i, j]]
    terms = [f"t{j}" for j in range(15)]
    h, w, _ = TP.nmf_topics(spark.createDataFrame(rows, "doc_id LONG, term STRING, weight DOUBLE"), terms, k=3, alpha=0.02, tol=1e-7)
    W = np.zeros((40, 3))
    for r in w.collect():
        W[r.doc_id - 7] = r.w
    own = 0.5 * ((X - W @ h) ** 2).sum() + 0.01 * (W.sum() + h.sum()) + 0.005 * ((W ** 2).sum() + (h ** 2).sum())
    others = [multiplicative_updates(X, np.abs(np.random.default_rng(s).standard_normal((3, 15))) * 0.3, 0.01, 0.01, 500) for s in range(4)]
    assert own < min(others) * 1.05


def long_of(spark, dense):
    return spark.createDataFrame([(i, f"t{j:03d}", float(v)) for i, r in enumerate(dense) for j, v in enumerate(r) if v],
                                 "doc_id LONG, term STRING, weight DOUBLE")


def check_svd(spark, dense, k):
    u, s, words = LS.svd(long_of(spark, dense), k=k)
    U = np.zeros((len(dense), len(s)))
    for r in u.collect():
        U[r.doc_id] = r.u
    V = np.zeros((dense.shape[1], len(s)))
    for r in words.collect():
        V[int(r.term[1:])] = r.v
    want = np.linalg.svd(dense, compute_uv=False)[:k]
    want = want[want > 1e-6]
    assert len(s) == len(want) and np.abs(s - want).max() < 1e-6 * want[0]
    assert np.allclose(U.T @ U, np.eye(len(s)), atol=1e-7) and np.allclose(V, dense.T @ U, atol=1e-8)
    assert np.allclose((V ** 2).sum(axis=0), s ** 2, rtol=1e-6)
    assert (V[np.abs(V).argmax(axis=0), range(len(s))] > 0).all()
    coords = {r.id: (r.c0, r.c1, r.c2, r.magsq) for r in LS.coordinates(u, s, words).where("kind = 'doc'").collect()}
    for i in range(len(dense)):
        want_c = np.pad(U[i] * s, (0, max(0, 3 - len(s))))
        if dense[i].any():
            assert np.allclose(coords[str(i)], [*want_c[:3], (want_c ** 2).sum()], atol=1e-8)


def test_svd_equals_numpy_on_a_sparse_matrix_of_many_ranks(spark):
    rng = np.random.default_rng(0)
    dense = rng.random((70, 90)) * (rng.random((70, 90)) < 0.08)
    dense[:, :30] = 0
    for j in range(30):  # terms of one document
        dense[rng.integers(70), j] = rng.random()
    dense[11] = 0
    check_svd(spark, dense, 5)


def test_svd_of_low_rank(spark):
    rng = np.random.default_rng(1)
    check_svd(spark, rng.random((20, 2)) @ rng.random((2, 8)), 3)


def test_coordinates_have_the_joint_map_and_the_mean_norms(spark):
    """Words are divided by sqrt(mean squared norm) in the joint map, documents are not; both means are given."""
    words = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "term STRING, v ARRAY<DOUBLE>")
    u = spark.createDataFrame([(7, [0.5, -0.5]), (None, [0.0, 0.25])], "doc_id LONG, u ARRAY<DOUBLE>")
    rows = LS.coordinates(u, np.array([4.0, 2.0]), words).collect()
    assert {(r.mean_norm, r.mean_sq) for r in rows} == {(7 / 3, 9.0)}
    got = {(r.kind, r.id): (r.c0, r.c1, r.c2, r.magsq, r.m0, r.m1, r.m2) for r in rows}
    assert got == {("word", "a"): (3, 4, 0, 25, 1, 4 / 3, 0), ("word", "b"): (0, 1, 0, 1, 0, 1 / 3, 0), ("word", "c"): (-1, 0, 0, 1, -1 / 3, 0, 0),
                   ("doc", "7"): (2, -1, 0, 5, 2, -1, 0), ("doc", None): (0, 0.5, 0, 0.25, 0, 0.5, 0)}
    joint = LS.joint_map(LS.coordinates(u, np.array([4.0, 2.0]), words))
    assert joint.columns == ["kind", "id", "c0", "c1", "c2"] and {r.c0 for r in joint.where("kind = 'word'").collect()} == {1, 0, -1 / 3}
    none = LS.coordinates(u, np.zeros(0), words.limit(0)).collect()
    assert [(r.kind, r.c0, r.m0, r.mean_norm, r.mean_sq) for r in none] == [("doc", 0, 0, None, None)] * 2


def test_kmeans_best_and_nearest(spark):
    pts = [(f"d{i}", float(i % 2) * 10 + 0.01 * i, 0.0, 0.0) for i in range(20)]
    df = spark.createDataFrame(pts, "id STRING, c0 DOUBLE, c1 DOUBLE, c2 DOUBLE").withColumn("kind", F.lit("doc"))
    model, assigned = LS.kmeans_best(df, k=2, restarts=3)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r.cluster, set()).add(int(r.id[1:]) % 2)
    assert sorted(len(g) for g in groups.values()) == [1, 1]
    near = LS.nearest_to_centroids(df, [list(c) for c in model.clusterCenters()], 3).collect()
    assert len(near) == 6 and all(r.rank <= 3 for r in near)


def test_kmeans_is_lloyds_fixed_point_and_no_worse_than_plain_restarts(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.4, (25, 3)) for c in ([0, 0, 0], [3, 0, 0], [0, 3, 1], [3, 3, 3])])
    df = spark.createDataFrame([("doc", f"d{i}", *map(float, r)) for i, r in enumerate(x)], "kind STRING, id STRING, c0 DOUBLE, c1 DOUBLE, c2 DOUBLE")
    found, assigned = LS.kmeans_best(df.repartition(3), k=4, restarts=8)
    near = {r.id: r.cluster for r in assigned.collect()}
    d = ((x[:, None] - found.centers[None]) ** 2).sum(axis=2)
    assert [near[f"d{i}"] for i in range(100)] == d.argmin(axis=1).tolist() and abs(d.min(axis=1).sum() - found.cost) < 1e-6
    for c in range(4):
        assert np.allclose(found.centers[c], x[d.argmin(axis=1) == c].mean(axis=0), atol=1e-3)
    best = np.inf
    for _ in range(8):
        m = x[rng.choice(100, 4, replace=False)]
        for _ in range(50):
            a = ((x[:, None] - m[None]) ** 2).sum(axis=2).argmin(axis=1)
            m = np.stack([x[a == c].mean(axis=0) if (a == c).any() else m[c] for c in range(4)])
        best = min(best, ((x[:, None] - m[None]) ** 2).sum(axis=2).min(axis=1).sum())
    assert found.cost <= best * (1 + 1e-6)
    few, _ = LS.kmeans_best(df.limit(2).select("kind", "id", F.lit(1.0).alias("c0"), F.lit(0.0).alias("c1"), F.lit(0.0).alias("c2")), k=3, restarts=2)
    assert few.cost == 0


def test_lda_topics_shape(spark):
    docs = spark.createDataFrame([(i, " ".join(["apple banana"] * 3 if i % 2 else ["car train"] * 3)) for i in range(30)],
                                 "doc_id LONG, text STRING")
    vocab = TP.limited_vocabulary(docs, max_features=10)
    terms = [r.term for r in vocab.orderBy("term_rank").collect()]
    assert sorted(terms) == ["apple", "banana", "car", "train"]
    model, _ = TP.lda_topics(docs, terms, k=2, max_iter=5)
    top = TP.topic_top_terms(model, terms, 2).collect()
    assert len(top) == 4 and {r.topic for r in top} == {0, 1}


def test_vocabulary_counts_ids_over_batches_without_a_table_of_pairs(spark):
    """Texts of one id in several rows and batches, null ids and empty texts; what is counted never leaves as (id, term)."""
    rows = [(1, "apple pear apple"), (1, "apple plum"), (1, None), (1, "the pear"), (2, "plum the"), (None, "apple"), (None, "apple fig"),
            (None, ""), (3, "fig 12 a"), (4, ""), (5, "plum"), (6, "Apple"), (7, "kiwi"), (8, "pear")]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "3", before):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = TP.limited_vocabulary(docs)
            assert [tuple(r) for r in found.orderBy("term_rank").collect()] == [
                ("apple", 6, 3, 1), ("pear", 3, 2, 2), ("plum", 3, 3, 3), ("fig", 2, 2, 4)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "keys=[doc_id" not in found._jdf.queryExecution().toString()


def test_lda_passes_have_a_task_for_so_many_texts_however_the_file_is_cut(spark, monkeypatch):
    monkeypatch.setattr(TP, "PART_TEXTS", 12)
    docs = spark.createDataFrame([(i % 30 or None, f"apple pear {i}" if i % 2 else "car train") for i in range(80)],
                                 "doc_id LONG, text STRING").coalesce(1)
    model, vec = TP.lda_topics(docs, ["apple", "pear", "car", "train"], k=2, max_iter=1)
    assert vec.count() == 80 and spark.conf.get(TP.LEAST_SCANS, None) is None
    with TP.files_apart(spark, 7):
        assert vec.select("features").rdd.getNumPartitions() == 7
    dealt = TP.dealt_evenly(docs, "doc_id", "text", 7)
    assert sorted(map(str, dealt.collect())) == sorted(map(str, docs.collect()))
    again = TP.dealt_evenly(docs.repartition(3), "doc_id", "text", 7)
    assert [list(p) for p in dealt.rdd.glom().collect()] == [list(p) for p in again.rdd.glom().collect()]
    assert model.topicsMatrix().toArray().shape == (4, 2)


def test_lsa_passes_exchange_numbers_a_document_not_non_zeros(spark, monkeypatch):
    """A pass over the term blocks exchanges partial sums by pieces of documents; a term is whole in one block."""
    dense = np.random.default_rng(5).random((60, 40))
    long = long_of(spark, dense).withColumn("weight", F.col("weight").cast("double"))
    monkeypatch.setattr(LS, "TERM_BLOCK", 300)
    monkeypatch.setattr(LS.BL, "PIECE", 7)
    ids, n = LS._numbered(long.select("doc_id").distinct(), "doc_id")
    dealt = LS.TermBlocks(long, ids, n, "doc_id")
    terms = [t for r in dealt.blocks.select("terms").collect() for t in r.terms]
    assert len(terms) == len(set(terms)) == 40 and dealt.blocks.count() > 4
    place = {r.row: r.doc_id for r in ids.collect()}
    a = dense[[place[i] for i in range(n)]]
    c = np.random.default_rng(6).random((n, 3))
    got = {r.row: r.y for r in dealt.image(c).collect()}
    assert np.allclose([got[i] for i in range(n)], a @ (a.T @ c))
    plan = dealt.image(c)._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_lsa_passes_keep_only_what_later_passes_read(spark, monkeypatch):
    """Tables of a pass are deleted with it, those the weights are read from when they have been; results outlive them."""
    import os
    from newsprism import session as S
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17} w{j}x{i % 5}" for j in range(12))) for i in range(40)], "doc_id LONG, text STRING")
    seen, least = [], []
    keep, image = S.Passing.keep, LS.TermBlocks.image
    monkeypatch.setattr(S.Passing, "keep", lambda self, df: seen.append(self) or keep(self, df))
    with S.written_tables() as used:
        weights = LS_weights(docs)
    monkeypatch.setattr(LS.TermBlocks, "image", lambda self, c: least.append((len(seen[-1].paths), [os.path.exists(p.removeprefix("file:")) for p in used])) or image(self, c))
    monkeypatch.setattr(LS, "PORTION", 100)
    before = spark.conf.get(S.SHUFFLES)
    u, s, words = LS.svd(weights, 3, used=used)
    assert used and len(least) > 1 and set(map(str, least)) == {str((1, [False] * len(used)))}  # the basis alone
    assert not seen[-1].paths and spark.conf.get(S.SHUFFLES) == before
    assert u.count() == 40 and words.count() > 17 and len(s) == 3
    terms = [r.term for r in words.select("term").collect()]
    assert len(terms) == len(set(terms))  # whole terms, though dealt in portions
    monkeypatch.setattr(LS, "PORTION", 1 << 23)
    assert np.allclose(LS.svd(LS_weights(docs), 3)[1], s, rtol=1e-9)


def LS_weights(docs):
    from newsprism.operators import features as FT
    return FT.tfidf_weights(docs, "doc_id", "text").select("doc_id", "term", "weight")
