"""The learners share one packing of the training rows, and ship no model object with a plan."""


def test_all_learners_pack_the_rows_once(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors
    from newsprism.operators import blocks as BL
    from newsprism.operators import models as MD
    packs, pack = [], BL.pack
    monkeypatch.setattr(BL, "pack", lambda *a: packs.append(1) or pack(*a))
    rows = spark.createDataFrame([(i, i % 2, Vectors.sparse(5, {i % 2: 1.0, 2 + i % 3: 0.5})) for i in range(90)], ["article_id", "label", "features"])
    specs = [MD.spec_by_name("Decision Tree", max_depth=3), MD.spec_by_name("Random Forest", max_depth=3, trees=3), MD.spec_by_name("Multinomial NB")]
    reports, models = MD.compare_learners(rows.where("article_id < 60"), rows.where("article_id >= 60"), specs)
    assert len(packs) == 1 and len(reports) == 4 and reports[0]["test_accuracy"] == reports[-1]["test_accuracy"] == 1.0
    assert not any(hasattr(m, "_java_obj") for m in models)
