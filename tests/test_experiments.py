"""Experiment analytics: log parsing defects and the response surface (FIXTURES 3.12, 3.17)."""

from newsprism.operators import experiments as EX

LOG = """True, False, True, False, True, False, True, False
DecisionTreeClassifier with parameters {}:
\tval-accuracy: 0.7
\ttest-accuracy: 0.75
\tconfusion matrix: [[1 2]
\t                   [3 4]]
LogisticRegression with parameters {'C': 100}:
\tval-accuracy: 0.8
\ttest-accuracy: 0.85
\tconfusion matrix: [[5 6]
\t                   [7 8]]
False, True, False, False, False, False, False, True
DecisionTreeClassifier with parameters {}:
\tval-accuracy: 0.6
\ttest-accuracy: 0.65
\tconfusion matrix: [[9 10]
\t                   [11 12]]
LogisticRegression with parameters {'C': 0.01}:
\tval-accuracy: 0.5
\ttest-accuracy: 0.55
\tconfusion matrix: [[13 14]
\t                   [15 16]]"""


def parsed(spark, lines):
    return sorted(EX.parse_training_log(lines).collect(), key=lambda r: r.tp)


def check_log(rows):
    assert len(rows) == 4                                  # the last run is not lost
    assert [r.tags for r in rows] == [1, 1, 0, 0]          # flags of the header above each run
    assert [r.sentiment for r in rows] == [0, 0, 1, 1]
    assert rows[1].classifier == "LogisticRegression" and rows[1].params == "'C': 100"
    assert (rows[3].tp, rows[3].fn, rows[3].fp, rows[3].tn) == (13, 14, 15, 16)
    assert rows[3].test_accuracy == 0.55 and rows[3].val_accuracy == 0.5


def test_parse_training_log(spark):
    lines = spark.createDataFrame([("f", 0, i, v) for i, v in enumerate(LOG.split("\n"))], "file STRING, block LONG, nth LONG, value STRING")
    rows = parsed(spark, lines)
    check_log(rows)
    assert rows[0].ones_0 is None and len(rows[0]) == 47   # file and the 46 columns
    # any cut into blocks gives the same runs
    for size in (1, 2, 5, 9):
        blocks = spark.createDataFrame([("f", i // size * 100, i % size, v) for i, v in enumerate(LOG.split("\n"))],
                                       "file STRING, block LONG, nth LONG, value STRING")
        assert parsed(spark, blocks) == rows


def test_log_with_bins_read_in_many_splits(spark, tmp_path):
    bins = "\n".join(["\tProbabilities", "\t\tprobs\t1\t0\tacc", *[f"\t\t0.{b}\t{b + 1}\t{20 - b}\t0.{b}25" for b in range(9, -1, -1)]])
    text = LOG.replace("16]]", "16]]\n" + bins).replace("4]]", "4]]\n" + bins)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text(text)
    (tmp_path / "log" / "b.txt").write_text(LOG)
    keys = {"spark.sql.files.maxPartitionBytes": "120", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = EX.read_training_log(spark, str(tmp_path / "log"))
        assert lines.select("block").distinct().count() > 3
        rows = EX.parse_training_log(lines).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("a.txt", "b.txt"):
        mine = sorted((r for r in rows if r.file.endswith(name)), key=lambda r: r.tp)
        check_log(mine)
        with_bins = [r for r in mine if r.ones_0 is not None]
        assert len(with_bins) == (2 if name == "a.txt" else 0)
        for r in with_bins:
            assert [(r[f"ones_{b}"], r[f"zeros_{b}"], r[f"acc_{b}"]) for b in range(10)] == [(b + 1, 20 - b, (b * 100 + 25) / 1000) for b in range(10)]


def test_response_surface(spark):
    rows = [("c", a, t, 0, 0, 0, 0, 0, 0, 0) for a, t in [(0.8, 1), (0.6, 1), (0.5, 0), (0.5, 0)]]
    df = spark.createDataFrame(rows, "classifier STRING, test_accuracy DOUBLE, " + ", ".join(f"{f} INT" for f in EX.FLAGS))
    got = {r.feature: r.effect for r in EX.response_surface(df, divisor=4).collect()}
    assert abs(got["tags"] - 0.7) < 1e-9                   # (1.4 - 1.0) / 4 + 0.6


def test_interactions(spark):
    df = spark.createDataFrame([("c", 0.5, 1, 1, 0, 0, 1, 0, 0, 0)], "classifier STRING, test_accuracy DOUBLE, "
                               + ", ".join(f"{f} INT" for f in EX.FLAGS))
    r = EX.interaction_features(df).collect()[0]
    assert r["tagsxspell"] == 1 and r["tagsxtfidf"] == 1 and r["spellxgrammar"] == 0
    assert len([c for c in r.asDict() if "x" in c and c != "classifier"]) == 28
