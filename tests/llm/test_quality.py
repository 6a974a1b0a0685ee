import numpy as np
import pandas as pd

from sluice.llm import quality
from tests.llm import brute


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts_and_every_row(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = quality.quality_rules(docs, labels(spark, [(5, 1, 0), (None, 1, 0), (6, 0, 0), (7, None, 1)])).toPandas()
    assert len(got) == len(odd_rows)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    have = sorted(map(tuple, got[["doc_id", *columns]].fillna({"doc_id": -1}).astype(int).to_numpy().tolist()))
    want = sorted((-1 if r[0] is None else r[0], *brute.base_counts(r[1])) for r in odd_rows)
    assert have == want
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == failed).all() and not got[got.base_failed].kept.any()


def test_lines_and_windows():
    m = quality.measure([b"a b\n\n a b\na b\n c", "é ñ x é ñ x q".encode(), None], np.zeros(quality.BUCKETS, np.float32))
    assert m["n_dup_lines"].tolist() == [1, 0, 0]
    assert m["word_chars"].tolist() == [7, 7, 0]
    assert m["n_repeat_words"].tolist() == [7 - 1, 6, 0]


def test_ratio_is_the_mean_over_grams(spark, make_docs):
    docs = make_docs([(1, "a b a"), (2, "c d"), (3, None)])
    raw, target = quality.gram_counts(docs.selectExpr("text", "doc_id = 1 as trusted"))
    assert raw.sum() == (3 + 2) + (2 + 1) and target.sum() == 5
    ratios = quality.log_ratios(raw, target)
    got = {r["doc_id"]: r["llr"] for r in quality.score(docs, ratios).collect()}
    p, q, f = target / 5, raw / 8, quality.SMOOTHING / quality.BUCKETS
    _, bucket, owner = quality._grams(quality.Words([b"a b a", b"c d"]))
    for i, doc in enumerate((1, 2)):
        mine = bucket[owner == i]
        assert abs(got[doc] - np.log((p[mine] + f) / (q[mine] + f)).mean()) < 1e-5
    assert got[1] > 0 > got[2] and got[3] == 0


def test_junk_is_told_from_good_text(spark):
    path = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality.quality_rules(docs, lab).toPandas().merge(lab.toPandas(), on="doc_id")
    good, bad = got[(got.quality == 1) & ~got.base_failed], got[got.quality == 0]
    assert good.kept.mean() >= 0.99 and bad.kept.mean() <= 0.05


def test_threshold():
    assert quality.choose_threshold(np.array([]), np.array([1.0])) == float("-inf")
    t = quality.choose_threshold(np.array([0.1, 0.2, 0.3]), np.array([-1.0, -0.5]))
    assert -0.5 < t <= 0.1


def test_no_rows_no_labels(spark, make_docs):
    empty = make_docs([])
    assert quality.quality_rules(empty, labels(spark, [])).count() == 0
    one = quality.quality_rules(make_docs([(1, " ".join(map(str, range(60))))]), labels(spark, [])).toPandas()
    assert one.kept.tolist() == [True]
    assert isinstance(one, pd.DataFrame)


def test_every_label_counts(spark, make_docs):
    """No cap on the labelled texts: the target holds all trusted ones of its half, the threshold all others."""
    import inspect

    assert not {"trusted", "calibration"} & set(inspect.signature(quality.quality_rules).parameters)
    draw = np.random.default_rng(3)
    for n_good, n_bad in ((1, 1), (400, 300), (400, 0), (0, 5), (900, 700)):
        good, bad = np.round(draw.normal(0.2, 0.2, n_good), 2), np.round(draw.normal(-0.1, 0.2, n_bad), 2)
        rows = [(float(x), 1, 0) for x in good] + [(float(x), 0, 1) for x in bad]
        scores = spark.createDataFrame(rows, "llr double, good int, bad int")
        for passed in (0.995, 0.9):
            assert quality.threshold_of(scores, passed, num_partitions=5) == quality.choose_threshold(good, bad, passed)
