import zlib

import numpy as np

from sluice.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.fit(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    out = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert len(out) > 200 and (out.lang_pred == out.lang).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_scorer_is_the_network():
    draw = np.random.default_rng(0)
    net = langid.Network(["a", "b", "c"], [draw.normal(0, 1, (w, 257, 8)).astype(np.float32) for w in (2, 3, 4)],
                         draw.normal(0, 1, (24, 3)).astype(np.float32), np.zeros(3, np.float32))
    texts = [bytes(draw.integers(0, 256, n, dtype=np.uint8)) for n in (1, 5, 128, 129, 3000, 0)]
    got = langid.Scorer(net)(texts)
    for t, p in zip(texts[:-1], got, strict=False):
        total = np.zeros(3)
        for k in range(0, len(t), langid.WINDOW):
            part = t[k : k + langid.WINDOW]
            codes = list(part) + [256] * (langid.WINDOW - len(part))
            pooled = [max(sum(f[i][codes[j + i], n] for i in range(len(f))) for j in range(langid.WINDOW - len(f) + 1)) for f in net.filters for n in range(8)]
            z = np.exp(np.maximum(pooled, 0) @ net.dense + net.bias)
            total += len(part) * z / z.sum()
        assert np.abs(total / len(t) - p).max() < 1e-4
    assert got[-1].tolist() == [0, 0, 0]


def test_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == len(odd_rows)
    by = {r["doc_id"]: r for r in got}
    for i in (0, 1, 2, 4):  # null, empty, blank, no letter
        assert by[i]["lang_pred"] == "und"
    assert by[9]["lang_pred"] in ("en", "de", "fr")
    kept = langid.keep_recognised(docs)
    assert kept.columns == docs.columns and kept.count() == len(odd_rows) - 4


def test_nothing_to_learn(make_docs):
    docs = make_docs([(1, "some words"), (2, None)])
    assert langid.fit(docs) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(make_docs([]), langid.fit(make_docs([]))).count() == 0


def test_held_out_rows_are_not_learned(make_docs):
    rows = [(i, "zzz yyy", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "en", "s") for i in range(40)]
    assert langid.fit(make_docs(rows)).languages == ["en"]


def test_every_language_is_a_class(make_docs, monkeypatch):
    names = [f"l{k:02d}" for k in range(70)]
    docs = make_docs([(k * 12 + i, f"{name} words {name} of {name} here {name}", name, "s") for k, name in enumerate(names) for i in range(12)])
    assert langid.fit(docs, epochs=1).languages == names
    sizes = []
    monkeypatch.setattr(langid, "train", lambda parts, labels, **_: sizes.append((len(parts), sorted(set(labels)))))
    langid.fit(docs, total=140)
    langid.fit(docs, total=10)
    assert sizes == [(140, names), (70, names)]


def test_sample_is_the_smallest_hashes(spark):
    """Against all ids ranked plainly, with a third of the rows under one id and languages of any size."""
    from pyspark.sql import functions as F

    rows = [("en", i) for i in range(6000)] + [("en", 7)] * 4000 + [("de", 10_000 + i) for i in range(900)] + [("fr", 1), ("fr", 1), ("fr", 2)]
    named = spark.createDataFrame(rows, "_lang string, _id long").withColumn("_hash", F.xxhash64(F.lit(11), "_id")).repartition(7)
    for each, total, want in ((600, 38_400, 600), (600, 90, 30), (600, 2, 1)):
        got, few = langid.smallest(named, each, total)
        assert few == (total >= 3)
        found = {}
        for lang, i in got.collect():
            found.setdefault(lang, set()).add(i)
        plain = {}
        for lang, h, i in sorted({(r["_lang"], r["_hash"], r["_id"]) for r in named.collect()}):
            if len(plain.setdefault(lang, set())) < want:
                plain[lang].add(i)
        assert found == plain
