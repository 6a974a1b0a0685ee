import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from sluice.llm import packing
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    language, near, passages, mixed, packed = out
    assert all(d.columns == columns for d in out[:-1])
    # languages: only texts without a recognised language go; the plain test knows those without letters
    kept = {r["doc_id"] for r in language.collect()}
    assert kept <= {i for i, t in rows.items() if any(c.isalpha() for c in t)} and len(kept) > 0.97 * len(rows)
    # one document of each group of near duplicates
    least = {i for i, n, c in brute.components([(i, rows[i]) for i in sorted(kept)]) if i == c}
    assert {r["doc_id"] for r in near.collect()} == least
    # repeated passages
    want = {i: x[3] for i, *x in brute.removal([(i, rows[i]) for i in sorted(least)])}
    cut = {r["doc_id"]: r["text"] for r in passages.collect()}
    assert {i: brute.words(t) for i, t in cut.items()} == want
    # the mix: whole texts, at most three times, each source near its share
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert max(taken.values()) <= 3 and {r["text"] for r in mixed.collect()} <= set(cut.values())
    total = sum(len(brute.words(cut[i])) * n for i, n in taken.items())
    assert 0.9 * sum(len(w) for w in want.values()) <= total <= sum(len(w) for w in want.values())
    # packing: every copy's ids, gapless
    encode = packing.WordIds(packing.tokenizer_path())
    pieces = Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed.collect())
    plain = Counter()
    for i, n in taken.items():
        ids = encode(cut[i].encode()) + np.array([0], "<u4").tobytes()
        for k in range(0, len(ids), 8192):
            plain[i, k // 8192, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])] += n
    assert pieces == plain
    ends = {}
    for r in packed.collect():
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)][:-1]).tolist() for p in ends.values())
    assert set(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())) == set(pieces)


def test_stages_on_odd_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.count() > 0
        assert stage(spark, make_docs([]), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(odd_rows)


def test_near_duplicates_of_five_words_and_four_fifths(spark, make_docs):
    """Pairs around the border, against a plain comparison of word 5-grams at 0.8."""
    rows, n = [], 200
    for k, (edits, tail) in enumerate([(4, 0), (5, 0), (0, 30), (0, 43), (0, 44), (0, 60), (1, 25)]):
        text = [f"w{k}x{i}" for i in range(n)]
        other = text[:]
        for e in range(edits):
            other[10 + e * n // 6] = f"edit{e}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other + [f"more{k}x{i}" for i in range(tail)]))]
    fives = [brute.shingles(t, 5) for _, t in rows]
    plain = {2 * k + 1 for k in range(len(rows) // 2) if 100 * len(fives[2 * k] & fives[2 * k + 1]) >= 80 * len(fives[2 * k] | fives[2 * k + 1])}
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, make_docs(rows), SF).collect()}
    assert kept == {i for i, _ in rows} - plain and 0 < len(plain) < len(rows) // 2
    # some of them only at this width and similarity
    assert plain - {i for i, _, c in brute.components(rows) if i != c}
