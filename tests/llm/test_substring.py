import random

from sluice.llm import substring
from tests.llm import brute


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def wanted(rows, width=20):
    return sorted((-1 if i is None else i, *x[:3]) for i, *x in brute.removal([r[:2] for r in rows], width))


def test_odd_rows(make_docs, odd_rows):
    assert found(substring.removal_digest(make_docs(odd_rows))) == wanted(odd_rows)


def test_passages_in_many_blocks(make_docs, monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        t = []
        for _ in range(draw.randint(0, 4)):
            t += draw.choice(passages) if draw.random() < 0.5 else [draw.choice(vocabulary) for _ in range(draw.randint(1, 30))]
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(substring, "BLOCK_BYTES", 300)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 500)
    docs = make_docs(rows).repartition(7)
    for width in (5, 20):
        assert found(substring.removal_digest(docs, width)) == wanted(rows, width)


def test_removed_text(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = substring.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    want = sorted(("" if i is None else str(i), tuple(x[3])) for i, *x in brute.removal([r[:2] for r in odd_rows]))
    rows = out.collect()
    assert sorted(("" if r["doc_id"] is None else str(r["doc_id"]), tuple(brute.words(r["text"]))) for r in rows) == want
    before = {r[0]: r[1] for r in odd_rows}
    for r in rows:
        assert r["n_chars"] == (len(r["text"]) if r["text"] is not None else None)
        if r["doc_id"] in (0, 1, 2, 8, 9):
            assert (r["text"] == before[r["doc_id"]]) or r["doc_id"] == 8


def test_empty(make_docs):
    assert substring.removal_digest(make_docs([])).count() == 0
    assert substring.remove_repeats(make_docs([(1, None)])).collect()[0]["text"] is None


def thue_morse(n, a="a", b="b"):
    w = a
    other = str.maketrans(a + b, b + a)
    while len(w) < n:
        w += w.translate(other)
    return w


def test_long_words_of_two_letters(make_docs):
    """Words that equal polynomial hashes modulo 2**64 are different words."""
    for n in (1024, 2048, 4096):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        head = [f"w{i}" for i in range(19)]
        rows = [(1, " ".join([*head, x])), (2, " ".join([*head, y]))]
        assert found(substring.removal_digest(make_docs(rows))) == wanted(rows)
        assert [r[2] for r in found(substring.removal_digest(make_docs(rows)))] == [0, 0]


def test_a_short_filter_hash_gives_the_same(make_docs, odd_rows, monkeypatch):
    """With 16 bits most windows are candidates; the second pass decides."""
    docs = make_docs(odd_rows)
    assert found(substring.removal_digest(docs, bits=16)) == wanted(odd_rows)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 300)
    monkeypatch.setattr(substring, "BUCKET_BYTES", 2000)
    assert found(substring.removal_digest(docs.repartition(5), width=5, bits=8)) == wanted(odd_rows, 5)


def test_texts_are_shuffled_once(make_docs, odd_rows):
    spark = make_docs([]).sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (substring.removal_digest(make_docs(odd_rows)), substring.remove_repeats(make_docs(odd_rows))):
            out.write.format("noop").mode("overwrite").save()
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "ReusedExchange" in plan.split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
