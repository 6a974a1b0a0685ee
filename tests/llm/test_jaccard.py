import random

import numpy as np
import pytest

from sluice.llm import graph, jaccard
from tests.llm import brute


def found(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], (-1 if r["component_id"] is None else r["component_id"])) for r in df.collect())


def wanted(rows):
    return sorted((-1 if i is None else i, n, -1 if c is None else c) for i, n, c in brute.components([r[:2] for r in rows]))


def test_odd_rows(make_docs, odd_rows):
    assert found(jaccard.near_duplicates(make_docs(odd_rows))) == wanted(odd_rows)


def near_copies(seed, groups, most):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)]
    rows = []
    for _ in range(groups):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(5, 80))]
        for _ in range(draw.randint(1, most)):
            t = list(base)
            for _ in range(draw.randint(0, 4)):
                t[draw.randrange(len(t))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(t)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("join_tokens", [10**6, 300])
def test_near_copies_whole_and_in_blocks(make_docs, join_tokens):
    """Small join tasks split the clusters in blocks: the same links are found."""
    rows = near_copies(7, 12, 25)
    assert found(jaccard.near_duplicates(make_docs(rows), join_tokens=join_tokens)) == wanted(rows)


def test_link_block_is_exact():
    draw = np.random.default_rng(4)
    for _ in range(30):
        base = draw.integers(1, 200, 60)
        sets = [frozenset(base.tolist())]
        for _ in range(40):
            s = set(draw.choice(base, draw.integers(40, 60)).tolist()) | set(base[:45].tolist())
            s -= set(draw.choice(base, draw.integers(0, 8)).tolist())
            sets.append(frozenset(s | set(draw.integers(1000, 1010, draw.integers(0, 5)).tolist())))
        sets = list(dict.fromkeys(s for s in sets if s))
        often = {}
        for s in sets:
            for t in s:
                often[t] = often.get(t, 0) + 1
        ordered = [sorted(s, key=lambda t: (often[t], t)) for s in sets]
        ordered = [[t for t in o if often[t] > 1] for o in ordered]
        links = jaccard.link_block(list(range(len(sets))), [len(s) for s in sets], [np.array(o, dtype=np.uint64) for o in ordered],
                                   [np.array([often[t] for t in o], dtype=np.uint32) for o in ordered], [0] * len(sets), False)

        def closed(edges):
            group = list(range(len(sets)))
            for a, b in edges:
                x, y = group[a], group[b]
                group = [x if g == y else g for g in group]
            return [group.index(g) for g in group]

        true = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
        assert set(links) <= set(true) and closed(links) == closed(true)


def test_levels():
    level, length = jaccard.choose_level(100, np.full(100, 2, dtype=np.uint32), 85)
    assert level >= 1 and length == min(jaccard.prefix_length(100, level, 85), 100)
    hot, _ = jaccard.choose_level(100, np.full(100, 5000, dtype=np.uint32), 85)
    assert hot > level  # costly prefixes ask for more matches


def test_keep_one(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    leave = {i for i, n, c in brute.components([r[:2] for r in odd_rows]) if n == 0 or i == c}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == leave


def test_empty(make_docs):
    assert jaccard.near_duplicates(make_docs([])).count() == 0
    assert found(jaccard.near_duplicates(make_docs([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_components_across_tasks(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    group = {x: x for e in edges for x in e}
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    df = spark.createDataFrame(edges, "a long, b long")
    for per_task in (10**6, 40):
        got = {r["node"]: r["root"] for r in graph.connected_components(df, per_task).collect()}
        assert all(got.get(x, x) == r for x, r in group.items())


def test_long_words_of_two_letters(make_docs):
    """Words that equal polynomial hashes modulo 2**64 share no shingle."""
    from tests.llm.test_substring import thue_morse

    for n in (1024, 2048, 4096):
        rows = [(1, thue_morse(n)), (2, thue_morse(n, "b", "a")), (3, thue_morse(n) + " and more words"), (4, thue_morse(n, "b", "a") + " and more words")]
        assert found(jaccard.near_duplicates(make_docs(rows))) == wanted(rows)
        assert [r[2] for r in found(jaccard.near_duplicates(make_docs(rows)))] == [1, 2, 3, 4]


@pytest.mark.parametrize("hot", [1, 4, 30])
def test_hot_shingles(make_docs, odd_rows, hot):
    """Few entries make a shingle hot: the same components."""
    rows = near_copies(11, 12, 25)
    assert found(jaccard.near_duplicates(make_docs(rows), hot=hot)) == wanted(rows)
    assert found(jaccard.near_duplicates(make_docs(odd_rows), hot=hot)) == wanted(odd_rows)


def test_summary_bounds():
    draw = np.random.default_rng(3)
    summary, all_ = jaccard.Summary(50), []
    for _ in range(40):
        part = np.concatenate([draw.integers(0, 4000, 300), draw.integers(0, 5, 60)]).astype(np.uint64)
        summary.add(part)
        all_.append(part)
    tokens, counts = np.unique(np.concatenate(all_), return_counts=True)
    have = dict(zip(summary.tokens.tolist(), summary.counts.tolist(), strict=True))
    assert len(have) <= 50 and summary.seen == counts.sum()
    for t, c in zip(tokens.tolist(), counts.tolist(), strict=True):
        assert c - summary.seen / 50 <= have.get(t, 0) <= c


def test_a_shingle_in_all_documents_is_in_no_range(spark):
    """100,000 documents with one line in common: no group of shingles holds an entry for each."""
    from pyspark.sql import functions as F

    n = 100_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a line in common "), F.concat_ws(" ", *[F.md5(F.concat_ws("-", F.when(F.col("id") % 1000 == 7, 7).otherwise(F.col("id")), F.lit(i))) for i in range(3)]),
        F.when(F.col("id") % 1000 == 7, F.concat(F.lit(" "), F.col("id").cast("string"))).otherwise(F.lit(""))).alias("text"))
    plain = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    tokens, often = jaccard.frequent(plain, 4, 10**7, hot=20_000)
    assert set(jaccard.shingle_sets([b"a line in common"], 4)[0].tolist()) <= set(tokens.tolist()) and len(tokens) < 10
    assert 0.9 * n < often.max() <= n  # a summary counts a little too few
    buckets = 64
    largest = {}
    for given in (tokens, np.empty(0, np.uint64)):
        dealt = jaccard.deal(plain, 4, buckets, spark.sparkContext.broadcast((given, None))).where(F.col("bucket") < buckets)
        entries = {}
        for r in dealt.collect():
            entries[r["bucket"]] = entries.get(r["bucket"], 0) + len(jaccard.unpack(bytes(r["packed"]))[0])
        largest[len(given)] = max(entries.values())
    assert largest[len(tokens)] < 10_000 and largest[0] > n
    got = jaccard.near_duplicates(docs, percent=50, hot=20_000).groupBy("component_id").count().where("count > 1").collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(7, n // 1000)]
