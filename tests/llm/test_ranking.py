import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from sluice.llm import ranking
from tests.llm.brute import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("term", T.LongType())])


def plain(docs, items, k):
    words = [TERM.findall(lower(t)) for _, t in docs]
    n, total = sum(bool(w) for w in words), sum(map(len, words))
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for i, terms in asked.items():
        found = []
        for (d, _), w in zip(docs, words, strict=True):
            score = 0
            for t in terms & set(w):
                tf, m = w.count(t), 100 - 50 + (50 * len(w) * n) // total
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(-1 if i is None else i, r, -1 if f[3] is None else f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((-1 if r["item_id"] is None else r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in df.collect())


def frame(spark, items):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in items], ITEMS)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["été", "Straße", "X1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # a third are copies: equal scores
    items = [(i, ", ".join(draw.choices(words, weights, k=draw.randint(1, 12)))) for i in range(30)] + [(40, docs[3][1])]
    draw.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_docs": 37, "span": 8, "short": 0.1}, {"shard_bytes": 900, "span": 4, "short": 0.0}, {"short": 1.0, "shard_docs": 100}, {"block_terms": 20, "shard_docs": 60}])
def test_shards_spans_and_blocks(spark, make_docs, corpus, options):
    docs, items = corpus
    assert found(ranking.ranked_search(make_docs(docs).repartition(5), frame(spark, items), k=7, **options)) == plain(docs, items, 7)


def test_odd_rows(spark, make_docs, odd_rows):
    docs = [r[:2] for r in odd_rows]
    items = [(1, docs[5][1]), (2, None), (3, ""), (4, "A--b,c"), (5, "nowhere"), (None, docs[5][1]), (6, docs[9][1]), (7, "the changed"), (7, "WORD"), (1, docs[5][1])]
    assert found(ranking.ranked_search(make_docs(odd_rows), frame(spark, items))) == plain(docs, items, 50)


def test_empty_tables(spark, make_docs):
    none = make_docs([])
    assert ranking.ranked_search(none, frame(spark, [(1, "a")])).count() == 0
    assert ranking.ranked_search(make_docs([(1, "a b")]), frame(spark, [])).count() == 0
    assert ranking.ranked_search(make_docs([(1, None), (2, "  ")]), frame(spark, [(1, "a")])).count() == 0


def test_terms():
    for text in ("Ab-c_d e1\x00f\x7fg", "É é Ünï", "a b", "", "ÀZ[z]"):
        assert [t.decode() for t in ranking.terms_of(text.encode())] == TERM.findall(lower(text))


def test_few_documents_are_scored():
    """Long lists are skipped: with a threshold only some documents are probed."""
    draw = np.random.default_rng(1)
    docs = 20_000
    lists, terms = [], []
    for share in (0.9, 0.6, 0.3, 0.01, 0.002):
        at = np.flatnonzero(draw.random(docs) < share)
        lists.append(at)
    terms = np.arange(len(lists), dtype=np.uint32)
    border = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.uint32)
    value = ranking.pack(np.arange(docs), np.full(docs, 100), terms, border, np.concatenate(lists).astype(np.uint32), np.ones(int(border[-1]), np.uint32))
    weights = np.array([ranking.weight(docs, len(x)) for x in lists])
    shard = ranking.Shard(value, weights, docs, 100 * docs)
    places, scores, scored = shard.search(terms, 10, 1)
    full = np.zeros(docs, dtype=np.int64)
    np.add.at(full, np.concatenate(lists), shard.score)
    want = np.lexsort((np.arange(docs), -full))[:10]
    assert places.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert scored < docs // 10
