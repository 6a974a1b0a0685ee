import numpy as np
import pytest
from pyspark.sql import types as T

from sluice.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("norm", T.StringType()), T.StructField("vec", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", 1) for i, v in rows], SCHEMA)


def plain(rows, k, every):
    good = list(dict.fromkeys((i, tuple(int(np.floor(64.0 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)))
    width = max((len(v) for _, v in good), default=0)
    m = np.array([list(v) + [0] * (width - len(v)) for _, v in good], dtype=np.int64).reshape(len(good), width)
    return topk.brute_force(np.array([i for i, _ in good], dtype=np.int64), m, every, k)


def same(df, want):
    have = sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))
    assert have == sorted(map(tuple, want.to_numpy().tolist()))


@pytest.mark.parametrize("options", [{}, {"bucket": 16, "queries": 4, "seeds": 1}])
def test_lengths_ties_and_a_common_vector(spark, options):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(0, 1, 8) * draw.choice([0.01, 0.3, 1, 5])).tolist()) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(150, 230)] + [(i, [0.0] * 8) for i in range(230, 240)]
    draw.shuffle(rows)
    same(topk.top_k(frame(spark, rows), k=7, every=10, **options), plain(rows, 7, 10))


def test_clustered_vectors_prune_by_coordinate(spark):
    draw = np.random.default_rng(2)
    centre = np.eye(6) * 4
    rows = [(i, (centre[i % 6] + draw.normal(0, 0.05, 6)).tolist()) for i in range(300)]
    same(topk.top_k(frame(spark, rows), k=5, every=7, bucket=32, queries=8), plain(rows, 5, 7))


def test_groups_too_short_for_a_block_are_not_shipped(spark, monkeypatch):
    """Short vectors, which no query can use, meet none; a mark may stand for several groups."""
    draw = np.random.default_rng(5)
    rows = [(i, (np.eye(4)[i % 4] * (20 if i % 8 < 4 else 0.5) + draw.normal(0, 0.1, 4)).tolist()) for i in range(1200)]
    shipped = []
    monkeypatch.setattr(topk, "ask", lambda blocks, ask=topk.ask: shipped.append((ask(blocks).count(), blocks.count())) or ask(blocks))
    numbered = []
    monkeypatch.setattr(topk, "in_groups", lambda buckets, f=topk.in_groups: numbered.append(f(buckets, 2)) or numbered[-1])
    same(topk.top_k(frame(spark, rows), k=5, every=5, bucket=20, queries=16, seeds=12), plain(rows, 5, 5))
    groups = numbered[0].select("grp").distinct().count()
    assert groups > 10 and 0 < shipped[0][0] <= 0.7 * groups * shipped[0][1]
    for few in (3, 100):
        last, longest = topk.marks_of(numbered[0], few)
        by = {r["grp"]: r["l"] for r in numbered[0].groupBy("grp").agg(topk.F.max("longest").alias("l")).collect()}
        for need in (-np.inf, 10.0, 700.0, 1285.0, 1e9):
            upto = topk.groups_down_to((last, longest), need)
            assert upto >= max((g + 1 for g, x in by.items() if x >= need), default=0) and (few == 3 or upto == max((g + 1 for g, x in by.items() if x >= need), default=0))


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [-1.0, -0.001]),
            (7, [3.0]), (20, [0.0, 0.0]), (20, [0.0, 0.0]), (40, [1e6, -1e6]), (8, [1e6, 3.0])]
    same(topk.top_k(frame(spark, rows), k=20, every=20), plain(rows, 20, 20))
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(20, [1.0])])).count() == 0


def test_products_beyond_floating_point():
    a = np.array([[2**31, 3], [1, 2**30]])
    assert topk.products(a, a).tolist() == [[2**62 + 9, 2**31 + 3 * 2**30], [2**31 + 3 * 2**30, 2**60 + 1]]


def test_components_beyond_64_bits_are_an_error(spark):
    for rows in ([(0, [1e30, 1.0]), (20, [-1e30, 1.0])], [(0, [4e7, 1.0]), (20, [4e7, 4e7])]):
        with pytest.raises(ValueError, match="too large"):
            topk.top_k(frame(spark, rows))
