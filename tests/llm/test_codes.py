import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from sluice.llm import codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
                       T.StructField("row", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("position", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "r", 1, 2) for i, v, k in rows], SCHEMA)


def plain(rows, parts, entries, rounds):
    """The codes by loops over exact integers."""
    good = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in good) // parts))
    good = [(i, v + [0] * (parts * width - len(v)), k) for i, v, k in good]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    ids = sorted({i for i, _, _ in good}, key=lambda i: (i is None, i or 0))[:entries]
    first = [min(v for j, v, _ in good if j == i) for i in ids]
    books = [[cut(v)[p] for v in first] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in good:
                held.setdefault(near(cut(v)[p], books[p])[0], []).append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(held[e]) for c in zip(*held[e], strict=True)) if e in held else books[p][e] for e in range(len(books[p]))]
    found = [(i, [near(x, books[p]) for p, x in enumerate(cut(v))], k) for i, v, k in good]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    total = {}
    for _, n, k in found:
        total[k] = total.get(k, 0) + sum(d for _, d in n)
    return sorted(((-1 if i is None else i), "".join(f"{e:02x}" for e, _ in n), sum(d for _, d in n), total[k], sha) for i, n, k in found)


def found(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("members", [codes.MEMBERS, 40])
def test_rounds_with_a_common_vector(spark, monkeypatch, members):
    monkeypatch.setattr(codes, "BLOCK", 8)  # many blocks and, with few members an owner, many salts
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(0, 1, 8) * draw.choice([0.01, 1, 5])).tolist(), int(draw.integers(0, 3)) if i % 5 else None) for i in range(200)]
    rows += [(i, [0.25] * 8, 7) for i in range(200, 300)]  # a third of the vectors are one
    draw.shuffle(rows)
    rows = [(int(i), list(v), k) for i, v, k in rows]
    for rounds in (1, 2, 3):
        assert found(codes.compress(frame(spark, rows), parts=4, entries=8, rounds=rounds, members=members)) == plain(rows, 4, 8, rounds)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [float("nan"), 1.0], 1), (3, [float("inf"), 1.0], None), (4, [None, 1.0], 2), (None, [1.0, 1.0], None), (5, [], 2),
            (6, [-1.0, -0.001], 2), (7, [3.0], None), (20, [0.0, 0.0], 3), (20, [0.0, 0.0], 3), (21, [0.5, 9.0], 3), (21, [0.25, 9.0], 3), (40, [1000.0, -1000.0], 1)]
    for entries in (2, 64):
        assert found(codes.compress(frame(spark, rows), parts=2, entries=entries)) == plain(rows, 2, entries, 2)
    assert codes.compress(frame(spark, [])).count() == 0
    assert codes.compress(frame(spark, [(1, None, 1)])).count() == 0
    assert found(codes.compress(frame(spark, [(20, [1.0], None)]))) == plain([(20, [1.0], None)], 16, 64, 2)


def test_components_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [-1e6, 2.0], 1)]
    with pytest.raises(ValueError, match="too large"):
        codes.compress(frame(spark, rows), parts=2)
    big = [(0, [3e5, 1.0], 1), (1, [-3e5, 2.0], 1), (2, [3e5, 1.5], 2)]
    assert found(codes.compress(frame(spark, big), parts=2, entries=2)) == plain(big, 2, 2, 2)


def test_nearest_is_exact_beyond_floating_point():
    draw = np.random.default_rng(2)
    parts, entries = draw.integers(-(1 << 28), 1 << 28, (50, 4)), draw.integers(-(1 << 28), 1 << 28, (9, 4))
    index, least = codes.nearest(parts, entries)
    for p, i, d in zip(parts.tolist(), index.tolist(), least.tolist(), strict=True):
        all_ = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in entries.tolist()]
        assert d == min(all_) and i == all_.index(d)


def test_members_that_stay_are_not_shuffled(spark):
    draw = np.random.default_rng(3)
    rows = frame(spark, [(i, draw.normal(0, 1, 8).tolist(), 1) for i in range(60)])
    stored = codes.write_table(codes.quantised(rows).withColumn("row", codes.F.monotonically_increasing_id()), "vectors")
    books = draw.integers(-300, 300, (2, 5, 4))
    table = codes._store(codes.settled(stored, books, 1, 8), 8)
    after = codes.updated(books, table)
    next_ = codes.migrated(table, after)
    plan = next_._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan.split("Exchange")[0]
    gone = codes.movers(table, after).toPandas()
    moved = sum(len(codes._unpacked(v, 4)[0]) for v in gone["members"])
    assert 0 < moved < 120
    held = {(r["position"], r["entry"]): r["total"][-1] for r in next_.collect()}
    assert sum(held.values()) == 120
