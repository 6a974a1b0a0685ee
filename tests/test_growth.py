"""Steps whose memory, time or tasks must not grow faster than their input."""

import datetime as dt
import random

import numpy as np

from sluice.operators import access as A
from sluice.operators import sequence

START = dt.datetime(2024, 1, 1)


def _log(spark, n, keys, span, seed=3):
    draw = random.Random(seed)
    rows = [("ab"[draw.random() < 0.3], 0 if draw.random() < 0.4 else draw.randrange(keys), draw.randrange(span), i) for i in range(n)]
    return rows, spark.createDataFrame([(a, k, START + dt.timedelta(seconds=t), s) for a, k, t, s in rows], "instance string, key long, ts timestamp_ntz, seq long")


def _plain_anchors(rows, ttl):
    anchor, found = {}, set()
    for a, k, t, s in sorted(rows, key=lambda r: (r[2], r[3])):
        if (a, k) not in anchor or t - anchor[a, k] >= ttl:
            anchor[a, k] = t
            found.add(s)
    return found


def test_python_holds_slices_of_bounded_rows(spark, monkeypatch):
    """More rows make more slices, however small the files are and whatever the shuffle partitions."""
    rows, log = _log(spark, 3000, 40, 50_000)
    monkeypatch.setattr(sequence, "HELD_ROWS", 100)
    seen = []
    kept = A.stored_slices
    monkeypatch.setattr(A, "stored_slices", lambda *a: seen.append(kept(*a)) or seen[-1])
    got = A.fixed_ttl_anchors_multi(log, [900, 5000]).collect()
    sizes = [r["count"] for r in seen[0].groupBy("_pid").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 400
    for ttl in (900, 5000):
        assert {r.seq for r in got if r.ttl_seconds == ttl} == _plain_anchors(rows, ttl)


def test_anchors_of_all_runs_at_once():
    run, t = np.array([0, 0, 0, 0, 1, 1, 3]), np.array([-(2**63), 5, 9, 14, 5, 14, 0])
    assert A.anchors_of(run, t, 5, np.array([0, 4, 6])).tolist() == [True, True, False, True, True, True, True]
    assert A.anchors_of(run, t, 5, np.array([2, 5])).tolist() == [False, False, True, True, False, True, False]
    assert A.first_at(run, t, np.array([0, 0, 1]), np.array([6, 99, 6])).tolist() == [2, 4, 5]


def test_keyed_state_is_called_by_bucket(spark):
    """Many keys share the state of a bucket; null and long keys come out as they came in, with any state store."""
    from sluice.streaming import streams as ST
    from tests.test_streaming import _arrivals, _plain_fixed

    draw = random.Random(8)
    keys = [None, 2**60 + 1, 2**60 + 2, *range(300)]
    rows = [("ab"[draw.random() < 0.5] if i % 50 else None, draw.choice(keys), t, i) for i, t in enumerate(sorted(draw.randrange(40_000) for _ in range(1500)))]
    parts = [rows[:700], rows[700:710], rows[710:]]
    stream, arrive = _arrivals(spark, parts)
    out = ST.scratch(spark, "t-buckets")
    ST.run_in_parts(ST.fixed_ttl_flags(stream, 2000, buckets=4), out, arrive)
    got = spark.read.parquet(f"{out}/batch_id=*").collect()
    assert {r.seq: r.hit for r in got} == _plain_fixed(rows, 2000)
    assert sorted((r.seq, r.instance, r.key) for r in got) == [(s, a, k) for a, k, _, s in rows]
    assert spark.read.format("statestore").load(f"{out}/_checkpoint").count() <= 4
    stream, arrive = _arrivals(spark, parts)
    out = ST.scratch(spark, "t-bucket-sessions")
    ST.run_in_parts(ST.residency_sessions(stream, 2000, buckets=4), out, arrive, "update")
    found = ST.latest_sessions(spark.read.option("basePath", out).parquet(f"{out}/batch_id=*"), 2000).collect()
    last, opened = {}, 0
    for a, k, t, _ in rows:
        opened += (a, k) not in last or t - last[a, k] >= 2000
        last[a, k] = t
    assert len(found) == opened and sum(r.accesses for r in found) == len(rows)
    assert spark.read.format("statestore").load(f"{out}/_checkpoint").count() <= 4


def test_many_queries_of_one_position_are_dealt_to_parts(spark, monkeypatch):
    """Queries of the log's end all ask for its last position: no pandas group holds them all."""
    from sluice.operators import dominance as D

    draw = random.Random(4)
    prev = list(range(1, 101))
    draw.shuffle(prev)
    points = [("a", i + 1, prev[i] if prev[i] < 70 else 0) for i in range(100)]
    queries = [("a", i, 0, 100 if i % 4 else draw.randrange(1, 101), draw.randrange(0, 100)) for i in range(600)]
    p = spark.createDataFrame(points, "instance string, x long, y long")
    q = spark.createDataFrame(queries, "instance string, id long, tag int, x long, y long")
    held = []
    parted = D._parted
    monkeypatch.setattr(D, "_parted", lambda *a: held.append(parted(*a)) or held[-1])
    for block, fanout, chunk in ((8, 4, 8), (128, 4, 8)):
        got = {r.id: r.n for r in D.dominance_counts(p, q, 100, block, fanout, chunk).collect()}
        assert got == {i: sum(a <= x and b <= y for _, a, b in points) for _, i, _, x, y in queries}
    for h in held[:-1]:  # of the small blocks
        group = [c for c in ("instance", "node", "chunk", "part") if c in h.columns]
        assert max(r["count"] for r in h.where(h.kind == D.QUERY).groupBy(*group).count().collect()) <= 64


def test_append_splits_large_tasks(spark, tmp_path):
    """``files`` is where the sink begins; tasks above the advisory size are split."""
    from sluice.sources import ingest as IN

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        df = spark.range(0, 200_000, 1, 40).selectExpr("id", "sha2(cast(id as string), 256) AS text")
        IN.batch_append_sink(df, f"{tmp_path}/t", files=4)
    finally:
        spark.conf.set(name, before)
    files = list((tmp_path / "t").glob("*.parquet"))
    assert len(files) > 8
    assert spark.read.parquet(f"{tmp_path}/t").selectExpr("count(*)", "count(distinct id)").first() == (200_000, 200_000)
