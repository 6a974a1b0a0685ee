"""Streams: replays, keyed state over several parts of a log, and the sampled curve against the exact one."""

from pyspark.sql import functions as F

from sluice.operators import access as A
from sluice.operators.merge import upsert_results
from sluice.sources import bindings as B
from sluice.streaming import streams as ST
from tests.conftest import SF0001, SF001


def test_upsert_sink_replay_is_idempotent(spark):
    src = ST.scratch(spark, "t-incoming")
    B.incoming_results(spark, SF0001).repartition(2, "question_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    out = ST.scratch(spark, "t-upsert")
    base = B.model_results(spark, SF0001)

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)

    first = ST.upsert_sink(stream(), base, out)
    # a second run on the same checkpoint finds nothing new and keeps the same version
    second = ST.upsert_sink(stream(), base, out)
    assert first == second
    want = upsert_results(base, B.incoming_results(spark, SF0001))
    got = spark.read.parquet(*second)
    # each bucket is stored once
    stored = [f"{v}/{b}" for v in ST._names(spark, out) if v.startswith("v") for b in ST._names(spark, f"{out}/{v}") if b.startswith("bucket=")]
    assert len(stored) == len({x.split("/")[1] for x in stored}) == len(second)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sampled_curve_tracks_exact_curve(spark):
    log = B.access_log(spark, SF001)
    s = A.sequence_log(log)
    exact = {r.cache_size: r.hit_rate_percent for r in A.hit_rate_curve(s, A.reuse_distance(s), [10, 100, 1000]).collect()}
    approx = {r.cache_size: r.hit_rate_percent
              for r in A.hit_rate_curve_sampled(log, [10, 100, 1000], max_keys=100).collect()}
    for c in exact:
        assert abs(exact[c] - approx[c]) < 5.0, (c, exact[c], approx[c])
    # no fewer keys than there are: the curve itself
    whole = {r.cache_size: r.hit_rate_percent for r in A.hit_rate_curve_sampled(log, [10, 100, 1000], max_keys=100_000).collect()}
    assert whole == exact


def test_window_metrics_of_open_and_closed_windows(spark):
    import __spark_entry__ as E

    got = E.queries()["stream_hit_metrics"](spark, SF001).agg(F.count("*").alias("n"), F.sum("ops").alias("ops"), F.sum("misses").alias("misses")).first()
    assert (got.n, got.ops, got.misses) == (30, 10000, 9017)  # the last, open day is there


def test_sessions_include_open_ones(spark):
    import __spark_entry__ as E

    got = E.queries()["stream_residency"](spark, SF001)
    assert got.count() == 8964 and got.agg(F.sum("hits")).first()[0] == 1036


def _arrivals(spark, parts):
    """A log (instance, key, seconds, seq) that arrives in parts: the stream and its steps."""
    import datetime as dt

    src, schema = ST.scratch(spark, "t-arrived"), "instance string, key long, ts timestamp, seq long, op_ms double, is_error boolean"
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def step(i, rows):
        full = [(a, k, start + dt.timedelta(seconds=t), s, 1.0, False) for a, k, t, s in rows]
        spark.createDataFrame(full, schema).repartition(2).write.parquet(f"{src}/part={i}")

    return spark.readStream.schema(schema).parquet(src + "/part=*"), [lambda i=i, r=r: step(i, r) for i, r in enumerate(parts)]


def _plain_fixed(rows, ttl):
    anchor, hits = {}, {}
    for a, k, t, s in sorted(rows, key=lambda r: (r[2], r[3])):
        hit = (a, k) in anchor and t - anchor[a, k] < ttl
        if not hit:
            anchor[a, k] = t
        hits[s] = hit
    return hits


def _parts(n=600, seed=5):
    import random

    draw = random.Random(seed)
    rows = [("ab"[draw.random() < 0.3], 0 if draw.random() < 0.4 else draw.randrange(12), t, i) for i, t in enumerate(sorted(draw.randrange(100_000) for _ in range(n)))]
    return rows, [rows[:150], rows[150:160], [], rows[160:450], rows[450:]]


def test_fixed_ttl_from_keyed_state_and_by_batch(spark):
    rows, parts = _parts()
    want = _plain_fixed(rows, 3000)
    stream, arrive = _arrivals(spark, parts)
    out = ST.scratch(spark, "t-keyed")
    with ST.keyed_state(spark):
        ST.run_in_parts(ST.fixed_ttl_flags(stream, 3000), out, arrive)
    assert {r.seq: r.hit for r in spark.read.parquet(f"{out}/batch_id=*").collect()} == want
    stream, arrive = _arrivals(spark, parts)
    out = ST.scratch(spark, "t-batched")
    assert {r.seq: r.hit for r in spark.read.parquet(ST.fixed_ttl_by_batch(stream, 3000, out, arrive, late_seconds=60)).collect()} == want
    # the state is tables of changes, and those whose entries have expired are gone
    left = ST._names(spark, f"{out}/state")
    assert 0 < len(left) < 4 and min(int(x[1:].split("-")[0]) for x in left) > 0


def test_sessions_close_once_and_state_holds_open_ones(spark):
    rows, parts = _parts(seed=6)
    ttl, want = 2000, {}
    for a, k, t, s in rows:
        mine = want.setdefault((a, k), [])
        if mine and t - mine[-1][1] < ttl:
            mine[-1][1], mine[-1][2] = t, mine[-1][2] + 1
        else:
            mine.append([t, t, 1])
    # within the watermark's hour rows may come out of order, also across parts
    parts = [list(reversed(p)) for p in parts]
    parts[0], parts[3] = parts[0][10:], parts[3]
    late = [r for r in _parts(seed=6)[1][0]][-10:]
    parts[1] = parts[1] + late
    stream, arrive = _arrivals(spark, parts)
    out = ST.scratch(spark, "t-sessions")
    with ST.keyed_state(spark):
        ST.run_in_parts(ST.residency_sessions(stream, ttl), out, arrive, "update")
    updates = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    got = ST.latest_sessions(updates, ttl)
    start = 1704067200
    have = sorted((r.instance, r.key, r.b - start, r.accesses) for r in got.select("instance", "key", "accesses", F.unix_seconds(F.col("session_start").cast("timestamp")).alias("b")).collect())
    assert have == sorted((a, k, x[0], x[2]) for (a, k), v in want.items() for x in v)
    closed = updates.where("closed")
    assert closed.groupBy("instance", "key", "start_us").count().where("count > 1").isEmpty()
    # all but the last hours are closed
    assert closed.count() == sum(1 for v in want.values() for x in v if x[1] + ttl <= rows[-1][2] - 3600)


def test_merging_of_out_of_order_sessions():
    import numpy as np

    start, last, n = ST.merge_sessions(np.array([50, 0, 10, 100]), np.array([60, 5, 45, 100]), np.array([2, 1, 3, 1]), 10)
    assert (start.tolist(), last.tolist(), n.tolist()) == ([0, 100], [60, 100], [6, 1])
    start, last, n = ST.merge_sessions(np.array([0, 5]), np.array([100, 6]), np.array([2, 1]), 1)
    assert (start.tolist(), last.tolist(), n.tolist()) == ([0], [100], [3])
