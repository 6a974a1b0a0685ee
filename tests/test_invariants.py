"""Invariants and brute-force checks on generated fixtures with a hot key."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.operators import access as A
from sluice.operators import merge as M
from sluice.operators.sequence import dense_position, previous_in_group
from sluice.sources import bindings as B
from tests.conftest import SF0001, SF001


def _hot_log(spark, n=600, seed=3):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        inst = "hot" if rnd.random() < 0.7 else "cold"
        key = 0 if rnd.random() < 0.34 else rnd.randrange(40)  # one key holds a third of the rows
        rows.append((inst, key, base + dt.timedelta(seconds=rnd.randrange(50_000)), i, 1.0, False))
    return rows, spark.createDataFrame(
        rows, "instance string, key long, ts timestamp_ntz, seq long, op_ms double, is_error boolean")


def _brute_reuse(rows):
    out = {}
    by_inst = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        by_inst.setdefault(r[0], []).append(r)
    for inst, seq_rows in by_inst.items():
        last = {}
        for i, r in enumerate(seq_rows):
            k = r[1]
            if k in last:
                out[r[3]] = len({x[1] for x in seq_rows[last[k] + 1:i]})
            last[k] = i
    return out


def test_reuse_distance_matches_brute_force_with_small_blocks(spark):
    rows, log = _hot_log(spark)
    s = A.sequence_log(log, num_partitions=9)  # many slices: the hot key spans several
    want = _brute_reuse(rows)
    for block in (4, 16, 1024):
        got = {r.seq: r.reuse_distance for r in A.reuse_distance(s, block=block).collect()}
        assert got == want, block


def test_skew_safe_lag_and_positions_match_windows(spark):
    _, log = _hot_log(spark)
    s = previous_in_group(dense_position(log, ["instance"], ["ts", "seq"], "pos", num_partitions=13),
                          ["instance", "key"], ["pos"], ["ts"], num_partitions=11)
    w = Window.partitionBy("instance").orderBy("ts", "seq")
    ref = log.withColumn("rpos", F.row_number().over(w)).withColumn(
        "rprev", F.lag("ts").over(Window.partitionBy("instance", "key").orderBy("ts", "seq")))
    j = s.join(ref.select("seq", "rpos", "rprev"), "seq")
    assert j.filter((F.col("pos") != F.col("rpos")) | ~F.col("prev_ts").eqNullSafe(F.col("rprev"))).count() == 0


def test_fixed_ttl_matches_sequential_replay(spark):
    rows, log = _hot_log(spark)
    ttl = 3000
    want = set()
    anchor = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        k = (r[0], r[1])
        t = r[2]
        if k not in anchor or (t - anchor[k]).total_seconds() >= ttl:
            anchor[k] = t
            want.add(r[3])
    for parts in (None, 7):  # one slice and many slices (the hot key crosses slice borders)
        got = {r.seq for r in A.fixed_ttl_anchors(log, ttl, num_partitions=parts).collect()}
        assert got == want, parts


def test_hits_misses_and_monotone_curve(spark):
    log = B.access_log(spark, SF0001)
    flags = A.access_flags(log, 3600)
    m = A.access_metrics(flags, ["LRU", "TTL-LRU"], [10, 100, 1000]).collect()
    for r in m:
        assert r.hits + r.misses == r.total_operations
    by = {(r.policy, r.cache_size): r.hits for r in m}
    for p in ("LRU", "TTL-LRU"):
        assert by[(p, 10)] <= by[(p, 100)] <= by[(p, 1000)]
        assert by[("LRU", 1000)] >= by[(p, 1000)]
    s = A.sequence_log(log)
    curve = [r.hits for r in A.hit_rate_curve(s, A.reuse_distance(s), [1, 5, 50, 500]).orderBy("cache_size").collect()]
    assert curve == sorted(curve)


def test_sliding_hits_at_least_fixed_hits(spark):
    log = B.access_log(spark, SF0001)
    s = A.sequence_log(log)
    sliding = A.ttl_hits_sliding(s, 86400).filter("hit").count()
    fixed = log.count() - A.fixed_ttl_anchors(log, 86400).count()
    assert sliding >= fixed


def test_upsert_twice_equals_once(spark):
    mr = B.model_results(spark, SF0001)
    inc = B.incoming_results(spark, SF0001)
    once = M.upsert_results(mr, inc)
    twice = M.upsert_results(once, inc)
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_best_score_is_max(spark):
    from sluice.operators import scoring as SC
    from sluice.schemas import models_dim

    mr = B.model_results(spark, SF001)
    best = SC.best_model_per_question(mr, models_dim(spark))
    mx = mr.groupBy("question_id").agg(F.max("quality_score").alias("m"))
    assert best.join(mx, "question_id").filter(F.col("m") != F.col("best_score")).count() == 0


def test_curve_by_instance_adds_up_to_global(spark):
    log = B.access_log(spark, SF0001)
    s = A.sequence_log(log)
    d = A.reuse_distance(s)
    sizes = [1, 10, 100]
    glob = {r.cache_size: (r.accesses, r.hits) for r in A.hit_rate_curve(s, d, sizes).collect()}
    per = A.hit_rate_curve(s, d, sizes, by_instance=True).groupBy("cache_size").agg(
        F.sum("accesses").alias("a"), F.sum("hits").alias("h")).collect()
    assert {r.cache_size: (r.a, r.h) for r in per} == glob


def _replay(rows, size, ttl_us=None):
    """A least-recently-used cache replayed access by access: hits and evictions (keys pushed out). Expired
    entries leave before each access."""
    cache, hits, evictions = {}, 0, 0
    for key, t in rows:
        if ttl_us is not None:
            for gone in [k for k, at in cache.items() if t - at >= ttl_us]:
                del cache[gone]
        if key in cache:
            hits += 1
        elif key not in cache and len(cache) >= size:
            del cache[min(cache, key=lambda k: order[k])]
            evictions += 1
        cache[key] = t
        order[key] = order["next"] = order.get("next", 0) + 1
    return hits, evictions


order: dict = {}


def test_metrics_equal_a_replay(spark):
    import datetime as dt

    rows, log = _hot_log(spark)
    ttl = 3000
    m = {(r.policy, r.cache_size): r for r in A.access_metrics(A.access_flags(log, ttl), A.SIZED_POLICIES, [1, 3, 10]).collect()}
    epoch = dt.datetime(1970, 1, 1)
    for size in (1, 3, 10):
        for policy, limit in (("LRU", None), ("TTL-LRU", ttl * 1_000_000)):
            hits = evictions = 0
            for inst in {r[0] for r in rows}:
                order.clear()
                mine = [(r[1], (r[2] - epoch) // dt.timedelta(microseconds=1)) for r in sorted((r for r in rows if r[0] == inst), key=lambda r: (r[2], r[3]))]
                h, e = _replay(mine, size, limit)
                hits, evictions = hits + h, evictions + e
            assert (m[policy, size].hits, m[policy, size].evictions) == (hits, evictions), (policy, size)


def test_smaller_before_of_a_large_group():
    import numpy as np

    from sluice.operators.dominance import weighted_smaller_before

    draw = np.random.default_rng(1)
    for n, most in ((5000, 700), (5000, 10**9), (1, 5), (0, 5)):
        v, w = draw.integers(0, most, n), draw.integers(0, 3, n)
        want = [int(w[:i][v[:i] < v[i]].sum()) for i in range(n)]
        assert weighted_smaller_before(v, w).tolist() == want


def test_dominance_counts_over_three_levels(spark):
    import numpy as np

    from sluice.operators import dominance as D

    draw = np.random.default_rng(2)
    points, queries, want = [], [], {}
    for inst, n in (("a", 500), ("b", 37), ("c", 1)):
        # previous positions: unique values above 0, many zeros, a run of neighbours
        prev = [0] * n
        free = list(range(1, n))
        draw.shuffle(free)
        for i in range(2, n + 1):
            back = [p for p in (i - 1, free[i % len(free)] if free else 0) if 0 < p < i and p not in prev]
            if back and draw.random() < 0.7:
                prev[i - 1] = back[0]
        points += [(inst, i + 1, int(p)) for i, p in enumerate(prev)]
        for k in range(300):
            x, y = int(draw.integers(-1, n + 1)), int(draw.integers(-1, n + 1))
            queries.append((inst, k, k % 2, x, y))
            want[inst, k, k % 2] = sum(1 for i, p in enumerate(prev) if i + 1 <= x and p <= y)
    p = spark.createDataFrame(points, "instance string, x long, y long")
    q = spark.createDataFrame(queries, "instance string, id long, tag int, x long, y long")
    assert D.levels_of(500, 8, 4) == 3
    for block, fanout, chunk in ((8, 4, 16), (4, 8, 3), (1 << 17, 256, 1 << 16)):
        got = {(r.instance, r.id, r.tag): r.n for r in D.dominance_counts(p, q, 500, block, fanout, chunk).collect()}
        assert got == want, (block, fanout, chunk)


def test_dense_key_has_a_bounded_summary(spark):
    """A million accesses of one key within one TTL: no slice lists its accesses, and the one anchor is found."""
    import datetime as dt

    n = 1_000_000
    log = spark.range(n).select(F.lit("hot").alias("instance"), F.lit(1).cast("long").alias("key"),
                                (F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") / 1000)).alias("ts"), F.col("id").alias("seq"))
    from sluice.operators.sequence import stored_slices

    rows = log.select("instance", "key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "seq")
    slices = stored_slices(rows, ["instance", "key"], ["t", "seq"], 8)
    found = A._passages(slices, [3600 * 1_000_000, 100 * 1_000_000], A.MAX_ENTRIES)
    assert found.agg(F.max(F.size(F.coalesce("entry", F.array().cast("array<long>")))), F.count(F.lit(1))).first()[:] == (0, 16)
    assert [r.seq for r in A.fixed_ttl_anchors(log, 3600, num_partitions=8).collect()] == [0]
    # 100 s: ten anchors, each in a slice that is asked for it
    assert sorted(r.seq for r in A.fixed_ttl_anchors(log, 100, num_partitions=8).collect()) == list(range(0, n, 100_000))


def test_dense_slices_are_asked(spark):
    rows, log = _hot_log(spark)
    ttl, want, anchor = 3000, set(), {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        k, t = (r[0], r[1]), r[2]
        if k not in anchor or (t - anchor[k]).total_seconds() >= ttl:
            anchor[k] = t
            want.add(r[3])
    for most in (0, 1, 3, 1000):
        assert {r.seq for r in A.fixed_ttl_anchors_multi(log, [ttl], num_partitions=17, max_entries=most).collect()} == want, most
