"""Selections and draws against plain Python: bounded samples, eviction ranges, weighted draws, incremental loads."""

import random

import pytest
from pyspark.sql import functions as F

from sluice.functions.scoring import SPACE
from sluice.operators import access as A
from sluice.operators import retention as RT
from sluice.operators import sampling as SP
from sluice.session import scratch_path
from sluice.sources import ingest as IN


def _log(spark, rows):
    return spark.createDataFrame(rows, "instance string, key long").withColumns(
        {"seq": F.monotonically_increasing_id(), "ts": F.lit("2024-01-01").cast("timestamp_ntz"), "op_ms": F.lit(1.0), "is_error": F.lit(False)})


def _hash60(key):
    import hashlib

    return int(hashlib.md5(str(key).encode()).hexdigest()[:15], 16)


def test_thresholds_keep_a_bounded_number_of_keys(spark):
    rows = [("a", i % 900) for i in range(3000)] + [("b", i) for i in range(5)] + [("c", 7)] * 500
    log = _log(spark, rows).repartition(9)
    for most in (1, 10, 400, 899, 900):
        got = {r.instance: r.threshold for r in A.sample_thresholds(log, most).collect()}
        for inst, keys in (("a", range(900)), ("b", range(5)), ("c", [7])):
            h = sorted(_hash60(k) for k in keys)
            assert got[inst] == (h[most] if len(h) > most else SPACE), (inst, most)
            assert sum(x < got[inst] for x in h) == min(most, len(h))


def test_lowest_scores_by_ranges(spark):
    draw = random.Random(3)
    groups = {
        "even": [draw.randrange(10**9) for _ in range(2000)],
        "ties": [5] * 1500 + [4] * 3 + [10**12],
        "outliers": [-1] * 4 + [draw.randrange(1000) for _ in range(500)] + [999_999] * 400,
        "one": [7],
        "none": [1, 2, 3],
    }
    want = {"even": 150, "ties": 10, "outliers": 40, "one": 1, "none": 0}
    rows = [(g, s, i) for g, v in groups.items() for i, s in enumerate(v)]
    scored = spark.createDataFrame(rows, "g string, score long, key long").repartition(7)
    sizes = spark.createDataFrame(list(want.items()), "g string, k long")
    got = {}
    for r in RT.lowest(scored, sizes, ["g"], "score", "k").collect():
        got.setdefault(r.g, []).append(r.score)
    for g, v in groups.items():
        k, have = want[g], sorted(got.get(g, []))
        assert have[:k] == sorted(v)[:k], g
        border = sorted(v)[k - 1] if k else None
        # not many more rows than asked for come along, but for those of one score
        assert len(have) <= k + max(k // 4, v.count(border) if k else 0) + 1, (g, len(have))


@pytest.mark.parametrize("parts", [None, 5])
def test_weighted_draws(spark, parts):
    weights = {i: w for i, w in enumerate([0.0, 3.0, None, 0.5, -2.0, 80.0, 0.0, 1.25] + [0.01] * 40)}
    items = spark.createDataFrame(list(weights.items()), "id long, w double").repartition(4)
    n = 20_000
    drawn = SP.weighted_sample(items, n, "w", seed=5, per_task=700, num_partitions=parts)
    assert drawn.select("j").distinct().count() == drawn.count() == n
    got = {r.drawn_id: r["count"] for r in drawn.groupBy("drawn_id").count().collect()}
    total = sum(w for w in weights.values() if w and w > 0)
    for i, w in weights.items():
        share = got.get(i, 0) / n
        if not w or w <= 0:
            assert i not in got
        else:
            assert abs(share - w / total) < 4 * (w / total / n) ** 0.5 + 1e-4, (i, share)
    again = {(r.j, r.drawn_id) for r in SP.weighted_sample(items.repartition(2), 500, "w", seed=5).collect()}
    assert again == {(r.j, r.drawn_id) for r in drawn.where("j < 500").collect()}  # the same draws however they are dealt


def test_no_weight_no_draw(spark):
    assert SP.weighted_sample(spark.createDataFrame([(1, 0.0), (2, None)], "id long, w double"), 10, "w").count() == 0
    with pytest.raises(ValueError, match="smaller scale"):
        SP.weighted_sample(spark.createDataFrame([(1, 4e12), (2, 4e12)], "id long, w double"), 10, "w")


def test_incremental_loads_and_broken_ones(spark):
    path = scratch_path(spark, "t-increments")
    frame = lambda rows: spark.createDataFrame(rows, "id long, v string")
    assert IN.incremental_load(frame([(1, "a"), (2, "b"), (2, "a"), (None, "x")]), path, "id") == 2
    # a load that breaks: its rows are neither seen nor in the way
    bad = frame([(3, "c")]).withColumn("v", F.expr("CASE WHEN id = 3 THEN raise_error('broken') ELSE v END").cast("string"))
    with pytest.raises(Exception, match="broken"):
        IN.incremental_load(bad, path, "id")
    schema = frame([]).schema
    assert sorted(map(tuple, IN.loaded(spark, path, schema).collect())) == [(1, "a"), (2, "a")]
    assert IN.incremental_load(frame([(1, "z"), (3, "c")]), path, "id") == 1
    assert IN.incremental_load(frame([(1, "z"), (3, "c")]), path, "id") == 0
    assert sorted(map(tuple, IN.loaded(spark, path, schema).collect())) == [(1, "a"), (2, "a"), (3, "c")]


def test_empty_folder_is_an_empty_target(spark):
    path = scratch_path(spark, "t-empty")
    fs, p = IN._hadoop(spark, path)
    fs.mkdirs(p)
    assert IN.is_empty_target(spark, path)
    assert IN.idempotent_load(spark.range(3), path) and not IN.idempotent_load(spark.range(4), path)
    assert spark.read.parquet(path).count() == 3


def test_upsert_touches_its_shards_only(spark):
    import uuid

    from sluice.operators import merge as M
    from sluice.sources import bindings as B
    from tests.conftest import SF0001

    name, path = f"t_results_{uuid.uuid4().hex}", scratch_path(spark, "t-results")
    base = B.model_results(spark, SF0001)
    M.create_result_table(base, name, path)
    files = lambda: set(spark.table(name).inputFiles())
    before, rows = files(), B.incoming_results(spark, SF0001)
    one = rows.where(F.col("question_id") == rows.select(F.min("question_id")).first()[0])
    merged = M.merged_shards(spark, name, one)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    stored = [x for x in plan.split("\n") if name in x]
    assert len(stored) == 1 and "Bucketed: true" in stored[0] and "PartitionFilters: [isnotnull(shard" in stored[0]
    # the stored side reaches the join without an exchange
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if name in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, need = [], depth(lines[at])
    for x in reversed(lines[:at]):
        if depth(x) < need:
            above.append(x)
            need = depth(x)
    assert not any("Exchange" in x.split("[")[0] for x in above[: next(i for i, x in enumerate(above) if "Join" in x)])
    M.upsert_result_table(spark, name, one)
    kept = before & files()
    shard = lambda x: x.split("shard=")[1].split("/")[0]
    assert {shard(x) for x in before - kept} == {shard(x) for x in files() - kept} and len({shard(x) for x in files() - kept}) == 1
    M.upsert_result_table(spark, name, rows)
    want, got = M.upsert_results(base, rows), spark.table(name).select(*M.RESULT_COLS)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    spark.sql(f"DROP TABLE {name}")


def test_requests_come_by_conversation_and_turn(spark):
    from sluice.operators import merge as M

    todo = spark.createDataFrame([("10:0", 10, 0), ("2:10", 2, 10), ("9:1", 9, 1), ("2:2", 2, 2)], "id string, conv_id long, turn int")
    assert [r.id for r in M.limit_requests(todo, 3).collect()] == ["2:2", "2:10", "9:1"]


def test_sketched_quartiles_and_histograms(spark):
    from sluice.operators import quantiles as KQ

    draw = random.Random(9)
    rows = [("even", draw.random() * 100) for _ in range(30_000)] + [("skewed", draw.expovariate(1) ** 3) for _ in range(30_000)]
    rows += [("same", 4.0)] * 1000 + [("few", float(i)) for i in range(5)] + [("few", None), ("few", float("nan")), ("none", None)]
    log = spark.createDataFrame(rows, "g string, v double").repartition(12)
    whole = KQ.sketches(log, "v", ["g"])
    parts = KQ.merged(KQ.sketches(log.withColumn("part", F.spark_partition_id() % 5), "v", ["g", "part"]), ["g"])
    for found in (whole, parts):
        found = KQ.write_table(found, "t-sketches")
        boxes = {r.g: r for r in KQ.box(found, ["g"]).collect()}
        assert set(boxes) == {"even", "skewed", "same", "few"} and boxes["few"].n == 5 and boxes["few"].lo == 0.0 and boxes["few"].hi == 4.0
        assert boxes["few"].median == 2.0 and boxes["same"].q1 == boxes["same"].q3 == 4.0
        for r in KQ.rank_errors(log, "v", KQ.box(found, ["g"]), ["g"]).collect():
            assert max(r.q1_error, r.median_error, r.q3_error) < 0.01, r
        hist = {}
        for r in KQ.histogram(found, ["g"], 8).collect():
            hist.setdefault(r.g, {})[r.bucket] = r
        for g in ("even", "skewed"):
            mine = [v for k, v in rows if k == g]
            lo, hi = min(mine), max(mine)
            assert abs(sum(r.n for r in hist[g].values()) - len(mine)) <= 8
            for b, r in hist[g].items():
                exact = sum(1 for v in mine if min(int((v - lo) * 8 / (hi - lo)), 7) + 1 == b)
                assert abs(r.n - exact) <= 0.02 * len(mine), (g, b)


def test_intermediate_tables_go_with_the_application(tmp_path):
    """A session of its own leaves nothing in the checkpoint folder but what Spark itself keeps there."""
    import os
    import subprocess
    import sys

    code = f"""
from sluice.session import get_spark, write_table, scratch_path
spark = get_spark('local[2]')
spark.sparkContext.setCheckpointDir({str(tmp_path)!r})
t = write_table(spark.range(10), 'numbers')
print(t.count(), t.inputFiles()[0])
spark.stop()
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    n, file = out.stdout.split()
    assert n == "10" and str(tmp_path) in file
    assert not os.path.exists(file.removeprefix("file://"))
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
