"""Golden values of the access-log analytics on the sf0.01 events table."""

from pyspark.sql import functions as F

from sluice.operators import access as A
from sluice.sources import bindings as B
from tests.conftest import SF001


def test_sliding_ttl_hits(spark):
    s = A.sequence_log(B.access_log(spark, SF001))
    got = {h: A.ttl_hits_sliding(s, h * 3600).filter("hit").count() for h in (6, 24, 72)}
    assert got == {6: 1036, 24: 3560, 72: 7060}


def test_fixed_ttl_misses(spark):
    log = B.access_log(spark, SF001)
    m = A.fixed_ttl_anchors_multi(log, [6 * 3600, 24 * 3600, 72 * 3600]).groupBy("ttl_seconds").count().collect()
    assert {int(r["ttl_seconds"] // 3600): r["count"] for r in m} == {6: 9017, 24: 6930, 72: 4423}


def test_reuse_distance_distribution(spark):
    s = A.sequence_log(B.access_log(spark, SF001))
    d = A.reuse_distance(s)
    r = d.agg(F.count("*").alias("n"), F.min("reuse_distance").alias("lo"), F.max("reuse_distance").alias("hi"),
              F.count_if(F.col("reuse_distance") < 10).alias("lt10"),
              F.count_if(F.col("reuse_distance") < 50).alias("lt50"),
              F.count_if(F.col("reuse_distance") < 100).alias("lt100")).first()
    assert (r.n, r.lo, r.hi, r.lt10, r.lt50, r.lt100) == (9250, 0, 149, 655, 3337, 6466)


def test_stream_fixed_ttl_equals_batch(spark):
    from sluice.streaming import streams as ST

    out = ST.scratch(spark, "test-fixed")
    ST.run_to_parquet(ST.fixed_ttl_flags(ST.access_stream(spark, SF001), 6 * 3600), out)
    misses = spark.read.parquet(f"{out}/batch_id=*").filter(~F.col("hit")).count()
    assert misses == 9017


def test_stream_counts_equal_batch(spark):
    from sluice.streaming import streams as ST

    out = ST.scratch(spark, "test-counts")
    ST.run_to_parquet(ST.access_counts(ST.access_stream(spark, SF001)), out, "update")
    got = ST.latest_counts(spark.read.parquet(f"{out}/batch_id=*"))
    want = A.access_count_agg(B.access_log(spark, SF001))
    diff = got.select("instance", "key", "accesses").exceptAll(want.select("instance", "key", "accesses"))
    assert diff.count() == 0 and got.count() == want.count()
