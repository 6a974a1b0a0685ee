"""Plan shape checks: broadcasts of fixed dimensions, pruned scans, no single-partition exchanges."""

from sluice.operators import access as A
from sluice.sources import bindings as B
from tests.conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_model_fanout_broadcasts_the_catalogue(spark):
    import __spark_entry__ as E

    p = _plan(E.queries()["model_fanout"](spark, SF0001))
    assert "BroadcastNestedLoopJoin" in p or "BroadcastExchange" in p


def test_summary_scan_is_pruned(spark):
    import __spark_entry__ as E

    p = _plan(E.queries()["questions_summary"](spark, SF0001))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in p
    assert "n_chars" not in p


def test_access_plans_have_no_single_partition_exchange(spark):
    log = B.access_log(spark, SF0001)
    s = A.sequence_log(log)
    for df in (A.reuse_distance(s), A.ttl_hits_sliding(s, 3600), A.fixed_ttl_anchors(log, 3600)):
        assert "SinglePartition" not in _plan(df)


def test_every_query_has_an_oracle():
    from sluice.plans import registry

    registry.load_all()
    assert set(registry.ORACLES) == set(registry.QUERIES)


def test_no_texts_and_no_jobs_for_flags(spark):
    """Queries without texts read none, and building plans runs nothing over the data."""
    import __spark_entry__ as E

    for name in ("processed_flag", "union_workload", "mode_class"):
        assert "text:string" not in _plan(E.queries()[name](spark, SF0001))


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.columns == ["model_name", "model_provider", "total_answers", "avg_quality_score",
                          "avg_response_time", "cost_tier", "high_quality_answers"]
    assert df.count() >= 0
