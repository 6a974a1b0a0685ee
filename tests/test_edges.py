"""Hand-made edge fixtures (FIXTURES.md section C)."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from sluice.functions import predicates as P
from sluice.functions import text as X
from sluice.operators import access as A
from sluice.operators import retention as RT
from sluice.operators import scoring as SC
from sluice.operators import summaries as SM
from sluice import schemas as S
from sluice.schemas import models_dim


def test_categorize_priority_and_substrings(spark):
    df = spark.createDataFrame([("How to define a concept", ""), ("I am happy", None), ("plain", "words")],
                               "t string, c string")
    got = [r[0] for r in df.select(X.categorize_text(F.col("t"), F.col("c"))).collect()]
    assert got == ["how_to", "technology", "general"]


def test_keywords_strip_after_filter(spark):
    df = spark.createDataFrame([("the, ???? with which words words Extra Sixth Seventh",)], "x string")
    kw = df.select(X.extract_keywords(F.col("x"))).first()[0]
    # 'the,' is longer than 3 and not a stop word before stripping; '????' strips to ''
    assert kw == ["the", "", "words", "words", "extra"]


def test_topic_fallback_and_token_count(spark):
    df = spark.createDataFrame([("a bb ccc",), ("  Hello, world",), ("",)], "x string")
    got = df.select(X.extract_topic(F.col("x")).alias("t"), X.token_count(F.col("x")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("tema", 3), ("hello,", 2), ("tema", 0)]


def test_content_key_strip_and_trailing_pipe(spark):
    import hashlib

    df = spark.createDataFrame([("  title\t", ""), ("t", None), ("t", " x\n")], "t string, c string")
    got = [r[0] for r in df.select(X.content_key(F.col("t"), F.col("c"))).collect()]
    want = [hashlib.sha256(f"{t}|{c or ''}".strip().encode()).hexdigest() for t, c in
            [("  title\t", ""), ("t", None), ("t", " x\n")]]
    assert got == want


def test_falsy_default(spark):
    df = spark.createDataFrame([(None, None), (0.0, ""), (2.5, "x")], "s double, a string")
    got = df.select(P.falsy_default(F.col("s"), 2.0).alias("s"),
                    P.falsy_default(F.col("a"), "d", "text").alias("a")).collect()
    assert [(r.s, r.a) for r in got] == [(2.0, "d"), (2.0, "d"), (2.5, "x")]


def test_summary_null_and_minus_one_classes(spark):
    rows = [(1, "a", "", None, None, 0.0, 1, None), (2, "b", "", None, "", 2.5, 3, -1),
            (3, "c", "", None, "x", 2.5, 2, 5), (4, "d", "", None, None, None, 1, 5)]
    q = spark.createDataFrame(rows, "id long, question_title string, question_content string, original_answer string,"
                                    " llm_answer string, quality_score double, access_count int, original_class int")
    got = sorted(tuple(r) for r in SM.questions_summary(q).collect())
    # NULL and a real -1 stay two groups, both shown as -1; '' counts as processed
    assert got == [(-1, 1, 0, None, 1), (-1, 1, 1, 2.5, 3), (5, 2, 1, 2.5, 2)]


def test_best_model_tie_goes_to_catalogue_order(spark):
    r = spark.createDataFrame([(1, "mistral-nemo", "a", 2.5), (1, "gpt-4o-mini", "b", 2.5), (1, "gpt-4o", "c", 2.4)],
                              "question_id long, model_name string, answer string, quality_score double")
    best = SC.best_model_per_question(r, models_dim(spark)).first()
    assert (best.best_model, best.best_score) == ("gpt-4o-mini", 2.5)


def _log(spark, times):
    base = dt.datetime(2024, 1, 1)
    rows = [("i", 1, base + dt.timedelta(microseconds=us), n, 1.0, False) for n, us in enumerate(times)]
    return spark.createDataFrame(rows, "instance string, key long, ts timestamp_ntz, seq long, op_ms double, is_error boolean")


def test_ttl_boundaries(spark):
    ttl = 10  # seconds
    T = ttl * 1_000_000
    # gaps: TTL - 1us (hit), exactly TTL (miss), TTL + 1us (miss), 0 (hit)
    times = [0, T - 1, 2 * T - 1, 3 * T, 3 * T]
    log = _log(spark, times)
    s = A.sequence_log(log)
    sliding = [r.hit for r in A.ttl_hits_sliding(s, ttl).orderBy("seq").collect()]
    assert sliding == [False, True, False, False, True]
    fixed = {r.seq for r in A.fixed_ttl_anchors(log, ttl).collect()}
    # anchors: 0; T-1 is within TTL of 0 -> hit; 2T-1 >= 0+T -> anchor; 3T >= 2T-1+T -> anchor
    assert fixed == {0, 2, 3}


def test_evict_floor_variant_removes_none_below_ten(spark):
    snap = spark.createDataFrame([("LRU", "i", k, -1) for k in range(5)], "policy string, instance string, key long, ttl long")
    assert RT.evict_candidates(snap, cap=3, min_one=False).count() == 0
    assert RT.evict_candidates(snap, cap=3, min_one=True).count() == 1


def test_empty_input_metrics(spark):
    empty = spark.createDataFrame([], "instance string, key long, ts timestamp_ntz, seq long, op_ms double, is_error boolean")
    s = A.sequence_log(empty)
    assert A.reuse_distance(s, block=64).count() == 0
    curve = A.hit_rate_curve(s, A.reuse_distance(s, block=64), [10]).collect()
    assert [(r.accesses, r.hits, r.hit_rate_percent) for r in curve] == [(0, 0, 0.0)]


def test_csv_edge_cases(spark, tmp_path):
    from sluice.sources.ingest import csv_headerless_scan

    p = tmp_path / "raw.csv"
    p.write_text('1,"a, b","say ""hi""","line1\nline2"\n,NA,null,None\n3,"",x,\n', encoding="utf-8")
    rows = csv_headerless_scan(spark, str(p)).collect()
    assert tuple(rows[0]) == (1, "a, b", 'say "hi"', "line1\nline2")
    assert tuple(rows[1]) == (None, None, None, None)
    assert tuple(rows[2]) == (3, None, "x", None)


def test_content_key_strips_unicode_blanks(spark):
    import hashlib

    t = "  title "
    df = spark.createDataFrame([(t, "")], "t string, c string")
    got = df.select(X.content_key(F.col("t"), F.col("c"))).first()[0]
    assert got == hashlib.sha256(f"{t}|".strip().encode()).hexdigest()


def test_stats_ties_pick_smallest_class_and_id(spark):
    rows = [(3, "b", 5), (1, "a", 5), (2, "c", 7), (4, "d", 7)]
    q = spark.createDataFrame([(i, t, "", None, None, None, n, c) for (i, t, c), n in zip(rows, [2, 2, 1, 1])],
                              "id long, question_title string, question_content string, original_answer string,"
                              " llm_answer string, quality_score double, access_count int, original_class int")
    r = SM.questions_stats(q).first()
    # classes 5 and 7 both appear twice -> 5; titles 'a' (id 1) and 'b' (id 3) share the max count -> id 1
    assert (r.top_class, r.most_accessed_question, r.total_questions) == (5, "a", 4)


def test_anti_join_ignores_null_question_id(spark):
    from sluice.operators import merge as M

    q = spark.createDataFrame([(1,), (2,)], "id long")
    res = spark.createDataFrame([(None, "gpt-4o"), (2, "gpt-4o")], "question_id long, model_name string")
    assert sorted(r.id for r in M.anti_unprocessed(q, res).collect()) == [1]


def test_reuse_distance_one_key_distinct_keys_and_tied_times(spark):
    # one key only: every re-access has distance 0
    s = A.sequence_log(_log(spark, [0, 5, 5, 9]))
    assert [r.reuse_distance for r in A.reuse_distance(s, block=64).orderBy("seq").collect()] == [0, 0, 0]
    # all keys distinct: no re-access at all
    base = dt.datetime(2024, 1, 1)
    rows = [("i", k, base, k, 1.0, False) for k in range(6)]
    s2 = A.sequence_log(spark.createDataFrame(rows, "instance string, key long, ts timestamp_ntz, seq long, op_ms double, is_error boolean"))
    assert A.reuse_distance(s2, block=64).count() == 0


def test_access_metrics_on_empty_log(spark):
    empty = spark.createDataFrame([], "instance string, key long, ts timestamp_ntz, seq long, op_ms double, is_error boolean")
    m = A.access_metrics(A.access_flags(empty, 3600), ["LRU", "TTL-LRU"], [10, 100]).collect()
    assert len(m) == 4
    assert all(r.total_operations == 0 and r.hit_rate_percent == 0.0 and r.evictions == 0 for r in m)


def test_question_keys_of_long_conversations(spark, tmp_path):
    from sluice.sources import bindings as B

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c, turns in ((1, 1003), (2, 4)) for t in range(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    qa = B.qa_pairs(spark, str(tmp_path)).collect()
    assert len({r.id for r in qa}) == len(qa) == 502 + 2
    assert {r.id: r.answer for r in qa}["1:1000"] == "text 1 1001" and {r.id: r.answer for r in qa}["1:1002"] is None


def test_upsert_keeps_rows_with_null_keys_apart(spark):
    from sluice.operators import merge as M

    schema = "question_id string, model_name string, model_provider string, answer string, quality_score double, response_time double, cost_tier string, created_at timestamp_ntz"
    at = dt.datetime(2024, 1, 1)
    row = lambda q, a: (q, "m", "p", a, 1.0, 1.0, "c", at)
    old = spark.createDataFrame([row("1", "old"), row(None, "kept")], schema)
    new = spark.createDataFrame([row("1", "new"), row(None, "a"), row(None, "b")], schema)
    assert sorted((str(r.question_id), r.answer) for r in M.upsert_results(old, new).collect()) == [("1", "new"), ("None", "a"), ("None", "b"), ("None", "kept")]


def test_question_upsert_keeps_timestamps_and_arrival_order(spark):
    from sluice.operators import merge as M

    t0, now = dt.datetime(2023, 1, 1), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    old = spark.createDataFrame([(5, "a", "", None, "x", 1.0, 1, 7, t0, t0, t0, t0), (6, "b", None, None, None, None, 1, None, t0, t0, t0, t0)], S.QUESTIONS_SCHEMA)
    rec = spark.createDataFrame([("z", "", "o", "n1", None, "1:02"), ("y", "", "o", "n2", None, "1:01"), ("b", None, "o", "", 2.0, "1:03")],
                                "question_title string, question_content string, original_answer string, llm_answer string, quality_score double, seq string")
    got = {r.question_title: r for r in M.upsert_questions(old, rec, now).collect()}
    assert (got["y"].id, got["z"].id) == (7, 8)  # by arrival, not by title
    assert got["a"].updated_at == got["a"].created_at == got["b"].created_at == t0
    assert got["b"].updated_at.year == 2024 and got["b"].access_count == 2 and got["b"].quality_score == 2.0 and got["b"].llm_answer is None


def test_unreadable_target_is_not_overwritten(spark, tmp_path):
    from sluice.sources import ingest as IN

    target = tmp_path / "target"
    assert IN.is_empty_target(spark, str(target))
    target.mkdir()
    (target / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        IN.idempotent_load(spark.range(3), str(target))
    assert (target / "part-0.parquet").read_bytes() == b"not parquet"


def test_ratios_of_large_counts(spark):
    from sluice.functions.numeric import round_ratio

    df = spark.createDataFrame([(10**7 * 10**6, 3 * 10**12)], "n long, d long")
    assert df.select(round_ratio(F.col("n"), F.col("d"), 6)).first()[0] == 3.333333


def test_exact_number_of_draws(spark):
    from sluice.operators import sampling as SP

    assert SP.sample_with_replacement(spark.range(7), 1234).count() == 1234
    assert SP.sample_with_replacement(spark.range(0), 10).count() == 0


def test_limits_that_bind(spark):
    from sluice.operators import merge as M
    from sluice.sources import ingest as IN

    assert [r.id for r in IN.load_row_limit(spark.range(100).repartition(7), 3, ["id"]).orderBy("id").collect()] == [0, 1, 2]
    todo = M.anti_unprocessed(spark.range(10), spark.createDataFrame([(2,), (None,)], "question_id long"))
    assert M.limit_requests(todo, 4).collect() == [(0, 9), (1, 9), (3, 9), (4, 9)]
