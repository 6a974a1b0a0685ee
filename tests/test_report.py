"""The reference's published 15 configurations as a static fixture (tests only)."""

from sluice.operators import report as R

# hit rate, miss rate, evictions, avg hit ms, avg miss ms, efficiency (report of 2025-09-30)
PUBLISHED = [
    ("LRU", 10, 0.25, 99.75, 9965, 0.10, 0.11, 0.25), ("LRU", 100, 1.69, 98.31, 9740, 0.09, 0.09, 1.69),
    ("LRU", 500, 9.27, 90.73, 8600, 0.12, 0.11, 9.27), ("LRU", 1000, 18.47, 81.53, 7200, 0.13, 0.13, 18.47),
    ("LRU", 2000, 34.14, 65.86, 4600, 0.10, 0.10, 34.14), ("TTL", 10, 0.28, 99.72, 9962, 0.19, 0.21, 0.28),
    ("TTL", 100, 1.83, 98.17, 9720, 0.15, 0.16, 1.83), ("TTL", 500, 9.60, 90.40, 8550, 0.09, 0.11, 9.60),
    ("TTL", 1000, 17.60, 82.40, 7300, 0.10, 0.11, 17.60), ("TTL", 2000, 34.01, 65.99, 4600, 0.08, 0.09, 34.01),
    ("TTL-LRU", 10, 0.15, 99.85, 9975, 0.17, 0.21, 0.15), ("TTL-LRU", 100, 1.90, 98.10, 9710, 0.14, 0.17, 1.90),
    ("TTL-LRU", 500, 9.74, 90.26, 8550, 0.10, 0.12, 9.74), ("TTL-LRU", 1000, 17.51, 82.49, 7300, 0.10, 0.12, 17.51),
    ("TTL-LRU", 2000, 34.47, 65.53, 4600, 0.10, 0.11, 34.47),
]
SCHEMA = ("policy string, cache_size int, hit_rate_percent double, miss_rate_percent double, evictions long, "
          "avg_hit_time_ms double, avg_miss_time_ms double, cache_efficiency double")


def test_best_configs_match_published(spark):
    m = spark.createDataFrame(PUBLISHED, SCHEMA)
    b = R.best_configs(m).first()
    assert (b.best_hit_rate_config, b.best_hit_rate) == ("TTL-LRU_size_2000", 34.47)
    # three-way tie at 4600: the first configuration in grid order wins
    assert (b.fewest_evictions_config, b.fewest_evictions) == ("LRU_size_2000", 4600)
    assert (b.best_efficiency_config, b.best_efficiency) == ("TTL-LRU_size_2000", 34.47)
    lines = [r.text for r in R.best_lines(m).orderBy("line").collect()]
    assert lines == ["Mejor Hit Rate: TTL-LRU_size_2000 (34.47%)", "Menores Evictions: LRU_size_2000 (4600 evictions)",
                     "Mejor Eficiencia: TTL-LRU_size_2000 (34.47%)"]


def test_report_lines_and_pivot(spark):
    m = spark.createDataFrame(PUBLISHED, SCHEMA)
    first = [r.text for r in R.report_rows(m).limit(8).collect()]
    assert first[:7] == ["  Tamaño 10:", "    Hit Rate: 0.25%", "    Miss Rate: 99.75%", "    Evictions: 9965",
                         "    Tiempo promedio hit: 0.10ms", "    Tiempo promedio miss: 0.11ms",
                         "    Eficiencia cache: 0.25%"]
    pv = {r.cache_size: (r["LRU"], r["TTL"], r["TTL-LRU"]) for r in R.pivot_metric(m, "evictions").collect()}
    assert pv[2000] == (4600, 4600, 4600) and pv[10] == (9965, 9962, 9975)
