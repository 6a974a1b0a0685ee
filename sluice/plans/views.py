"""SQL surface: the summary views and the stats table function.

The views are the library's own frames under their SQL names, so Spark SQL and
the DataFrame API give the same rows; the table function reads a one-row view.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sluice.operators import summaries as SM
from sluice.sources import bindings as B


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temp views ``questions``, ``multi_model_results``, ``questions_summary`` and ``model_comparison``."""
    questions, results = B.counted_questions(spark, sf_dir), B.model_results(spark, sf_dir)
    for name, df in (("questions", questions), ("multi_model_results", results),
                     ("questions_summary", SM.questions_summary(questions)), ("model_comparison", SM.model_comparison(results))):
        df.createOrReplaceTempView(name)


def register_stats_function(spark: SparkSession, sf_dir: str) -> None:
    """``get_questions_stats()``: the one stats row as a SQL table function."""
    stats = SM.questions_stats(B.counted_questions(spark, sf_dir))
    stats.createOrReplaceTempView("questions_stats")
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION get_questions_stats() RETURNS TABLE ({columns}) RETURN SELECT * FROM questions_stats")
