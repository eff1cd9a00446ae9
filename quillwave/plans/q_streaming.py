"""Streaming queries: the tables as streams, run until nothing is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillwave.plans import inputs
from quillwave.streaming import jobs


def stream_windowed_scores(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.windowed_scores(jobs.source(spark, f"{d}/predictions.parquet")), ["run_id", "week_start"])


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.positive_sessions(jobs.source(spark, f"{d}/predictions.parquet"), 3000, 8000), ["run_id", "filename", "start_ms", "end_ms"], mode="complete")


QUERIES = {q.__name__: q for q in (stream_windowed_scores, stream_sessions)}

_USABLE = "CASE WHEN prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 THEN CAST(round(prob * 10000) AS INTEGER) END"
SQL = {
    "stream_windowed_scores": f"""SELECT run_id, epoch_us(written_at) // 604800000000 * 604800 AS week_start, count(*) AS n, count(u) AS n_usable, CAST(sum(u) AS BIGINT) AS units
FROM (SELECT run_id, written_at, {_USABLE} AS u FROM predictions WHERE written_at IS NOT NULL) GROUP BY ALL""",
    "stream_sessions": f"""WITH positives AS (SELECT run_id, lower(trim(filename)) AS filename, CAST(round(window_start_sec * 1000) AS BIGINT) AS start_ms, CAST(round(window_start_sec * 1000) AS BIGINT) + 4000 AS end_ms
  FROM predictions WHERE {_USABLE} >= 3000 AND isfinite(window_start_sec) AND filename IS NOT NULL),{inputs.merged("positives", "merged", "run_id, filename", 8000)}
SELECT run_id, filename, start_ms, end_ms, n AS n_rows FROM merged""",
}
