"""Queries p2 (small files) and p4 (intervals), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.operators.compaction import committed, compact
from quillwave.operators.intervals import coverage
from quillwave.semantics import millis, normal
from quillwave.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the consolidated part files, once."""
    return committed(spark, compact(table(spark, d, "part_files"))).select("filename", "start_ms")


def p2_bins(spark: SparkSession, d: str) -> DataFrame:
    """What the consolidated files hold of each recording: records, span and positives."""
    files = committed(spark, compact(table(spark, d, "part_files")))
    return files.groupBy("filename").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("start_ms").alias("first_ms"), F.max("start_ms").alias("last_ms"), F.sum(F.coalesce("label", F.lit(0))).cast("long").alias("n_positive")
    )


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """One row per file of a consolidation into small bins (64 KiB of text): its bin, recordings, records and text lines."""
    files = committed(spark, compact(table(spark, d, "part_files"), target=64 << 10)).withColumn("file", F.col("_metadata.file_name"))
    return files.groupBy("bin", "file").agg(F.count_distinct("filename").alias("n_recordings"), F.count(F.lit(1)).alias("n_records"), F.sum("versions").alias("n_lines")).drop("file")


def event_windows(windows: DataFrame) -> DataFrame:
    """(filename, seizure_event_id, start_ms, end_ms) of the rows that belong to an event of their own recording."""
    rows = windows.select(
        normal("filename").alias("filename"),
        normal("seizure_event_id").alias("seizure_event_id"),
        millis("window_start_sec").alias("start_ms"),
        millis(F.coalesce(F.nanvl("window_sec", F.lit(None).cast("double")), F.lit(4.0))).alias("length_ms"),
    )
    rest = F.expr("substring(seizure_event_id, length(filename) + 1)")
    own = F.col("seizure_event_id").startswith(F.col("filename")) & rest.rlike(r"^_sz\d+$")
    return rows.where(own & F.col("start_ms").isNotNull()).select("filename", "seizure_event_id", "start_ms", (F.col("start_ms") + F.col("length_ms")).alias("end_ms"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of every event and the gaps between them."""
    rows = event_windows(table(spark, d, "windows"))
    return coverage(rows, ["filename", "seizure_event_id"], "start_ms", "end_ms")


QUERIES = {"p2_found": p2_found, "p2_bins": p2_bins, "p2_files": p2_files, "p4_found": p4_found}

_LINES = r"""
WITH lines AS (
  SELECT lower(trim(filename, ' ' || chr(9) || chr(10) || chr(13))) AS filename, written_at, attempt, part_id,
         trim(unnest(regexp_split_to_array(body, '\r\n|\n|\r'))) AS line
  FROM part_files WHERE body IS NOT NULL),
fields AS (
  SELECT filename, written_at, attempt, part_id,
    CASE WHEN line LIKE '{%' THEN regexp_extract(line, '^\{"window_start_sec": ([-+0-9.eE]+), "label": [-+0-9.eE]+, "fp1_f7__mean": (?:null|[-+0-9.eE]+)\}$', 1)
         ELSE regexp_extract(line, '^([-+0-9.eE]+)[,;][^,;]+[,;][-+0-9.eE]*$', 1) END AS start,
    CASE WHEN line LIKE '{%' THEN regexp_extract(line, '"label": ([-+0-9.eE]+),', 1)
         ELSE regexp_extract(line, '^[-+0-9.eE]+[,;]([^,;]+)[,;]', 1) END AS label
  FROM lines),
records AS (
  SELECT filename, CAST(round(CAST(start AS DOUBLE) * 1000) AS BIGINT) AS start_ms,
         CAST(CAST(label AS DOUBLE) AS INTEGER) AS label, written_at, attempt, part_id
  FROM fields WHERE start <> ''),
kept AS (
  SELECT * FROM records
  QUALIFY row_number() OVER (PARTITION BY filename, start_ms ORDER BY written_at DESC NULLS LAST, attempt DESC NULLS LAST, part_id DESC, label DESC NULLS LAST) = 1)
"""

SQL = {
    "p2_found": _LINES + "SELECT filename, start_ms FROM kept",
    "p2_bins": _LINES + """SELECT filename, count(*) AS n_records, min(start_ms) AS first_ms, max(start_ms) AS last_ms,
        CAST(sum(coalesce(label, 0)) AS BIGINT) AS n_positive FROM kept GROUP BY filename""",
    "p4_found": r"""
WITH rows AS (
  SELECT lower(trim(filename)) AS filename, lower(trim(seizure_event_id)) AS seizure_event_id,
    CAST(round(window_start_sec * 1000) AS BIGINT) AS s,
    CAST(round(window_start_sec * 1000) AS BIGINT) + CAST(round(coalesce(CASE WHEN isnan(window_sec) THEN NULL ELSE window_sec END, 4.0) * 1000) AS BIGINT) AS e
  FROM windows WHERE window_start_sec IS NOT NULL AND isfinite(window_start_sec)),
own AS (
  SELECT * FROM rows WHERE e > s AND starts_with(seizure_event_id, filename)
    AND regexp_full_match(substr(seizure_event_id, length(filename) + 1), '_sz[0-9]+')),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY filename, seizure_event_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
  FROM own),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY filename, seizure_event_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
periods AS (SELECT filename, seizure_event_id, min(s) AS s, max(e) AS e FROM numbered GROUP BY filename, seizure_event_id, k),
gaps AS (SELECT filename, seizure_event_id, e AS s, lead(s) OVER (PARTITION BY filename, seizure_event_id ORDER BY s) AS e FROM periods)
SELECT filename, seizure_event_id, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
UNION ALL SELECT filename, seizure_event_id, 'gap', s, e FROM gaps WHERE e IS NOT NULL""",
}
