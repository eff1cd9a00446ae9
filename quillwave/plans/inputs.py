"""What most queries start from, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.operators.records import prediction_records
from quillwave.plans.core_problems import event_windows
from quillwave.semantics import finite, millis, normal
from quillwave.tables import table


def records(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, filename, start_ms, units, split, subject, grid, label)."""
    return prediction_records(table(spark, d, "predictions"), extra=True)


def files(spark: SparkSession, d: str) -> DataFrame:
    """(filename, duration_sec, n_samples) of each recording."""
    rows = table(spark, d, "recordings").select(normal("filename").alias("filename"), finite("duration_sec").alias("duration_sec"))
    one = rows.dropna().groupBy("filename").agg(F.max("duration_sec").alias("duration_sec"))
    return one.withColumn("n_samples", F.floor(F.col("duration_sec") * 256).cast("long"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """(filename, idx, start_ms, end_ms): the span of each labelled event."""
    rows = event_windows(table(spark, d, "windows")).where("end_ms > start_ms")
    spans = rows.groupBy("filename", "seizure_event_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return spans.select("filename", F.regexp_extract("seizure_event_id", r"_sz(\d+)$", 1).cast("int").alias("idx"), "start_ms", "end_ms")


def window_spans(spark: SparkSession, d: str) -> DataFrame:
    """(filename, start_ms, end_ms) of each distinct window of the feature table."""
    length = millis(F.coalesce(F.nanvl("window_sec", F.lit(None).cast("double")), F.lit(4.0)))
    rows = table(spark, d, "windows").select(normal("filename").alias("filename"), millis("window_start_sec").alias("start_ms"), length.alias("_n"))
    return rows.where("filename IS NOT NULL AND start_ms IS NOT NULL AND _n > 0").select("filename", "start_ms", (F.col("start_ms") + F.col("_n")).alias("end_ms")).distinct()


RECORDS = """
records AS (
  SELECT run_id, filename, start_ms, units, split, subject, grid, label FROM (
    SELECT run_id, lower(trim(filename)) AS filename, nullif(lower(trim(split)), '') AS split, nullif(lower(trim(subject_id)), '') AS subject,
      on_uniform_grid AS grid, CAST(label AS INTEGER) AS label, written_at, CAST(round(window_start_sec * 1000) AS BIGINT) AS start_ms,
      CASE WHEN prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 THEN CAST(round(prob * 10000) AS INTEGER) END AS units
    FROM predictions WHERE run_id IS NOT NULL AND filename IS NOT NULL AND window_start_sec IS NOT NULL AND isfinite(window_start_sec))
  QUALIFY row_number() OVER (PARTITION BY run_id, filename, start_ms ORDER BY written_at DESC NULLS LAST, units DESC NULLS LAST,
    split DESC NULLS LAST, subject DESC NULLS LAST, grid DESC NULLS LAST, label DESC NULLS LAST) = 1)"""

FILES = """
files AS (
  SELECT lower(trim(filename)) AS filename, max(duration_sec) AS duration_sec, CAST(floor(max(duration_sec) * 256) AS BIGINT) AS n_samples
  FROM recordings WHERE duration_sec IS NOT NULL AND isfinite(duration_sec) AND filename IS NOT NULL GROUP BY 1)"""

_ROWS = """SELECT lower(trim(filename)) AS filename, lower(trim(seizure_event_id)) AS event_id, CAST(round(window_start_sec * 1000) AS BIGINT) AS s,
    CAST(round(window_start_sec * 1000) AS BIGINT) + CAST(round(coalesce(CASE WHEN isnan(window_sec) THEN NULL ELSE window_sec END, 4.0) * 1000) AS BIGINT) AS e
  FROM windows WHERE filename IS NOT NULL AND window_start_sec IS NOT NULL AND isfinite(window_start_sec)"""

INTERVALS = f"""
intervals AS (
  SELECT filename, CAST(regexp_extract(event_id, '_sz([0-9]+)$', 1) AS INTEGER) AS idx, min(s) AS start_ms, max(e) AS end_ms
  FROM ({_ROWS}) WHERE e > s AND starts_with(event_id, filename) AND regexp_full_match(substr(event_id, length(filename) + 1), '_sz[0-9]+')
  GROUP BY filename, event_id)"""

SPANS = f"""
spans AS (SELECT DISTINCT filename, s AS start_ms, e AS end_ms FROM ({_ROWS}) WHERE e > s)"""


def merged(source: str, name: str, keys: str, gap: int) -> str:
    """SQL of a relation ``name`` (keys, start_ms, end_ms, n): ``merge_spans`` of ``source``."""
    return f"""
{name}_a AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS opens FROM {source}),
{name}_b AS (SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT {keys}, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM {name}_b GROUP BY {keys}, island)"""


def split(source: str, name: str, keys: str, longest: int) -> str:
    """SQL of ``split_long``."""
    return f"""
{name}_c AS (SELECT {keys}, start_ms AS s, end_ms AS e, unnest(generate_series(0, greatest(1, CAST(ceil((end_ms - start_ms) / {longest}.0) AS BIGINT)) - 1)) AS k FROM {source}),
{name} AS (SELECT {keys}, s + k * {longest} AS start_ms, least(e, s + (k + 1) * {longest}) AS end_ms FROM {name}_c)"""


def scored(rule, keys: list[str], refs: str, hyps: str, listed: str, name: str = "scored", tag: str = "") -> str:
    """SQL of ``scoring.score``: relation ``name`` (keys, tp, fp, ref_true); ``tag`` begins the names of the steps."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    raster = lambda src: f"""SELECT {", ".join(f"x.{c}" for c in keys)}, greatest(0, x.start_ms // 1000 * 1000) AS start_ms,
        least(greatest(1, CAST(round_even(l.duration_sec, 0) AS BIGINT)) * 1000, x.end_ms // 1000 * 1000) AS end_ms FROM {src} x JOIN (SELECT DISTINCT {k}, duration_sec FROM {listed}) l ON {on("x", "l")}"""  # noqa: E731
    ov = "least(r.end_ms, h.end_ms) - greatest(r.start_ms, h.start_ms)"
    op = ">" if rule.strict else ">="
    return f"""
{tag}ref_0 AS (SELECT * FROM ({raster(refs)}) WHERE start_ms < end_ms),{merged(f"{tag}ref_0", f"{tag}ref_1", k, rule.merge_ms - 1)},{split(f"{tag}ref_1", f"{tag}ref_2", k, rule.longest_ms)},
{tag}hyp_0 AS (SELECT * FROM ({raster(f"(SELECT * FROM {hyps} WHERE end_ms - start_ms > {rule.drop_upto_ms})")}) WHERE start_ms < end_ms),{merged(f"{tag}hyp_0", f"{tag}hyp_1", k, rule.merge_ms - 1)},{split(f"{tag}hyp_1", f"{tag}hyp_2", k, rule.longest_ms)},
{tag}wide AS (SELECT {k}, greatest(0, start_ms - {rule.before_ms}) AS start_ms, end_ms + {rule.after_ms} AS end_ms FROM {tag}ref_2),
{tag}found AS (SELECT {", ".join(f"r.{c}" for c in keys)}, r.start_ms, r.end_ms FROM {tag}wide r JOIN {tag}hyp_2 h ON {on("r", "h")} AND {ov} > 0
  GROUP BY ALL HAVING CAST(sum({ov}) AS DOUBLE) / (r.end_ms - r.start_ms) {op} {rule.least_overlap}),
{tag}alarms AS (SELECT {k} FROM {tag}hyp_2 r WHERE NOT EXISTS (SELECT 1 FROM {tag}found h WHERE {on("r", "h")} AND {ov} > 0)),
{name} AS (SELECT {", ".join(f"l.{c}" for c in keys)}, coalesce(t.n, 0) AS tp, coalesce(a.n, 0) AS fp, coalesce(r.n, 0) AS ref_true
  FROM (SELECT DISTINCT {k} FROM {listed}) l
  LEFT JOIN (SELECT {k}, count(*) AS n FROM {tag}found GROUP BY {k}) t ON {on("l", "t")}
  LEFT JOIN (SELECT {k}, count(*) AS n FROM {tag}alarms GROUP BY {k}) a ON {on("l", "a")}
  LEFT JOIN (SELECT {k}, count(*) AS n FROM {tag}ref_2 GROUP BY {k}) r ON {on("l", "r")})"""
