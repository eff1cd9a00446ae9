"""Scores to candidate events: thresholds, merging, dropping, splitting.

Spans are (start_ms, end_ms) per key columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS, LONGEST_MS = 4000, 300_000


def positives(records: DataFrame, units: int | str, keys: list[str]) -> DataFrame:
    """(keys, start_ms, end_ms) of the windows whose score is at or above the threshold."""
    at = F.col(units) if isinstance(units, str) else F.lit(units)
    return records.where(F.col("units") >= at).select(*keys, "start_ms", (F.col("start_ms") + WINDOW_MS).alias("end_ms"))


def merge_spans(spans: DataFrame, keys: list[str], gap: int | str) -> DataFrame:
    """One span per island: spans at most ``gap`` apart become one, inclusive. Overlap and nesting are fine.

    Also counts the spans in each, as ``n``.
    """
    g = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    before = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.when(F.col("start_ms") - before <= g, 0).otherwise(1))
    islands = opened.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))
    return merged.drop("_island")


def session_spans(spans: DataFrame, keys: list[str], gap_ms: int) -> DataFrame:
    """The same islands for spans of one window each, by Spark's own session windows."""
    ts = F.timestamp_millis("start_ms")
    found = spans.groupBy(*keys, F.session_window(ts, f"{gap_ms + WINDOW_MS} milliseconds").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.unix_millis("_s.start").alias("start_ms"), (F.unix_millis("_s.end") - gap_ms).alias("end_ms"), "n")


def drop_short(spans: DataFrame, least_ms: int) -> DataFrame:
    return spans.where(F.col("end_ms") - F.col("start_ms") >= least_ms)


def split_long(spans: DataFrame, longest_ms: int = LONGEST_MS) -> DataFrame:
    """Spans cut into stretches of exactly ``longest_ms`` and the rest."""
    length = F.col("end_ms") - F.col("start_ms")
    count = F.greatest(F.lit(1).cast("long"), F.ceil(length / longest_ms))
    cut = spans.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    a = F.col("start_ms") + F.col("_k") * longest_ms
    return cut.withColumn("_a", a).withColumn("end_ms", F.least("end_ms", F.col("_a") + longest_ms)).withColumn("start_ms", F.col("_a")).drop("_k", "_a")


def candidate_events(records: DataFrame, units: int, keys: list[str], gap_ms: int, least_ms: int = 0, longest_ms: int = LONGEST_MS) -> DataFrame:
    """Thresholded, merged, without the short ones, split."""
    return split_long(drop_short(merge_spans(positives(records, units, keys), keys, gap_ms), least_ms), longest_ms)


def with_empty(files: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_events, event_ms) of every file, those without events too."""
    totals = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    out = files.select(*keys).distinct().join(totals, keys, "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n_events"), F.coalesce("ms", F.lit(0)).alias("event_ms"))


def contiguous_runs(spans: DataFrame, keys: list[str], step_ms: int) -> DataFrame:
    """(keys, start_ms, n, run_ms): runs of starts that are exactly ``step_ms`` apart."""
    order = Window.partitionBy(*keys).orderBy("start_ms")
    grouped = spans.withColumn("_g", F.col("start_ms") - F.row_number().over(order) * F.lit(step_ms))
    runs = grouped.groupBy(*keys, "_g").agg(F.min("start_ms").alias("start_ms"), F.count(F.lit(1)).alias("n"))
    return runs.select(*keys, "start_ms", "n", (F.col("n") * step_ms).alias("run_ms"))


def kth_largest(records: DataFrame, keys: list[str], score: str, fraction: str | float) -> DataFrame:
    """(keys, n, k, threshold): the k-th largest score with k = round-half-even(fraction * n), from 1 to n.

    A fraction that is a column, one value per key, comes out too.
    A fraction of 0 or less flags nothing: the threshold is above every score.
    Counted per distinct score first, so a key with very many records is small.
    """
    share = F.col(fraction) if isinstance(fraction, str) else F.lit(fraction)
    extra = [fraction] if isinstance(fraction, str) else []
    counts = records.where(F.col(score).isNotNull()).groupBy(*keys, *extra, F.col(score).alias("_x")).agg(F.count(F.lit(1)).alias("_w"))
    whole = Window.partitionBy(*keys)
    down = Window.partitionBy(*keys).orderBy(F.col("_x").desc())
    ranked = counts.withColumn("_n", F.sum("_w").over(whole)).withColumn("_upto", F.sum("_w").over(down))
    k = F.greatest(F.lit(1).cast("long"), F.least(F.col("_n"), F.bround(share * F.col("_n")).cast("long")))
    at = F.max(F.when(F.col("_upto") >= F.col("_k"), F.col("_x")))
    agg = ranked.withColumn("_k", k).groupBy(*keys, "_n", "_k", *extra).agg(at.alias("_t"), F.max("_x").alias("_top"))
    return agg.select(*keys, *extra, F.col("_n").alias("n"), F.col("_k").alias("k"), F.when(share <= 0, F.col("_top") + 1).otherwise(F.col("_t")).alias("threshold"))
