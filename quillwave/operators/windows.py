"""Two-rate windowing of recordings, and windows matched with labelled intervals.

Places are whole samples or milliseconds, never float seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, WINDOW, DENSE_STEP, MARGIN = 256, 1024, 128, 60 * 256
#: Width of the buckets by which overlap joins are cut, in the unit of the bounds (ms).
BUCKET_MS = 600_000


def grid_starts(files: DataFrame, samples: str = "n_samples", window: int = WINDOW) -> DataFrame:
    """One row per window of the uniform grid; a trailing part is dropped, a short file has none."""
    last = F.col(samples) - F.lit(window)
    return files.where(last >= 0).withColumn("start_sample", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(window).cast("long"))))


def dense_starts(files: DataFrame, intervals: DataFrame, key: str = "filename", samples: str = "n_samples", rate: int = RATE, window: int = WINDOW, step: int = DENSE_STEP, margin: int = MARGIN) -> DataFrame:
    """(file columns, start_sample): windows every ``step`` near each interval (start_ms, end_ms), distinct."""
    near = files.where(F.col(samples) >= window).join(intervals.select(key, "start_ms", "end_ms"), key)
    sample = lambda c: F.floor(F.col(c) * rate / 1000).cast("long")
    low = F.greatest(F.lit(0).cast("long"), sample("start_ms") - margin)
    high = F.least((F.col(samples) - window).cast("long"), sample("end_ms") + margin)
    first = (F.floor((low + F.lit(step - 1)) / step) * step).cast("long")
    spans = near.withColumn("_a", first).withColumn("_b", high).where("_a <= _b")
    return spans.withColumn("start_sample", F.explode(F.sequence("_a", "_b", F.lit(step).cast("long")))).select(*files.columns, "start_sample").distinct()


def schedule(files: DataFrame, intervals: DataFrame, key: str = "filename", samples: str = "n_samples") -> DataFrame:
    """Grid and dense windows together, each start once; dense ones on the grid count as grid."""
    both = grid_starts(files, samples).unionByName(dense_starts(files, intervals, key, samples)).distinct()
    return both.withColumn("on_uniform_grid", F.col("start_sample") % WINDOW == 0)


def overlap_join(left: DataFrame, right: DataFrame, key: str, bucket: int = BUCKET_MS, within: int = 0, how: str = "inner") -> DataFrame:
    """Pairs of rows with equal ``key`` whose spans (start_ms, end_ms) overlap or are at most ``within`` apart.

    Both sides are laid into time buckets and joined on (key, bucket), so a key
    with very many rows on both sides is many small joins.  A pair that shares
    several buckets is kept in the first of them only.  The right side's
    columns come out with the prefix ``r_``.
    """
    pad = lambda c, d: F.floor((F.col(c) + F.lit(d)) / bucket).cast("long")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a = left.withColumn("_from", pad("start_ms", 0)).withColumn("_b", F.explode(F.sequence(F.col("_from"), F.greatest(F.col("_from"), pad("end_ms", 0)))))
    b = r.withColumn("_rfrom", pad("r_start_ms", -within)).withColumn("_rb", F.explode(F.sequence(F.col("_rfrom"), F.greatest(F.col("_rfrom"), pad("r_end_ms", within)))))
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_b") == F.col("_rb")) & (F.col("_b") == F.greatest("_from", "_rfrom"))
    on &= (F.col("start_ms") <= F.col("r_end_ms") + within) & (F.col("r_start_ms") - within <= F.col("end_ms"))
    return a.join(b, on, how).drop("_from", "_b", "_rfrom", "_rb", f"r_{key}")


def overlap_ms() -> Column:
    """Overlap of the two spans of ``overlap_join``, in milliseconds; negative if apart."""
    return F.least("end_ms", "r_end_ms") - F.greatest("start_ms", "r_start_ms")


def label_windows(windows: DataFrame, intervals: DataFrame, key: str = "filename", share: float = 0.5) -> DataFrame:
    """``windows`` (key, start_ms, end_ms) with label and event_id.

    The label is 1 if an interval covers at least ``share`` of the window; the
    interval with the least ``idx`` names the event.
    """
    pairs = overlap_join(windows.select(key, "start_ms", "end_ms").distinct(), intervals.select(key, "idx", "start_ms", "end_ms"), key)
    hit = pairs.where(overlap_ms() >= share * (F.col("end_ms") - F.col("start_ms"))).groupBy(key, "start_ms", "end_ms").agg(F.min("r_idx").alias("_idx"))
    out = windows.join(hit, [key, "start_ms", "end_ms"], "left")
    return out.withColumn("label", F.col("_idx").isNotNull().cast("int")).withColumn("event_id", F.concat(F.col(key), F.lit("_sz"), F.col("_idx"))).drop("_idx")


def near_zone(windows: DataFrame, intervals: DataFrame, key: str = "filename", margin_ms: int = 60_000) -> DataFrame:
    """``windows`` with is_near: the start lies within an interval widened by the margin, bounds included."""
    points = windows.select(key, "start_ms").distinct().withColumn("end_ms", F.col("start_ms"))
    near = overlap_join(points, intervals.select(key, "start_ms", "end_ms"), key, within=margin_ms).select(key, "start_ms").distinct().withColumn("_near", F.lit(True))
    return windows.join(near, [key, "start_ms"], "left").withColumn("is_near", F.coalesce("_near", F.lit(False))).drop("_near")


def windows_per_interval(windows: DataFrame, intervals: DataFrame, key: str = "filename", least_ms: int = 2000) -> DataFrame:
    """(key, idx, n_windows): windows that overlap each interval by at least ``least_ms``; 0 where none does."""
    pairs = overlap_join(intervals.select(key, "idx", "start_ms", "end_ms"), windows.select(key, "start_ms", "end_ms"), key)
    counts = pairs.where(overlap_ms() >= least_ms).groupBy(key, "idx").agg(F.count(F.lit(1)).alias("_n"))
    return intervals.select(key, "idx").join(counts, [key, "idx"], "left").select(key, "idx", F.coalesce("_n", F.lit(0)).alias("n_windows"))
