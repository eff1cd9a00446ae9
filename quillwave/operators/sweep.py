"""Threshold sweeps, operating points and their transfer."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.operators.events import WINDOW_MS, kth_largest, merge_spans, split_long
from quillwave.operators.scoring import Rule, rates, score
from quillwave.semantics import holds
from quillwave.session import materialise

#: The level of the state in which no window is flagged.
NOTHING = 10_001


def threshold_units() -> list[int]:
    """The fine grid in ten-thousandths: steps of 1 to 99, of 10 to 990, of 100 to 9900."""
    return sorted({*range(1, 100), *range(10, 1000, 10), *range(1000, 10000, 100)})


def display_units() -> list[int]:
    """The grid for display, in ten-thousandths: geometric from 5 to 200 and towards the top, even steps between."""
    geometric = lambda a, b, n: [a * (b / a) ** (i / (n - 1)) for i in range(n)]
    even = lambda a, b, n: [a + (b - a) * i / (n - 1) for i in range(1, n)]
    points = [*geometric(5, 200, 10), *even(200, 3000, 10), *even(3000, 8000, 8), *(10_000 - x for x in geometric(10, 2000, 18))]
    return sorted({math.ceil(round(x, 6)) for x in points})


def sweep_events(records: DataFrame, keys: list[str], thresholds: Sequence[int], gap_ms: int) -> DataFrame:
    """(keys, threshold, start_ms, end_ms): the candidate events at every threshold, in one pass."""
    grid = F.array(*[F.lit(t) for t in thresholds])
    each = records.where("units IS NOT NULL").withColumn("threshold", F.explode(F.filter(grid, lambda t: t <= F.col("units"))))
    spans = each.select(*keys, "threshold", "start_ms", (F.col("start_ms") + WINDOW_MS).alias("end_ms"))
    return split_long(merge_spans(spans, [*keys, "threshold"], gap_ms).drop("n"))


def sweep_curve(records: DataFrame, refs: DataFrame, files: DataFrame, run: str, file: str, thresholds: Sequence[int], gap_ms: int, rule: Rule) -> DataFrame:
    """(run, threshold, tp, fp, ref_true, hours, sens, fa_per_day) of every run and threshold.

    ``hours`` counts the records, so rows dropped before shorten it. A file
    whose records have no event at a threshold still counts its references.
    """
    present = records.where("units IS NOT NULL").select(run, file).distinct()
    hours = records.where("units IS NOT NULL").groupBy(run).agg((F.count(F.lit(1)) * F.lit(WINDOW_MS / 3_600_000)).alias("hours"))
    grid = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    every = present.select(run, file, grid).join(files.select(file, "duration_sec"), file)
    keys = [run, "threshold", file]
    hyps = sweep_events(records, [run, file], thresholds, gap_ms)
    all_refs = every.select(*keys).join(refs.select(file, "start_ms", "end_ms"), file)
    totals = score(all_refs, hyps, every, rule, keys).groupBy(run, "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])
    return rates(totals.join(hours, run))


def state_spans(records: DataFrame, keys: list[str], thresholds: Sequence[int], gaps: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(keys, level) of every key's states, and (keys, merge_gap, level, start_ms, end_ms) of its merged spans in them.

    A window's level is the highest threshold it reaches, and what is flagged
    changes only at the levels present: one state per level stands for all
    thresholds above the next lower one.  The state NOTHING has no spans.  A
    window opens a span in the states above the levels of the windows within
    the gap before it and closes one above those after it, so only the ends of
    spans are laid out.  Starts are distinct per key.
    """
    grid = F.array(*[F.lit(t) for t in sorted(thresholds)])
    level = records.sparkSession.range(0, 10_001).select(F.col("id").cast("int").alias("units"), F.array_max(F.filter(grid, lambda t: t <= F.col("id"))).alias("level"))
    rows = records.where("units IS NOT NULL").join(level, "units", "left").select(*keys, "start_ms", "level")
    states = materialise(rows.select(*keys, F.coalesce("level", F.lit(NOTHING)).alias("level")).unionByName(rows.select(*keys, F.lit(NOTHING).alias("level"))).distinct(), "states")
    key = Window.partitionBy(*keys)
    order = key.orderBy("start_ms")
    beside = lambda a, b: F.coalesce(F.max("level").over(order.rangeBetween(a, b)), F.lit(0))
    ends = [F.struct(F.lit(g).alias("merge_gap"), beside(-g - WINDOW_MS, -1).alias("before"), beside(1, g + WINDOW_MS).alias("after")) for g in gaps]
    each = rows.where("level IS NOT NULL").select(*keys, "start_ms", "level", F.collect_set("level").over(key).alias("levels"), F.array(*ends).alias("e"))
    each = each.select(*keys, "start_ms", F.col("level").alias("top"), "levels", F.explode("e").alias("e")).select("*", "e.*")
    least = F.least("before", "after")
    each = each.withColumn("level", F.explode(F.filter("levels", lambda x: (x > least) & (x <= F.col("top")))))
    following = F.lead("start_ms").over(Window.partitionBy(*keys, "merge_gap", "level").orderBy("start_ms"))
    last = F.when(F.col("level") > F.col("after"), F.col("start_ms")).otherwise(following)
    spans = each.withColumn("end_ms", last + WINDOW_MS).where("level > before")
    return states, spans.select(*keys, "merge_gap", "level", "start_ms", "end_ms")


def state_curves(records: DataFrame, refs: DataFrame, files: DataFrame, run: str, file: str, thresholds: Sequence[int], gaps: Sequence[int], rules: Sequence[Rule]) -> DataFrame:
    """(run, merge_gap, rule, threshold, ...): ``sweep_curve`` for every merge gap and rule, scored once per state instead of per threshold."""
    rows = records.where("units IS NOT NULL").select(run, file, "start_ms", "units")
    states, spans = state_spans(rows, [run, file], thresholds, gaps)
    settings = F.explode(F.array(*[F.lit(g) for g in gaps])).alias("merge_gap")
    every = states.select(run, file, settings, "level").join(files.select(file, "duration_sec"), file)
    keys = [run, file, "merge_gap", "level"]
    all_refs = every.select(*keys).join(refs.select(file, "start_ms", "end_ms"), file)
    hyps = materialise(split_long(spans), "spans")
    parts = [score(all_refs, hyps, every, rule, keys).withColumn("rule", F.lit(rule.name)) for rule in rules]
    totals = reduce(DataFrame.unionByName, parts)
    # what a state has more than the next higher one counts for every threshold up to its level
    higher = Window.partitionBy(run, file, "merge_gap", "rule").orderBy("level")
    more = lambda c: F.col(c) - F.coalesce(F.lead(c).over(higher), F.lit(0))
    steps = totals.select(run, "merge_gap", "rule", "level", more("tp").alias("tp"), more("fp").alias("fp"), F.when(F.col("level") == NOTHING, F.col("ref_true")).otherwise(0).alias("ref_true"))
    steps = materialise(steps.groupBy(run, "merge_gap", "rule", "level").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")]), "steps")
    group = [run, "merge_gap", "rule"]
    grid = F.explode(F.array(*[F.lit(t) for t in sorted(thresholds)])).alias("level")
    points = steps.where(F.col("level") == NOTHING).select(*group, grid).join(steps.where(F.col("level") != NOTHING).drop("ref_true"), [*group, "level"], "left")
    upwards = Window.partitionBy(*group).orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = points.select(*group, F.col("level").alias("threshold"), *[F.coalesce(F.sum(c).over(upwards), F.lit(0)).alias(c) for c in ("tp", "fp")])
    summed = summed.join(steps.where(F.col("level") == NOTHING).select(*group, "ref_true"), group)
    hours = rows.groupBy(run).agg((F.count(F.lit(1)) * F.lit(WINDOW_MS / 3_600_000)).alias("hours"))
    return rates(summed.join(hours, run))


def pick_threshold(curve: DataFrame, run: str | list[str], most_fa: float, fallback: bool) -> DataFrame:
    """The curve's row with most sensitivity among those within ``most_fa``, ties to the lowest threshold.

    Where none is within: no row, or with ``fallback`` the row with least false
    alarms, then most sensitivity.  ``ceiling_met`` tells which.
    """
    ok = holds(F.col("fa_per_day") <= most_fa)
    order = Window.partitionBy(run).orderBy(
        F.col("ceiling_met").desc(), F.when(F.col("ceiling_met"), F.lit(0.0)).otherwise(F.col("fa_per_day")).asc_nulls_last(), F.col("sens").desc_nulls_last(), F.col("threshold")
    )
    ranked = curve.withColumn("ceiling_met", ok)
    ranked = ranked if fallback else ranked.where("ceiling_met")
    return ranked.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def criteria_met(points: DataFrame, least_sens: float, most_fa: float) -> DataFrame:
    """``points`` with met; undefined rates never meet a criterion."""
    return points.withColumn("met", holds((F.col("sens") >= least_sens) & (F.col("fa_per_day") <= most_fa)))


def percentile_transfer(tuning: DataFrame, test: DataFrame, points: DataFrame, run: str) -> DataFrame:
    """(run, fraction, n, k, threshold): the threshold that flags on ``test`` the share flagged on ``tuning``."""
    flagged = tuning.join(points.select(run, "threshold"), run).groupBy(run).agg(F.avg((F.col("units") >= F.col("threshold")).cast("int")).alias("fraction"))
    return kth_largest(test.join(flagged, run), [run], "units", "fraction")
