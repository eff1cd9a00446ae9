"""Scoring candidate events against reference events, rule by rule.

Both sides are rastered to whole seconds and clipped to the recording, events
closer than the rule's gap are merged, long ones split.  A reference event is
found if the share of it (widened by the tolerances) that candidates cover
exceeds the rule's least overlap; a candidate is a false alarm if it touches no
found reference.  Public procedure; not checked against any package.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.operators.events import merge_spans, split_long
from quillwave.operators.windows import overlap_join, overlap_ms
from quillwave.semantics import holds, ratio
from quillwave.session import materialise


@dataclass(frozen=True)
class Rule:
    """How events are matched. Times in milliseconds; overlaps are shares of the widened reference."""

    name: str
    before_ms: int
    after_ms: int
    least_overlap: float
    strict: bool
    merge_ms: int
    longest_ms: int = 300_000
    drop_upto_ms: int = -1


ANY_HIT = Rule("anyhit", 30_000, 60_000, 0.0, True, 90_000)
COVER_70 = Rule("cover70", 0, 0, 0.7, False, 10_000, drop_upto_ms=10_000)


def raster(events: DataFrame, files: DataFrame, keys: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Events in whole seconds within max(1, round(duration)) of their file (keys, duration_sec); others vanish."""
    length = F.greatest(F.lit(1).cast("long"), F.bround("duration_sec").cast("long")) * 1000
    second = lambda c: (F.floor(F.col(c) / 1000) * 1000).cast("long")
    clipped = events.join(files, keys).select(*keys, *extra, F.greatest(F.lit(0).cast("long"), second("start_ms")).alias("start_ms"), F.least(length, second("end_ms")).alias("end_ms"))
    return clipped.where("start_ms < end_ms")


def score(refs: DataFrame, hyps: DataFrame, files: DataFrame, rule: Rule, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, ref_true) per file of ``files`` (keys, duration_sec); files without events count 0.

    ``refs`` and ``hyps`` have (keys, start_ms, end_ms).  Events of files that
    aren't listed are ignored.
    """
    key, side = "_file", "_side"
    lengths = files.select(*keys, "duration_sec").distinct()
    hyps = hyps.where(F.col("end_ms") - F.col("start_ms") > rule.drop_upto_ms)
    # both sides go through the same steps at once; they are few beside the records they come from, and written once
    each = [df.select(*keys, "start_ms", "end_ms", F.lit(i).alias(side)) for i, df in enumerate((refs, hyps))]
    spans = merge_spans(raster(each[0].unionByName(each[1]), lengths, keys, (side,)), [*keys, side], rule.merge_ms - 1).drop("n")
    tidy = materialise(split_long(spans, rule.longest_ms).withColumn(key, F.to_json(F.struct(*keys))), "events")
    ref, hyp = tidy.where(F.col(side) == 0).drop(side), tidy.where(F.col(side) == 1).select(key, "start_ms", "end_ms")
    wide = ref.withColumn("start_ms", F.greatest(F.lit(0).cast("long"), F.col("start_ms") - rule.before_ms)).withColumn("end_ms", F.col("end_ms") + rule.after_ms)
    pairs = overlap_join(wide, hyp, key).where(overlap_ms() > 0)
    covered = F.sum(overlap_ms()).over(Window.partitionBy(key, "start_ms", "end_ms"))
    share = ratio(covered, F.col("end_ms") - F.col("start_ms"))
    hit = pairs.withColumn("_share", share).where(holds(F.col("_share") > rule.least_overlap if rule.strict else F.col("_share") >= rule.least_overlap))
    found = hit.groupBy(*keys).agg(F.count_distinct("start_ms").alias("tp"), F.count_distinct("r_start_ms").alias("_touched"))
    counts = tidy.groupBy(*keys).agg(F.count_if(F.col(side) == 0).alias("ref_true"), F.count_if(F.col(side) == 1).alias("_hyps"))
    out = files.select(*keys).distinct().join(counts, keys, "left").join(found, keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(*keys, zero("tp").alias("tp"), (zero("_hyps") - zero("_touched")).alias("fp"), zero("ref_true").alias("ref_true"))


def rates(totals: DataFrame, hours: str = "hours") -> DataFrame:
    """``totals`` with sens and fa_per_day, NULL where undefined."""
    return totals.withColumn("sens", ratio(F.col("tp"), F.col("ref_true"))).withColumn("fa_per_day", ratio(F.col("fp") * 24, F.col(hours)))
