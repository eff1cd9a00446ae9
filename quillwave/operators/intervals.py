"""Coverage of possibly overlapping intervals: continuous periods and the gaps between.

A sweep line: every interval is a plus at its start and a minus at its end;
the running sum of the netted changes is the number of active intervals.  A
period opens where the sum leaves 0 and closes where it returns to 0.

The sum is taken in two levels so that no key, however hot, is ever one task:
time is cut into blocks, each block's total is carried to the later ones, and
each block sums its own boundaries (at most one per millisecond) on top of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.session import materialise

#: Milliseconds in a block: bounds the boundary points a single task sorts for one key.
BLOCK_MS = 1 << 20


def boundaries(df: DataFrame, keys: list[str], start: str | Column, end: str | Column) -> DataFrame:
    """(keys, t, delta): the net change of the active count at each instant, where it isn't 0."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    edges = df.where(start < end).select(
        *keys, F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("_e")
    )
    netted = edges.groupBy(*keys, F.col("_e.t").alias("t")).agg(F.sum("_e.d").alias("delta"))
    return netted.where("delta <> 0")


def coverage(df: DataFrame, keys: list[str], start: str, end: str, block: int = BLOCK_MS) -> DataFrame:
    """(keys, kind, start, end) with kind ``period`` or ``gap`` per maximal stretch.

    Touching intervals are one period.  Intervals that are empty, reversed or
    have a NULL bound cover nothing; NULL keys form a group like any other.
    Copies and nesting change nothing.  An empty table gives an empty result.
    Columns other than the keys and bounds are ignored, whatever their names.
    """
    # written once: every step below starts from it, with other columns each
    edge = materialise(boundaries(df, keys, start, end).withColumn("_b", F.floor(F.col("t") / F.lit(block))), "boundaries")
    same_key, in_block = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys, "_b").orderBy("t")
    carried = (
        edge.groupBy(*keys, "_b").agg(F.sum("delta").alias("_sum"))
        .select(*keys, "_b", (F.sum("_sum").over(same_key) - F.col("_sum")).alias("_before"))
    )
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys] + [F.col("e._b") == F.col("c._b")]
    active = (
        edge.alias("e").join(carried.alias("c"), on)
        .select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e._b").alias("_b"), "t", "delta", "_before")
        .withColumn("_now", F.col("_before") + F.sum("delta").over(in_block))
        .where((F.col("_now") == 0) | (F.col("_now") == F.col("delta")))
        .select(*keys, "_b", "t", (F.col("_now") > 0).alias("_opens"))
    )
    first = active.groupBy(*keys, "_b").agg(F.min_by("t", "t").alias("_first"))
    later = first.select(*keys, "_b", F.lead("_first").over(same_key).alias("_later"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys] + [F.col("a._b") == F.col("l._b")]
    spans = (
        active.alias("a").join(later.alias("l"), on)
        .select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("a._b").alias("_b"), "t", "_opens", "_later")
        .withColumn("_end", F.coalesce(F.lead("t").over(in_block), F.col("_later")))
        .where(F.col("_end").isNotNull())
    )
    kind = F.when(F.col("_opens"), "period").otherwise("gap").alias("kind")
    return spans.select(*keys, kind, F.col("t").alias(start), F.col("_end").alias(end))
