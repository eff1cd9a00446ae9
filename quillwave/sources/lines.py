"""Stateful scans over the lines of texts, as windows over line order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, line): the lines of each text in order; NULL texts have none."""
    return df.select(key, F.posexplode(F.split(text, "\r\n|\n|\r", -1)).alias("i", "line"))


def _group(line: str, pattern: str):
    return F.when(F.col(line).rlike(pattern), F.regexp_extract(line, pattern, 1))


def carried(df: DataFrame, key: str, text: str, state: str, mark: str) -> DataFrame:
    """(key, i, state, mark): every marked line with the last state before it; none before the first state.

    Only lines that set the state or are marked are kept for the window, so a
    long text costs what its marks cost.
    """
    lines = numbered(df, key, text).select(key, "i", _group("line", state).alias("_s"), _group("line", mark).alias("mark")).where("_s IS NOT NULL OR mark IS NOT NULL")
    order = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("state", F.last("_s", ignorenulls=True).over(order)).where("mark IS NOT NULL AND state IS NOT NULL").select(key, "i", "state", "mark")


def paired(df: DataFrame, key: str, text: str, first: str, second: str) -> DataFrame:
    """(key, i, first, second): each first line that the next matching line answers with a second one."""
    lines = numbered(df, key, text).select(key, "i", _group("line", first).alias("first"), _group("line", second).alias("_b")).where("first IS NOT NULL OR _b IS NOT NULL")
    after = lines.withColumn("second", F.lead("_b").over(Window.partitionBy(key).orderBy("i")))
    return after.where("first IS NOT NULL AND second IS NOT NULL").select(key, "i", "first", "second")
