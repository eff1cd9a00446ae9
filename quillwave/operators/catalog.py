"""The recording catalogue: admission, tiers, presence and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.semantics import finite, normal, ratio


def recordings(audit: DataFrame) -> DataFrame:
    """One row per (subject, filename): the latest audit row, with channels as a list."""
    names = F.transform(F.split("channel_names", ";"), lambda c: F.upper(F.btrim(c)))
    rows = audit.withColumns({"subject": normal("subject"), "filename": normal("filename"), "duration_sec": finite("duration_sec"), "channels": F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda c: c != ""))})
    order = Window.partitionBy("subject", "filename").orderBy(F.col("recorded_at").desc_nulls_last(), F.col("duration_sec").desc_nulls_last(), F.col("channel_names").desc_nulls_last(), F.col("n_seizures").desc_nulls_last(), F.col("sampling_rate").desc_nulls_last())
    return rows.dropna(subset=["subject", "filename"]).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def has_all(flags: Sequence[str]) -> Column:
    """Every flag holds; a NULL flag doesn't."""
    out = F.lit(True)
    for f in flags:
        out = out & F.coalesce(F.col(f), F.lit(False))
    return out


def covers(channels: str, required: Sequence[str]) -> Column:
    """The list holds every required channel."""
    return F.size(F.array_except(F.array(*[F.lit(c) for c in required]), F.col(channels))) == 0


def lacks_all(channels: str, required: Sequence[str]) -> Column:
    """The list holds none of the required channels."""
    return ~F.arrays_overlap(F.col(channels), F.array(*[F.lit(c) for c in required]))


def alias_channel(channels: str, name: str) -> Column:
    """The channel as listed: the exact name, else its first copy ``name-0``, else NULL."""
    has = lambda c: F.array_contains(F.col(channels), c)
    return F.when(has(name), F.lit(name)).when(has(f"{name}-0"), F.lit(f"{name}-0"))


def electrodes(channels: Column) -> Column:
    """Distinct electrodes of a list of bipolar channels ``A-B``."""
    return F.size(F.array_distinct(F.flatten(F.transform(channels, lambda c: F.split(c, "-")))))


def first_mode(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """(keys, value, n): the most frequent value, ties to the one seen first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("_first"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "_first", value)
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_first")


def presence(df: DataFrame, flags: Sequence[str], weight: str) -> DataFrame:
    """(channel, n_files, n_subjects, share_pct): where each flag holds, by files, subjects and weight."""
    long = df.unpivot(["subject", "filename", weight], list(flags), "channel", "present")
    on = F.coalesce(F.col("present"), F.lit(False))
    return long.groupBy("channel").agg(
        F.count_if(on).alias("n_files"), F.count_distinct(F.when(on, F.col("subject"))).alias("n_subjects"), (100 * ratio(F.sum(F.when(on, F.col(weight)).otherwise(0.0)), F.sum(weight))).alias("share_pct")
    )


def missing_cells(df: DataFrame, keys: list[str], columns: Sequence[str]) -> DataFrame:
    """(keys, column, n_missing): cells that are NULL, NaN or infinite, where there are any."""
    long = df.unpivot(keys, list(columns), "column", "value")
    return long.where(finite("value").isNull()).groupBy(*keys, "column").agg(F.count(F.lit(1)).alias("n_missing"))


def provenance(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON document per table: its name, columns and row count."""
    out = None
    for name, df in sorted(tables.items()):
        doc = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.to_json(F.struct(F.col("rows"), F.lit(",".join(sorted(df.columns))).alias("columns"))).alias("document"))
        out = doc if out is None else out.unionByName(doc)
    return out
