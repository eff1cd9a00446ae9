"""The rows that count where a table holds copies, corrections and late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.semantics import millis, normal, prob_units


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values of the row that is greatest in ``order``.

    Rows with a NULL key belong to no record and go.  A NULL order is least.
    Rows equal in ``order`` are decided by the greatest values, so the result
    never depends on row order.  It is a plain aggregate, combined before the
    shuffle, so a key with very many copies sends one row per input task.
    """
    present = df.dropna(subset=keys)
    best = F.max(F.struct(*order, *[c for c in values if c not in order])).alias("_best")
    grouped = present.groupBy(*keys).agg(best)
    return grouped.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in values])


def prediction_records(predictions: DataFrame, extra: bool = False) -> DataFrame:
    """(run_id, filename, start_ms, units, split): the latest row of each prediction.

    ``units`` is the probability in ten-thousandths, NULL if unusable.  With
    ``extra`` also subject, grid and label.
    """
    values = ["units", "split", *(["subject", "grid", "label"] if extra else [])]
    columns = {
        "run_id": F.col("run_id"),
        "filename": normal("filename"),
        "start_ms": millis("window_start_sec"),
        "units": prob_units("prob"),
        "split": normal("split"),
        "written_at": F.col("written_at"),
    }
    if extra:
        columns |= {"subject": normal("subject_id"), "grid": F.col("on_uniform_grid"), "label": F.col("label").cast("int")}
    rows = predictions.select(*[c.alias(k) for k, c in columns.items()])
    return latest(rows, ["run_id", "filename", "start_ms"], ["written_at"], values)


def positions(rows: DataFrame, keys: list[str], order: list[str], block: Column, name: str = "pos") -> DataFrame:
    """``rows`` numbered from 0 within each key, in ``order``.

    ``block`` is a coarse form of the order, the same or growing along it.  Rows
    are counted per key and block first and numbered within a block on top of
    the counts before it, so that a key with a third of all rows is no task.
    """
    cut = rows.withColumn("_block", block)
    counts = cut.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*keys, "_block", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order)) - 1
    return cut.join(before, [*keys, "_block"]).withColumn(name, F.col("_before") + inside).drop("_block", "_before")
