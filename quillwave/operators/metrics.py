"""Metrics over scored records and events: confusion, macro and micro rates, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.semantics import holds, ratio


def confusion(records: DataFrame, keys: list[str], positive: str = "label = 1", predicted: str = "units >= 5000") -> DataFrame:
    """(keys, tp, fp, fn, tn) of the records with a score."""
    p, q = F.expr(positive), F.expr(predicted)
    scored = records.where("units IS NOT NULL")
    return scored.groupBy(*keys).agg(F.count_if(p & q).alias("tp"), F.count_if(~p & q).alias("fp"), F.count_if(p & ~q).alias("fn"), F.count_if(~p & ~q).alias("tn"))


def window_rates(counts: DataFrame) -> DataFrame:
    """``counts`` with precision, recall, f1 and specificity, NULL where undefined."""
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", precision).withColumn("recall", recall).withColumn("specificity", ratio(F.col("tn"), F.col("tn") + F.col("fp")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_micro(per_subject: DataFrame, keys: list[str], subject: str, least_sens: float, most_fa: float) -> DataFrame:
    """Macro mean of the subjects' rates, micro ratio of their sums, and the share of subjects that pass.

    ``per_subject`` has (keys, subject, tp, fp, ref_true, hours).
    """
    rated = per_subject.withColumn("sens", ratio(F.col("tp"), F.col("ref_true"))).withColumn("fa_per_day", ratio(F.col("fp") * 24, F.col("hours")))
    met = holds((F.col("sens") >= least_sens) & (F.col("fa_per_day") <= most_fa)).cast("int")
    agg = rated.groupBy(*keys).agg(
        F.count_distinct(subject).alias("n_subjects"), F.avg("sens").alias("macro_sens"), ratio(F.sum("tp"), F.sum("ref_true")).alias("micro_sens"),
        ratio(F.sum("fp") * 24, F.sum("hours")).alias("fa_per_day"), F.sum(met).alias("n_met"),
    )
    return agg.withColumn("pct_met", 100 * ratio(F.col("n_met"), F.col("n_subjects")))


def _by_score(records: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Per key and distinct score, from the highest: records and positives so far, and totals."""
    counts = records.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(score).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_p"))
    down, whole = Window.partitionBy(*keys).orderBy(F.col("_x").desc()), Window.partitionBy(*keys)
    return counts.select(
        *keys, "_x", "_n", "_p", F.sum("_p").over(down).alias("_tp"), F.sum("_n").over(down).alias("_upto"), F.sum("_p").over(whole).alias("_allp"), F.sum("_n").over(whole).alias("_alln")
    )


def auc_roc(records: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, auc): the Mann-Whitney form with ties counted half; NULL with one class only.

    Scores are counted first, so a key has one row per distinct score.
    """
    s = _by_score(records, keys, score, label)
    above = F.col("_tp") - F.col("_p")  # positives with a greater score
    wins = F.sum((F.col("_n") - F.col("_p")) * (above + F.col("_p") / 2))
    out = s.groupBy(*keys).agg(wins.alias("_w"), F.max("_allp").alias("_allp"), F.max("_alln").alias("_alln"))
    return out.select(*keys, ratio(F.col("_w"), F.col("_allp") * (F.col("_alln") - F.col("_allp"))).alias("auc"))


def auc_by_blocks(records: DataFrame, keys: list[str], score: str, label: str, block: Column) -> DataFrame:
    """(keys, auc, n): ``auc_roc`` for keys of many distinct scores; ``block`` is a coarse form of the score, the same or growing along it.

    Scores are sorted within a block only, and positives of the blocks above it
    added, so that a key is no task.
    """
    cut = records.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(*keys, block.alias("_block"), F.col(score).alias("_x"), F.col(label).cast("long").alias("_y"))
    counts = cut.repartition(*keys, "_block").groupBy(*keys, "_block", "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_p"))
    above = F.sum("_p").over(Window.partitionBy(*keys, "_block").orderBy(F.col("_x").desc())) - F.col("_p")
    blocks = counts.withColumn("_above", above).groupBy(*keys, "_block").agg(F.sum((F.col("_n") - F.col("_p")) * (F.col("_above") + F.col("_p") / 2)).alias("_w"), F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    higher = F.sum("_p").over(Window.partitionBy(*keys).orderBy(F.col("_block").desc())) - F.col("_p")
    out = blocks.withColumn("_above", higher).groupBy(*keys).agg(F.sum(F.col("_w") + (F.col("_n") - F.col("_p")) * F.col("_above")).alias("_w"), F.sum("_p").alias("_p"), F.sum("_n").alias("n"))
    return out.select(*keys, ratio(F.col("_w"), F.col("_p") * (F.col("n") - F.col("_p"))).alias("auc"), "n")


def average_precision(records: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, ap): the sum over distinct scores of the gain in recall times precision."""
    s = _by_score(records, keys, score, label)
    step = ratio(F.col("_p"), F.col("_allp")) * ratio(F.col("_tp"), F.col("_upto"))
    return s.groupBy(*keys).agg(F.sum(step).alias("ap"))


def lift_deltas(table: DataFrame, keys: list[str], base: str, bases: tuple[str, str], values: list[str]) -> DataFrame:
    """(keys, value_a, value_b, value_delta, value_pct): second base minus first, and the change in percent."""
    pick = lambda v, b: F.avg(F.when(F.col(base) == b, F.col(v)))
    wide = table.groupBy(*keys).agg(*[pick(v, b).alias(f"{v}_{s}") for v in values for b, s in zip(bases, "ab", strict=True)])
    for v in values:
        delta = F.col(f"{v}_b") - F.col(f"{v}_a")
        wide = wide.withColumn(f"{v}_delta", delta).withColumn(f"{v}_pct", 100 * ratio(delta, F.col(f"{v}_a")))
    return wide
