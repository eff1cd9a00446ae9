"""Sampling, scaling and feature selection on fit rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.semantics import ratio


def lot(*key: str, seed: int = 42) -> Column:
    """A reproducible random order: the MD5 of the key's text and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def first_by_lot(rows: DataFrame, groups: list[str], wanted: DataFrame, key: list[str], seed: int = 42) -> DataFrame:
    """The ``_lot_want`` first rows of each group by lot; ``wanted`` has (groups, _lot_want), one row per group.

    Rows are counted by the first digits of their lot; whole counts below the
    number wanted are taken as they are, and only the rows of the one count
    that reaches it are ranked.  So no group is a task, and hardly any row is
    shuffled.  NULL is a group like any other.
    """
    # the rows are read twice, for the counts and for the result
    drawn = rows.withColumn("_lot_lot", lot(*key, seed=seed)).withColumn("_lot_digits", F.substring("_lot_lot", 1, 4))
    counts = drawn.groupBy(*groups, "_lot_digits").agg(F.count(F.lit(1)).alias("_lot_n"))
    upto = F.sum("_lot_n").over(Window.partitionBy(*groups).orderBy("_lot_digits"))
    match = lambda a, b: reduce(lambda x, y: x & y, [a[g].eqNullSafe(b[g]) for g in groups])
    reached = counts.withColumn("_lot_upto", upto)
    limits = reached.join(wanted, match(reached, wanted)).select(*[reached[g] for g in groups], "_lot_want", "_lot_digits", "_lot_upto", "_lot_n")
    # per group: the digits in which the number is reached, and how many of them are still wanted
    edge = limits.where((F.col("_lot_upto") >= F.col("_lot_want")) & (F.col("_lot_upto") - F.col("_lot_n") < F.col("_lot_want"))).select(*groups, F.col("_lot_digits").alias("_lot_edge"), (F.col("_lot_want") - F.col("_lot_upto") + F.col("_lot_n")).alias("_lot_more"))
    whole = limits.groupBy(*groups).agg(F.max("_lot_upto").alias("_lot_all"), F.max("_lot_want").alias("_lot_want"))
    last = whole.join(edge, match(whole, edge), "left").select(*[whole[g].alias(f"_g{i}") for i, g in enumerate(groups)], "_lot_want", "_lot_all", "_lot_edge", "_lot_more")
    on = reduce(lambda x, y: x & y, [drawn[g].eqNullSafe(last[f"_g{i}"]) for i, g in enumerate(groups)])
    placed = drawn.join(last, on).where("_lot_want > 0")
    inside = placed.where("_lot_want >= _lot_all OR _lot_digits < _lot_edge").select(*rows.columns)
    order = Window.partitionBy(*groups).orderBy("_lot_lot", *key)
    border = placed.where("_lot_want < _lot_all AND _lot_digits = _lot_edge").withColumn("_lot_r", F.row_number().over(order)).where("_lot_r <= _lot_more").select(*rows.columns)
    return inside.unionByName(border)


def undersample(rows: DataFrame, groups: list[str], label: str, key: list[str], per_positive: int = 10, seed: int = 42) -> DataFrame:
    """All positives, and of the negatives the first min(n, per_positive * positives) by lot, per group.

    Sampling is the feature; the lot is taken of the key, so the same rows are
    drawn whatever their order.
    """
    positives, negatives = rows.where(F.col(label) == 1), rows.where(F.col(label) == 0)
    wanted = positives.groupBy(*groups).agg((F.count(F.lit(1)) * per_positive).alias("_lot_want"))
    return positives.unionByName(first_by_lot(negatives, groups, wanted, key, seed))


def stratified(rows: DataFrame, label: str, key: list[str], each: int, seed: int = 42) -> DataFrame:
    """At most ``each`` rows of every label, by lot."""
    return first_by_lot(rows, [label], rows.groupBy(label).agg(F.lit(each).cast("long").alias("_lot_want")), key, seed)


#: Steps between the ends of a bracket in which values are counted at once, and from how few values on they are counted one by one.
STEPS, FEW = 4096, 10_000


def order_statistics(rows: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> dict[str, list[float | None]]:
    """The exact continuous quantiles of each column; NULL and NaN don't count, a column without values gives None.

    Values are counted in equal steps of a bracket around the wanted rank, and
    the bracket is narrowed to the step that holds it, until few values are left
    in it.  A round is one aggregate of all columns, combined before the
    shuffle; nothing is sorted, and the driver sees counts only.
    """
    values = rows.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    ends = values.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    # one search for each rank that is needed
    wanted = {c: sorted({r for f in fractions for r in _ranks(f, ends[f"n_{c}"])}) for c in columns}
    # low end, high end, rank within the bracket, values in it
    search = {(c, r): [ends[f"lo_{c}"], ends[f"hi_{c}"], r, ends[f"n_{c}"]] for c in columns for r in wanted[c]}
    done: dict[tuple[str, int], float] = {}
    stuck: set[tuple[str, int]] = set()  # brackets too narrow to be cut further: their values are counted one by one
    while search:
        for k in [k for k, (lo, hi, _, _) in search.items() if lo == hi]:
            done[k] = search.pop(k)[0]
        few = {k for k, v in search.items() if v[3] <= FEW or k in stuck}
        parts = []
        for i, (k, (lo, hi, _, _)) in enumerate(search.items()):
            x = F.col(k[0])
            # halved, so that the width of a bracket can't overflow, and never 0
            width = max((hi / 2 - lo / 2) / STEPS, 5e-324)
            step = x if k in few else F.least(F.lit(STEPS - 1), F.floor((x / 2 - lo / 2) / width)).cast("double")
            parts.append(F.struct(F.lit(i).alias("i"), F.when((x >= lo) & (x <= hi), step).alias("step"), x.alias("x")))
        if not parts:
            break
        each = values.select(F.inline(F.array(*parts))).where("step IS NOT NULL").groupBy("i", "step").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        counts: dict[int, list] = {}
        for r in each.collect():
            counts.setdefault(r["i"], []).append((r["step"], r["n"], r["lo"], r["hi"]))
        for i, k in enumerate(list(search)):
            rank = search[k][2]
            for _, n, lo, hi in sorted(counts[i]):
                if rank < n:
                    break
                rank -= n
            if k in few:
                done[k] = lo
                del search[k]
            else:
                if [lo, hi] == search[k][:2]:
                    stuck.add(k)
                search[k] = [lo, hi, rank, n]
    out: dict[str, list[float | None]] = {}
    for c in columns:
        n, out[c] = ends[f"n_{c}"], []
        for f in fractions:
            if not n:
                out[c].append(None)
                continue
            at = f * (n - 1)
            low, high = done[c, _ranks(f, n)[0]], done[c, _ranks(f, n)[-1]]
            out[c].append(low + (high - low) * (at - int(at)))
    return out


def _ranks(fraction: float, n: int) -> list[int]:
    """The ranks between which a quantile lies."""
    return [] if not n else sorted({int(fraction * (n - 1)), min(n - 1, int(fraction * (n - 1)) + 1)})


def minmax(fit: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` scaled by the range of ``fit``, not clipped; a constant column becomes 0."""
    ends = fit.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = rows.crossJoin(F.broadcast(ends))  # one row
    scaled = {c: F.coalesce(ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.when(F.col(c).isNotNull(), F.lit(0.0))) for c in columns}
    return out.withColumns(scaled).drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def impute_median(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values replaced by the column's median, exactly; a column without values stays missing."""
    middles = order_statistics(rows, columns, [0.5])
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middles[c][0]).cast("double")) for c in columns})


def class_weights(rows: DataFrame, groups: list[str], label: str) -> DataFrame:
    """(groups, label, n, weight) with the balanced weight n_all / (classes * n)."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*groups)
    return counts.withColumn("weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n")))


def chi2_scores(rows: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """(feature, chi2): observed sums per class against those expected by the class's share.

    Features have to be nonnegative.  An undefined score is -1.
    """
    long = rows.unpivot([label], list(columns), "feature", "value")
    sums = long.where("value IS NOT NULL").groupBy("feature", label).agg(F.sum("value").alias("_o"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("feature")
    expected = F.sum("_o").over(whole) * F.col("_n") / F.sum("_n").over(whole)
    each = sums.withColumn("_e", expected).withColumn("_t", ratio((F.col("_o") - F.col("_e")) ** 2, F.col("_e")))
    total = each.groupBy("feature").agg(F.sum("_t").alias("_s"), F.count_if(F.col("_t").isNull()).alias("_bad"))
    return total.select("feature", F.when((F.col("_bad") > 0) | F.col("_s").isNull(), -1.0).otherwise(F.col("_s")).alias("chi2"))


def top_k(scores: DataFrame, block: list[str], score: str, name: str, k: int) -> DataFrame:
    """The k best of each block, ties by name, with their rank."""
    order = Window.partitionBy(*block).orderBy(F.col(score).desc_nulls_last(), name)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
