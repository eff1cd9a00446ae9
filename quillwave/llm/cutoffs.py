"""Score cutoffs that keep a target fraction of each source's records.

A source's cutoff is an order statistic: the k-th largest of its n scores, with
k the target share of n, rounded up.  It is the minimiser of the convex pinball
loss  F(t) = sum(max(x - t, 0)) + (k - 1/2) t,  which is found by cutting
planes: each round sums every source's loss and subgradient at trial points in
one aggregate over all sources.  The trial points are where the two tangents of
the bracket cross, and points evenly spaced on either side of it, so that the
bracket shrinks at least by their number.  Scores are summed by the interval
between trial points they lie in, so a round reads each score once however many
trial points there are.  The scores next to a trial point come out of the same
aggregate, so a round ends by snapping to the exact neighbouring score if that
is the minimiser, and by moving the bracket onto it otherwise.

Scores are whole numbers (units), losses are doubled so that all sums are whole
and exact.  Scores are first counted per (source, score) with a partial
aggregate, so a source with a third of all rows is no hot group: it has at most
one row per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwave.semantics import finite
from quillwave.session import materialise, superseded

#: Trial points on either side of the crossing of the tangents.
TRIALS = 32

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def units(records: DataFrame, score: str, scale: int = 1) -> Column:
    """``score * scale`` as a whole number; NULL for NULL, NaN and infinite scores.

    A score that is no whole number at this scale is an error, never cut off.
    """
    if records.schema[score].dataType.simpleString() in _WHOLE:
        return F.col(score).cast("long") * scale
    scaled = finite(score) * scale
    text = F.concat(F.lit(f"{score} is no whole number at scale {scale}: "), F.col(score).cast("string"))
    near = F.round(scaled)
    return F.when(F.abs(scaled - near) > 1e-6 * F.greatest(F.lit(1.0), F.abs(scaled)), F.raise_error(text).cast("long")).otherwise(near.cast("long"))


def _ids(source: list[str]) -> list[str]:
    return [f"_s{i}" for i in range(len(source))]


def histogram(records: DataFrame, source: list[str], score: str, scale: int = 1) -> DataFrame:
    """(_s0, _s1, ..., _x, _w): how often each usable score of each source occurs. NULL scores and sources are left out."""
    rows = records.select(*[F.col(c).alias(i) for c, i in zip(source, _ids(source), strict=True)], units(records, score, scale).alias("_x")).dropna()
    return rows.groupBy(*_ids(source), "_x").agg(F.count(F.lit(1)).alias("_w"))


_BRACKET = ["keep_permille", "n", "k", "lo", "hi", "f_lo", "g_lo", "f_hi", "g_hi", "over", "over_sum"]


def _start(hist: DataFrame, targets: DataFrame, source: list[str], by: list[str]) -> DataFrame:
    """The bracket from the least to the greatest score, and cutoffs already decided by it.

    ``f`` and ``g`` are loss and subgradient at the bracket's ends, ``over`` and
    ``over_sum`` count the scores above it and sum their distances from it.
    """
    ends = hist.groupBy(*by).agg(
        F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_x")).alias("s"), F.min(F.struct("_x", "_w")).alias("a"), F.max(F.struct("_x", "_w")).alias("b")
    )
    wanted = targets.select(*[F.col(c).alias(i) for c, i in zip(source, by, strict=True)], "keep_permille").where("keep_permille IS NOT NULL").dropna()
    s = ends.join(wanted, by)
    s = s.withColumn("k", F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("keep_permille") / F.lit(1000).cast("decimal(10,0)")).cast("long"))))
    lo, hi, k, n = F.col("a._x"), F.col("b._x"), F.col("k"), F.col("n")
    at_top, at_bottom = F.col("b._w") >= k, n - F.col("a._w") < k
    return s.select(
        *by, "keep_permille", "n", "k", lo.alias("lo"), hi.alias("hi"),
        (2 * (F.col("s") - n * lo) + (2 * k - 1) * lo).alias("f_lo"), (2 * k - 1 - 2 * (n - F.col("a._w"))).alias("g_lo"),
        ((2 * k - 1) * hi).alias("f_hi"), (2 * k - 1 - 2 * F.col("b._w")).alias("g_hi"),
        F.lit(0).cast("long").alias("over"), F.lit(0).cast("long").alias("over_sum"),
        F.when(at_top, hi).when(at_bottom, lo).alias("cutoff"), F.when(at_top, F.col("b._w")).when(at_bottom, n).alias("kept"),
    )


def _interval(trials: int) -> Column:
    """Which interval between trial points ``_x`` is in; every interval's right end is a trial point or the bracket's."""
    lo, hi, x = F.col("lo"), F.col("hi"), F.col("_x")
    # where the tangents cross, within the bracket
    cross = (F.col("f_hi") - F.col("f_lo") + F.col("g_lo") * lo - F.col("g_hi") * hi) / (F.col("g_lo") - F.col("g_hi"))
    point = F.greatest(lo, F.least(hi - 1, F.floor(cross).cast("long")))
    left, right = F.ceil((point - lo + 1) / trials), F.ceil((hi - point) / trials)
    return F.when(x <= point, trials - F.floor((point - x) / left)).otherwise(trials + 1 + F.floor((x - point - 1) / right)).cast("int")


def _inside(hist: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """The scores within the brackets that are still open."""
    return hist.join(state.where("cutoff IS NULL").select(*by, "lo", "hi"), by).where("_x BETWEEN lo AND hi").select(*by, "_x", "_w")


def _cut(hist: DataFrame, state: DataFrame, by: list[str], trials: int) -> DataFrame:
    """One round: losses and subgradients at the trial points, then narrower brackets."""
    tried = state.where("cutoff IS NULL").select(*by, *_BRACKET)
    sums = hist.join(tried, by).where("_x BETWEEN lo AND hi").groupBy(*by, *_BRACKET, _interval(trials).alias("_i")).agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_x")).alias("s"), F.min(F.struct("_x", "_w")).alias("first"), F.max(F.struct("_x", "_w")).alias("last")
    )
    # a trial point between two intervals: the scores above it are those of the later ones
    above = Window.partitionBy(*by).orderBy(F.col("_i").desc())
    later = above.rowsBetween(Window.unboundedPreceding, -1)
    j = sums.withColumn("gt", F.sum("w").over(later)).withColumn("gt_s", F.sum("s").over(later)).withColumn("next", F.lag("first").over(above)).where("next IS NOT NULL")
    k, hi, up, down = F.col("k"), F.col("hi"), F.col("next._x"), F.col("last._x")
    gt = F.col("gt") + F.col("over")
    distance = lambda t: F.col("gt_s") - F.col("gt") * t + F.col("over_sum") + F.col("over") * (hi - t)
    rises = gt >= k  # the minimiser is the score above the trial point or a higher one
    gt_up, ge_down = gt - F.col("next._w"), gt + F.col("last._w")
    low = F.struct(up.alias("x"), (2 * distance(up) + (2 * k - 1) * up).alias("f"), (2 * k - 1 - 2 * gt_up).alias("g"))
    high = F.struct(down.alias("x"), (2 * distance(down) + (2 * k - 1) * down).alias("f"), (2 * k - 1 - 2 * ge_down).alias("g"), gt.alias("over"), distance(down).alias("over_sum"))
    snapped = F.when(rises & (gt_up < k), F.struct(up.alias("x"), gt.alias("kept"))).when(~rises & (ge_down >= k), F.struct(down.alias("x"), ge_down.alias("kept")))
    rows = j.select(*by, *_BRACKET, F.when(rises, low).alias("low"), F.when(~rises, high).alias("high"), snapped.alias("snapped"))
    # the tightest cuts of the round's trial points
    best = rows.groupBy(*by, *_BRACKET).agg(F.max("low").alias("low"), F.min("high").alias("high"), F.max("snapped").alias("snapped"))
    pick = lambda side, field, name: F.coalesce(F.col(f"{side}.{field}"), F.col(name)).alias(name)
    moved = best.select(
        *by, "keep_permille", "n", "k", pick("low", "x", "lo"), pick("high", "x", "hi"), pick("low", "f", "f_lo"), pick("low", "g", "g_lo"),
        pick("high", "f", "f_hi"), pick("high", "g", "g_hi"), pick("high", "over", "over"), pick("high", "over_sum", "over_sum"), F.col("snapped.x").alias("cutoff"), F.col("snapped.kept").alias("kept"),
    )
    return moved.unionByName(state.where("cutoff IS NOT NULL"))


def _search(hist: DataFrame, targets: DataFrame, source: list[str], trials: int) -> DataFrame:
    by, open_count = _ids(source), F.sum(F.col("cutoff").isNull().cast("long"))
    hist = materialise(hist, "scores")
    state, seen = materialise(_start(hist, targets, source, by), "bracket", open=open_count)
    rounds = 0
    while seen["open"]:
        rounds += 1
        if rounds > 1 and rounds % 2:
            whole, hist = hist, materialise(_inside(hist, state, by), "scores")
            superseded(whole)
        before = state
        state, seen = materialise(_cut(hist, state, by, trials), "bracket", open=open_count)
        superseded(before)
    return state


def cutoffs(hist: DataFrame, targets: DataFrame, source: list[str], trials: int = TRIALS) -> DataFrame:
    """(source, keep_permille, n, k, cutoff, kept) of each source with a target.

    ``hist`` comes from ``histogram``, ``targets`` has (source, keep_permille).
    The cutoff is the highest score for which the records at or above it number
    at least n * keep_permille / 1000; ``kept`` counts them, ties included.  A
    target of 0 keeps the highest score's records, one of 1000 or more all.
    Sources without usable scores or without a target don't come out.  Empty
    tables give an empty result.  A result column named like one of the source
    gets a trailing underscore.
    """
    state = _search(hist, targets, source, trials)
    return state.select(*[F.col(i).alias(c) for c, i in zip(source, _ids(source), strict=True)], *[F.col(c).alias(f"{c}_" if c in source else c) for c in ("keep_permille", "n", "k", "cutoff", "kept")])


def keep(records: DataFrame, targets: DataFrame, source: list[str], score: str, scale: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept records, cutoffs): the records at or above their source's cutoff.

    All columns of ``records`` stay, whatever their names; those of the cutoffs
    aren't added.  Records with a NULL source or score are never kept.
    """
    found = cutoffs(histogram(records, source, score, scale), targets, source)
    name = "cutoff_" if "cutoff" in source else "cutoff"
    limit = found.select(*[F.col(c).alias(f"_source_{i}") for i, c in enumerate(source)], F.col(name).alias("_cutoff"))
    match = [F.col(c) == F.col(f"_source_{i}") for i, c in enumerate(source)] + [units(records, score, scale) >= F.col("_cutoff")]
    return records.join(limit, match, "left_semi"), found
