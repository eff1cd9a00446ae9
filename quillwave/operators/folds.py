"""Subject-wise fold plans and the roles subjects have in them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwave.operators.records import positions

#: Groups of up to this many subjects are dealt one by one in one task; larger ones by their counts of equal weights.
MOST_SUBJECTS = 10_000


def fold_roles(members: DataFrame, plan: str = "plan_id", fold: str = "fold", subject: str = "subject") -> DataFrame:
    """(plan, test_fold, subject, role): the fold itself is tested, the next one tunes, the rest fit.

    Folds are numbered from 0 in their order within the plan, so gaps are fine.
    """
    numbered = members.withColumn("_i", F.dense_rank().over(Window.partitionBy(plan).orderBy(F.col(fold).cast("int"))) - 1)
    folds = numbered.groupBy(plan).agg(F.max("_i").alias("_last"))
    tests = folds.select(plan, "_last", F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("test_fold"))
    role = F.when(F.col("_i") == F.col("test_fold"), "test").when(F.col("_i") == F.pmod(F.col("test_fold") + 1, F.col("_last") + 1), "tuning").otherwise("fit")
    return numbered.join(tests, plan).select(plan, "test_fold", subject, role.alias("role"))


def ring_pool(subjects: DataFrame, group: list[str], order: str, ahead: int = 3) -> DataFrame:
    """(group, held_out, tuning): for each subject the next few in a ring ordered by ``order``."""
    w, whole = Window.partitionBy(*group).orderBy(order), Window.partitionBy(*group)
    placed = subjects.select(*group, order).distinct().withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    wanted = placed.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(ahead)))).where("_k < _n")
    wanted = wanted.select(*group, F.col(order).alias("held_out"), F.pmod(F.col("_i") + F.col("_k"), F.col("_n")).alias("_i"))
    return wanted.join(placed.select(*group, F.col(order).alias("tuning"), "_i"), [*group, "_i"]).drop("_i")


def balanced_folds(counts: list[int], names: list[str], folds: int, seed: int = 42, cap: bool = True) -> list[int]:
    """The fold of each subject: heaviest first to the lightest fold, at most ceil(n / folds) in each.

    Equal weights are taken in a seeded random order.
    """
    shuffled = np.random.RandomState(seed).permutation(len(names))
    order = sorted(shuffled, key=lambda i: -counts[i])
    most = -(-len(names) // folds) if cap else len(names)
    load, size, out = [0] * folds, [0] * folds, [0] * len(names)
    for i in order:
        f = min((f for f in range(folds) if size[f] < most), key=lambda f: (load[f], f))
        out[i] = f
        load[f] += counts[i]
        size[f] += 1
    return out


def fold_counts(weights: list[int], counts: list[int], folds: int, cap: bool = True) -> list[list[int]]:
    """How many subjects of each weight (descending) go to each fold: what dealing them one by one gives.

    Equal weights go to the folds in order of the load that each would have
    before its next one; so a class is dealt at once by finding that load.
    """
    total = sum(counts)
    free = [-(-total // folds) if cap else total] * folds
    load, out = [0] * folds, []
    for w, n in zip(weights, counts, strict=True):
        fits = lambda t, f: min(free[f], 0 if load[f] > t else n if w == 0 else (t - load[f]) // w + 1)  # noqa: E731, B023
        low, high = min(load), max(load) + w * n
        while low < high:  # the least load up to which n of them start
            mid = (low + high) // 2
            low, high = (low, mid) if sum(fits(mid, f) for f in range(folds)) >= n else (mid + 1, high)
        below = [fits(low - 1, f) for f in range(folds)]
        left = n - sum(below)
        for f in range(folds):  # those that start at that very load: the earlier folds first
            more = min(left, fits(low, f) - below[f])
            below[f] += more
            left -= more
        for f in range(folds):
            load[f] += w * below[f]
            free[f] -= below[f]
        out.append(below)
    return out


def fold_plan(weights: DataFrame, group: list[str], subject: str, weight: str, folds: int = 5, seed: int = 42, cap: bool = True, most: int = MOST_SUBJECTS) -> DataFrame:
    """(group, subject, fold): a balanced plan for each group.

    Groups of more than ``most`` subjects get the same loads from the counts of
    their weights; who is where among equal weights is drawn by lot.
    """
    import pandas as pd

    sizes = weights.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    sized = weights.select(*group, subject, F.col(weight).cast("long").alias("_weight")).join(sizes, group)
    types = {f.name: f.dataType.simpleString() for f in weights.schema}
    keys = ", ".join(f"{c} {types[c]}" for c in group)

    def plan(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(subject)
        return block[[*group, subject]].assign(fold=balanced_folds(block["_weight"].tolist(), block[subject].tolist(), folds, seed, cap))

    def deal(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_weight", ascending=False)
        return block[[*group, "_weight"]].assign(_each=fold_counts(block["_weight"].tolist(), block["_n"].tolist(), folds, cap))

    small = sized.where(F.col("_size") <= most).groupBy(*group).applyInPandas(plan, f"{keys}, {subject} {types[subject]}, fold int")
    large = sized.where(F.col("_size") > most)
    classes = large.groupBy(*group, "_weight").agg(F.count(F.lit(1)).alias("_n")).groupBy(*group).applyInPandas(deal, f"{keys}, _weight long, _each array<long>")
    lot = F.md5(F.concat_ws("|", F.col(subject).cast("string"), F.lit(str(seed))))
    # equal weights are numbered in two levels, so that a weight that most subjects have is no task
    numbered = positions(large.withColumn("_lot", lot), [*group, "_weight"], ["_lot", subject], F.substring("_lot", 1, 4), "_place")
    upto = F.transform("_each", lambda _, i: F.aggregate(F.slice("_each", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, v: a + v))
    fold = F.size(F.filter(upto, lambda u: u <= F.col("_place")))
    dealt = numbered.join(classes, [*group, "_weight"]).select(*group, subject, fold.cast("int").alias("fold"))
    return small.unionByName(dealt)
