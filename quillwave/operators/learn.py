"""Learners on window features, by Spark's own library.

They aren't numerically those of other libraries: forests are of limited depth
with binned splits, the perceptron has sigmoid layers and no class weights.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.operators.folds import fold_plan
from quillwave.operators.forests import count_cells, fit_forest, ranks_of, without_last
from quillwave.operators.metrics import auc_by_blocks, auc_roc
from quillwave.operators.networks import blocks_of, fit_lines, fit_networks
from quillwave.operators.networks import probability as network
from quillwave.operators.sampling import lot, undersample
from quillwave.session import materialise, release


def complete(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows with every feature and a label."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*features, label]])).withColumn("y", F.col(label).cast("double"))


def class_weights(counts: dict[float, int]) -> dict[float, float]:
    """The balanced weight of each class that there is."""
    there = {y: n for y, n in counts.items() if n}
    return {y: sum(there.values()) / (len(there) * n) for y, n in there.items()}


def _weight(weights: dict[float, float]) -> Column:
    return F.when(F.col("y") == 1, F.lit(weights.get(1.0))).otherwise(F.lit(weights.get(0.0)))


def balanced(fit: DataFrame, key: Sequence[str], per_positive: int = 10) -> DataFrame:
    """All positives of ``fit`` and at most ``per_positive`` negatives for each, by lot, with their balanced class weight."""
    counts = _counts(fit)
    good = fit.where("y IN (0, 1)")
    if counts.get(0.0, 0) > (most := per_positive * counts.get(1.0, 0)):  # else all are taken
        good = undersample(fit.withColumn("_all", F.lit(1)), ["_all"], "y", list(key), per_positive).drop("_all")
        counts[0.0] = most
    return good.withColumn("weight", _weight(class_weights(counts)))


def _counts(fit: DataFrame) -> dict[float, int]:
    return {r[0]: r[1] for r in fit.where("y IN (0, 1)").groupBy("y").count().collect()}


def forest(trees: int = 300, depth: int = 8, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="y", featuresCol="v", weightCol="weight")


def logistic(rows: int, strength: float = 1.0) -> LogisticRegression:
    return LogisticRegression(regParam=1 / (strength * max(1, rows)), elasticNetParam=0.0, standardization=False, maxIter=200, labelCol="y", featuresCol="v", weightCol="weight")


def perceptron(inputs: int, seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, 64, 32, 2], maxIter=200, seed=seed, labelCol="y", featuresCol="v")


def channel_ranks(rows: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ("filename", "start_ms")) -> DataFrame:
    """(channel, importance, rank): a forest's importances summed over each channel's features."""
    good = materialise(complete(rows, features, label).select("y", *key, *features), "learning")
    fit = balanced(good, key)
    model = fit_forest(forest(), fit, features, class_weights(_counts(fit)))
    spark = rows.sparkSession
    found = spark.createDataFrame([(c.split("__")[0], float(i)) for c, i in zip(features, model.importances, strict=True)], "channel string, importance double")
    summed = found.groupBy("channel").agg(F.sum("importance").alias("importance"))
    order = Window.orderBy(F.col("importance").desc(), "channel")  # a row per channel
    return summed.select("channel", F.round("importance", 6).alias("importance"), F.row_number().over(order).alias("rank"))


def _divided(data: DataFrame, key: Sequence[str], features: Sequence[str], folds: Sequence[int], per_positive: int = 10) -> tuple[DataFrame, list[dict[float, float]], list[tuple[np.ndarray, np.ndarray]]]:
    """(rows with bit i of ``_drawn`` where they are drawn to fit fold i, class weights, ranges of the features), the latter for each fold.

    The same rows are drawn as by ``balanced`` of the other folds' rows: negatives
    up to a lot, where there are too many of them.
    """
    counts = {(r[0], r[1]): r[2] for r in data.where("y IN (0, 1)").groupBy("_fold", "y").count().collect()}
    order = F.struct(lot(*key).alias("_lot"), *key)
    types = {"_lot": "string", **{k: data.schema[k].dataType for k in key}}
    bits, weights = [], []
    for i, f in enumerate(folds):
        n = {y: sum(n for (fold, of), n in counts.items() if fold != f and of == y) for y in (0.0, 1.0)}
        inside = (F.col("_fold") != f) & F.col("y").isin(0.0, 1.0)
        if n[0.0] > (most := per_positive * n[1.0]):
            others = data.where(inside).withColumn("_all", F.lit(1))
            last = undersample(others, ["_all"], "y", list(key), per_positive).where("y = 0").agg(F.max(order).alias("m")).first()["m"]
            upto = F.struct(*[F.lit(last[k]).cast(t).alias(k) for k, t in types.items()]) if last is not None else None
            inside = inside & ((F.col("y") == 1) | (order <= upto if upto is not None else F.lit(False)))
            n[0.0] = most
        bits.append(F.when(inside, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        weights.append(class_weights(n))
    out = materialise(data.withColumn("_drawn", reduce(lambda a, b: a + b, bits)), "drawn")
    ends = out.agg(*[e(F.when(_fits(i), F.col(c))) for i in range(len(folds)) for e in (F.min, F.max) for c in features]).first()
    k = len(features)
    ranges = [tuple(np.asarray(ends[(2 * i + j) * k : (2 * i + j + 1) * k], float) for j in (0, 1)) for i in range(len(folds))]
    return out, weights, ranges


def _fits(i: int) -> Column:
    return F.col("_drawn").bitwiseAND(F.lit(1 << i)) != 0


def held_out_auc(rows: DataFrame, features: Sequence[str], label: str, group: str, folds: int = 5, key: Sequence[str] = ("filename", "start_ms")) -> DataFrame:
    """(model, auc, n): every fold's groups scored by models fitted on the other folds', all scores pooled.

    Only fit rows are undersampled, and they alone give the range for scaling.
    """
    features = list(features)
    fold = F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")
    data = materialise(complete(rows, features, label).select("y", *key, *features, fold.alias("_fold")), "learning")
    there = sorted(r[0] for r in data.select("_fold").distinct().collect())
    data, weights, ranges = _divided(data, key, features, there)
    learner = perceptron(len(features))
    sizes = list(data.agg(*[F.count_if(_fits(i)) for i in range(len(there))]).first())
    blocks = blocks_of(data, features)
    try:
        networks = fit_networks(learner, data, features, ranges, blocks)
        lines = fit_lines(blocks, weights, [logistic(n).getRegParam() for n in sizes], logistic(1).getMaxIter(), ranges)
    finally:
        blocks.unpersist()
    ranks = ranks_of(data.where("_drawn <> 0"), features, ["_drawn"])  # a fold's rows are those of some of these parts
    drawn = [data.where(_fits(i)).select("y", *features) for i in range(len(there))]

    def score(i: int) -> DataFrame:
        cells = count_cells(forest(), drawn[i], features, weights[i], [r for r in ranks if r["_drawn"] >> i & 1])
        test = fit_forest(forest(), drawn[i], features, weights[i], cells).score(data.where(F.col("_fold") == there[i]).select("y", *features), "rf")
        test = test.withColumn("logreg", _line(lines[i], ranges[i], features)).withColumn("mlp", network(networks[i], learner, ranges[i], features))
        return materialise(test.select("y", *[F.round(c, 9).alias(c) for c in ("rf", "logreg", "mlp")]), "scores")

    found = []
    for i in range(len(there)):  # one after another: side by side, their plans and broadcasts need too much of the driver's memory
        release(rows.sparkSession)
        found.append(score(i))
    pooled = reduce(DataFrame.unionByName, found).unpivot(["y"], ["rf", "logreg", "mlp"], "model", "p")
    return auc_by_blocks(pooled, ["model"], "p", "y", F.floor(F.col("p") * 4096)).select("model", F.round("auc", 4).alias("auc"), "n")


def _units(features: Sequence[str], ends: tuple[np.ndarray, np.ndarray]) -> dict[str, Column]:
    """Features scaled by their range, not clipped; a constant column becomes 0."""
    return {c: (F.col(c) - F.lit(float(low))) / F.lit(float(high - low)) if high > low else F.lit(0.0) for c, low, high in zip(features, *ends, strict=True)}


def _line(model: np.ndarray, ends: tuple[np.ndarray, np.ndarray], features: Sequence[str]) -> Column:
    """The probability of class 1."""
    parts = zip(model[:-1], _units(features, ends).values(), strict=True)
    return 1 / (1 + F.exp(-sum((F.lit(float(w)) * x for w, x in parts), F.lit(float(model[-1])))))


def paired_auc(rows: DataFrame, features: Sequence[str], optional: str, label: str, group: str, folds: int = 5, key: Sequence[str] = ("filename", "start_ms"), trees: int = 50) -> DataFrame:
    """(fold, n_test, auc_without, auc_with, delta): forests without and with one more feature on the same rows and folds.

    Folds hold whole groups and are alike in rows; the row with fold NULL is
    over the held-out scores of all folds.  Forests are of ``trees`` trees.
    """
    one = complete(rows, [*features, optional], label).select("y", group, *key, *features, optional)
    one = materialise(one, "learning")
    plan = fold_plan(one.groupBy(F.lit(1).alias("_one"), group).agg(F.count(F.lit(1)).alias("_n")), ["_one"], group, "_n", folds, cap=False).select(group, F.col("fold").alias("_fold"))
    planned = materialise(one.join(plan, group).select("y", *key, *features, optional, "_fold"), "learning")
    there = sorted(r[0] for r in planned.select("_fold").distinct().collect())
    less, more = list(features), [*features, optional]
    data, weights, _ = _divided(planned, key, more, there)
    scores = []
    for i, fold in enumerate(there):  # the trees of a forest keep all cores busy
        fit, learner = data.where(_fits(i)).select("y", *more), forest(trees)
        cells = count_cells(learner, fit, more, weights[i])
        test = data.where(F.col("_fold") == fold).select("y", *more)
        for name, columns, counted in (("without", less, without_last(cells)), ("with", more, cells)):
            test = fit_forest(learner, fit, columns, weights[i], counted).score(test, name)
        scores.append(materialise(test.select(F.lit(fold).alias("fold"), "y", "without", "with"), "scores"))
    scores = reduce(DataFrame.unionByName, scores).unpivot(["fold", "y"], ["without", "with"], "pool", "p")
    both = scores.unionByName(scores.withColumn("fold", F.lit(-1)))  # -1: all folds
    counts = both.where("pool = 'with'").groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    wide = auc_roc(both, ["fold", "pool"], "p", "y").groupBy("fold").pivot("pool", ["without", "with"]).agg(F.first("auc"))
    out = counts.join(wide, "fold")
    return out.select(F.when(F.col("fold") >= 0, F.col("fold")).alias("fold"), "n_test", F.round("without", 4).alias("auc_without"), F.round("with", 4).alias("auc_with"), F.round(F.col("with") - F.col("without"), 4).alias("delta"))
