"""Perceptrons in steps taken together: the gradient by differences, the same minimum as Spark's learner from the same start."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillwave.operators import learn, metrics, networks


def test_gradient_by_differences():
    rng = np.random.default_rng(3)
    layers = [3, 5, 4, 2]
    x, y = rng.random((2500, 3)), rng.integers(0, 2, 2500)
    w = networks.first_weights(layers, 42)
    loss, grad = networks.loss_gradient(w, layers, x, y)
    for i in rng.integers(0, len(w), 12):
        d = np.zeros(len(w))
        d[i] = 1e-5
        sides = [networks.loss_gradient(w + s * d, layers, x, y)[0] for s in (1, -1)]
        assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(grad[i], rel=1e-5, abs=1e-3)
    single = networks.loss_gradient(w, layers, x.astype(np.float32), y)
    assert single[0] == pytest.approx(loss, rel=1e-5) and np.linalg.norm(single[1] - grad) < 1e-5 * np.linalg.norm(grad)


def test_minimum_of_a_curved_valley():
    step = networks.minimise(np.array([-1.2, 1.0]), 200, 1e-12)
    x = next(step)
    try:
        while True:
            a, b = x
            x = step.send(((1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])))
    except StopIteration as end:
        assert end.value == pytest.approx([1, 1], abs=1e-4)


def _rows(spark):
    rng = random.Random(9)
    rows = []
    for i in range(900):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((float(a * b + rng.gauss(0, 0.3) > 0), a, b, 1 + 2 * (i % 3 > 0)))  # model 1 learns two thirds
    return spark.createDataFrame(rows, "y double, a__x double, b__x double, _drawn long")


def test_the_same_as_sparks_from_the_same_start(spark):
    rows, features = _rows(spark), ["a__x", "b__x"]
    start = networks.first_weights([2, 6, 4, 2], 1)
    learner = MultilayerPerceptronClassifier(layers=[2, 6, 4, 2], maxIter=200, labelCol="y", featuresCol="v", initialWeights=Vectors.dense(start))
    unit = (np.zeros(2), np.ones(2))
    both = networks.fit_networks(learner, rows, features, [unit, unit])
    for i, mine in enumerate(both):
        fit = VectorAssembler(inputCols=features, outputCol="v").transform(rows.where(F.col("_drawn").bitwiseAND(1 << i) != 0))
        model = learner.fit(fit.coalesce(1))
        own = fit.withColumn("p", networks.probability(mine, learner, unit, features))
        seen = np.asarray([(r.y, r.p, r.q) for r in model.transform(own).select("y", "p", vector_to_array("probability")[1].alias("q")).collect()])
        assert len(seen) == (900 if i == 0 else 600)
        loss = [-np.log(np.maximum(1e-12, np.where(seen[:, 0] == 1, seen[:, j], 1 - seen[:, j]))).mean() for j in (1, 2)]
        assert loss[0] < loss[1] + 0.02 and loss[0] < 0.4


def test_folds_draw_the_same_rows_as_balanced(spark):
    rng = random.Random(5)
    raw = spark.createDataFrame([(float(i % 40 == 0), f"f{i % 7}", i, i % 3, rng.random()) for i in range(1200)], "y double, filename string, start_ms long, _fold int, a__x double")
    key = ["filename", "start_ms"]
    data, weights, ranges = learn._divided(raw, key, ["a__x"], [0, 1, 2])
    for i in range(3):
        wanted = {(r.filename, r.start_ms): r.weight for r in learn.balanced(raw.where(f"_fold <> {i}"), key).collect()}
        found = data.where(learn._fits(i)).collect()
        assert {(r.filename, r.start_ms) for r in found} == set(wanted) and len(found) == len(wanted) < 800
        assert all(weights[i][r.y] == pytest.approx(wanted[r.filename, r.start_ms]) for r in found)
        assert [ranges[i][0][0], ranges[i][1][0]] == [min(r.a__x for r in found), max(r.a__x for r in found)]


def test_all_folds_in_one_job_a_step(spark, monkeypatch):
    """A job for each fold and step on Spark's learner, in plain Java, took too long on 0.1 GB."""
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda *_: pytest.fail("by Spark's learner"))
    asked = []
    once = networks._evaluate
    monkeypatch.setattr(networks, "_evaluate", lambda blocks, layers, wanted, ranges: asked.append(len(wanted)) or once(blocks, layers, wanted, ranges))
    monkeypatch.setattr(learn, "forest", lambda: learn.RandomForestClassifier(numTrees=5, maxDepth=3, seed=1, labelCol="y", featuresCol="v", weightCol="weight"))
    rows = _rows(spark).selectExpr("*", "CAST(y AS INT) AS label", "'f' AS filename", "monotonically_increasing_id() AS start_ms", "concat('s', pmod(hash(a__x), 20)) AS subject").drop("y", "_drawn")
    found = {r.model: (r.auc, r.n) for r in learn.held_out_auc(rows, ["a__x", "b__x"], "label", "subject").collect()}
    assert asked[0] == 5 and found["mlp"][0] > 0.85 > found["logreg"][0] and {n for _, n in found.values()} == {900}


def test_many_rows_are_learned_in_passes(spark, monkeypatch):
    """200 steps of L-BFGS for each fold, each over all rows, took too long on 1 GB."""
    rows, features = _rows(spark), ["a__x", "b__x"]
    learner, unit = MultilayerPerceptronClassifier(layers=[2, 6, 4, 2], maxIter=60, seed=3, labelCol="y", featuresCol="v"), (np.zeros(2), np.ones(2))
    monkeypatch.setattr(networks, "MANY", 900)
    monkeypatch.setattr(networks, "BATCH", 4)
    monkeypatch.setattr(networks, "_evaluate", lambda *_: pytest.fail("by steps over all rows"))
    monkeypatch.setattr(networks, "_sizes", lambda *a, own=networks._sizes: sizes.append(own(*a)) or sizes[0])
    sizes: list = []
    found = networks.fit_networks(learner, rows, features, [unit, unit])
    assert sizes == [[900, 600]]
    data = np.asarray([tuple(r) for r in rows.select(*features, "y", "_drawn").collect()])
    for i in range(2):
        part = data[data[:, 3].astype(int) >> i & 1 == 1]
        assert networks.loss_gradient(found[i], [2, 6, 4, 2], part[:, :2], part[:, 2])[0] / len(part) < 0.4


def test_lines_are_those_of_spark(spark):
    rows, features = _rows(spark).selectExpr("CAST(a__x + b__x > 0.5 * sin(7 * a__x * b__x) AS DOUBLE) AS y", "a__x", "b__x", "_drawn"), ["a__x", "b__x"]
    weights, unit = {0.0: 0.8, 1.0: 1.3}, (np.zeros(2), np.ones(2))
    blocks = networks.blocks_of(rows, features)
    mine = networks.fit_lines(blocks, [weights, weights], [1 / 900, 1 / 600], 200, [unit, unit])
    blocks.unpersist()
    for i, n in enumerate((900, 600)):
        fit = VectorAssembler(inputCols=features, outputCol="v").transform(rows.where(learn._fits(i)).withColumn("weight", learn._weight(weights)))
        line = learn.logistic(n).setTol(1e-12).fit(fit)
        assert mine[i] == pytest.approx([*line.coefficients.toArray(), line.intercept], rel=1e-4, abs=1e-4)


def test_area_by_blocks(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(k, round(rng.random() ** 3, 2), float(rng.random() < 0.3)) for k in ("a", "b") for _ in range(500)] + [("c", 0.5, 1.0), ("a", None, 1.0), ("a", 0.5, None)], "k string, p double, y double")
    found = {r.k: r for r in metrics.auc_by_blocks(rows, ["k"], "p", "y", F.floor(F.col("p") * 8)).collect()}
    for r in metrics.auc_roc(rows, ["k"], "p", "y").collect():
        assert found[r.k].auc == (None if r.auc is None else pytest.approx(r.auc, abs=1e-12))
    assert {k: r.n for k, r in found.items()} == {"a": 500, "b": 500, "c": 1} and found["c"].auc is None
