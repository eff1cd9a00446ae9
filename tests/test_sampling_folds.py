from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from quillwave.operators import folds, sampling
from tests.conftest import rows


def test_order_statistics_are_exact(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FEW", 5)
    monkeypatch.setattr(sampling, "STEPS", 8)
    rng = random.Random(3)
    data = [(rng.gauss(0, 1), rng.choice([1.0, 2.0, None]), float(rng.randrange(10)) ** 9, float("nan") if i % 3 else -1e300 * rng.random(), None) for i in range(701)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double")
    got = sampling.order_statistics(df, ["a", "b", "c", "d", "e"], [0.0, 0.25, 0.5, 0.95, 1.0])
    for i, c in enumerate("abcd"):
        x = [r[i] for r in data if r[i] is not None and r[i] == r[i]]
        assert np.allclose(got[c], np.quantile(x, [0, 0.25, 0.5, 0.95, 1.0]), rtol=1e-12), c
    assert got["e"] == [None] * 5
    assert sampling.order_statistics(df.where("false"), ["a"], [0.5]) == {"a": [None]}
    huge = spark.createDataFrame([(x,) for x in (-1.7e308, 1.7e308, 5e-324, 0.0, 1e-323, 2.0, 3.0)], "x double")
    assert sampling.order_statistics(huge, ["x"], [0.5, 1.0])["x"] == [1e-323, 1.7e308]
    filled = sampling.impute_median(df, ["b", "e"])
    assert filled.where("b IS NULL").count() == 0 and filled.where("e IS NULL").count() == 701


def test_lots_equal_ranking_everything(spark):
    from pyspark.sql import Window

    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([0, 0, 0, 0, 1, None]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, label int, id int")
    plain = df.withColumn("p", F.count_if(F.col("label") == 1).over(Window.partitionBy("g"))).withColumn("r", F.row_number().over(Window.partitionBy("g", "label").orderBy(sampling.lot("id"), "id")))
    want = plain.where("label = 1 OR (label = 0 AND r <= 2 * p)").select("g", "label", "id")
    assert rows(sampling.undersample(df, ["g"], "label", ["id"], 2)) == rows(want)
    for each in (0, 1, 100, 10_000):
        want = df.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(sampling.lot("id"), "id"))).where(F.col("r") <= each).drop("r")
        assert rows(sampling.stratified(df, "label", ["id"], each)) == rows(want)
    assert sampling.undersample(df.where("false"), ["g"], "label", ["id"]).count() == 0


def test_dealing_classes_equals_dealing_one_by_one():
    rng = random.Random(5)
    for _ in range(200):
        weights = [rng.choice([0, 1, 1, 2, 3, 10, 50]) for _ in range(rng.randrange(1, 60))]
        k, cap = rng.randrange(1, 6), rng.random() < 0.5
        one = folds.balanced_folds(weights, [str(i) for i in range(len(weights))], k, cap=cap)
        classes = sorted(set(weights), reverse=True)
        got = folds.fold_counts(classes, [weights.count(w) for w in classes], k, cap)
        assert got == [[sum(f == i and w == c for f, w in zip(one, weights, strict=True)) for i in range(k)] for c in classes]


def test_large_groups_get_the_same_loads(spark):
    rng = random.Random(6)
    data = [("a", f"s{i}", rng.randrange(4)) for i in range(300)] + [("b", f"s{i}", 5) for i in range(7)]
    df = spark.createDataFrame(data, "g string, s string, w int")
    weight = {(g, s): w for g, s, w in data}
    results = []
    for most in (10_000, 10):
        found = folds.fold_plan(df, ["g"], "s", "w", folds=4, most=most).collect()
        assert len(found) == len(data) == len({(r.g, r.s) for r in found})
        results.append(sorted((r.g, r.fold, weight[r.g, r.s]) for r in found))
    assert results[0] == results[1]


def test_drained_stream_takes_the_last_state_of_each_key(spark, tmp_path):
    from quillwave.streaming import jobs

    for i, part in enumerate([[("r", 1, 0.5)], [("r", 2, 0.25), ("q", 3, None)]]):
        spark.createDataFrame(part, "run_id string, at int, prob double").selectExpr("run_id", "timestamp_seconds(at) AS written_at", "prob").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        assert i < 2
    found = jobs.drain(jobs.windowed_scores(jobs.source(spark, str(tmp_path / "t"), 1)), ["run_id", "week_start"])
    assert rows(found, "run_id", "n", "n_usable", "units") == [("q", 1, 0, None), ("r", 2, 2, 7500)]
