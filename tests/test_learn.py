"""Learners: every row is scored by models that haven't seen its group; only fit rows are undersampled."""

from __future__ import annotations

import random

from quillwave.operators import learn


def _rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        label = int(i % 31 == 0)
        rows.append((f"s{i % 15}", f"f{i % 15}", i, label, rng.gauss(2.0 * label, 1.0), rng.gauss(0.0, 1.0)))
    return spark.createDataFrame(rows, "subject string, filename string, start_ms long, label int, a__x double, b__x double")


def test_sizes_of_the_models(spark):
    assert learn.forest().getNumTrees() == 300
    assert learn.perceptron(7).getLayers() == [7, 64, 32, 2] and learn.perceptron(7).getMaxIter() == 200


def test_undersampling(spark):
    fit = learn.complete(_rows(spark), ["a__x", "b__x"], "label")
    drawn = learn.balanced(fit, ["filename", "start_ms"]).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in drawn} == {1.0: 20, 0.0: 200}


def test_every_fold_is_scored_once(spark, monkeypatch):
    monkeypatch.setattr(learn, "forest", lambda: learn.RandomForestClassifier(numTrees=5, maxDepth=3, seed=1, labelCol="y", featuresCol="v", weightCol="weight"))
    found = {r.model: (r.auc, r.n) for r in learn.held_out_auc(_rows(spark), ["a__x", "b__x"], "label", "subject").collect()}
    assert {n for _, n in found.values()} == {600} and set(found) == {"rf", "logreg", "mlp"}
    assert found["logreg"][0] > 0.8


def _small(monkeypatch):
    monkeypatch.setattr(learn, "forest", lambda *_: learn.RandomForestClassifier(numTrees=5, maxDepth=3, seed=1, labelCol="y", featuresCol="v", weightCol="weight"))


def test_queries_of_learners_after_the_other_queries_of_a_session(spark, monkeypatch):
    """Consolidation and components first: nothing that they do may break a model's transform later in the session."""
    from quillwave.plans import core_problems, q_features, q_reports
    from tests.conftest import DATA

    _small(monkeypatch)
    assert core_problems.p2_found(spark, str(DATA)).count() > 0
    found = {r.model: r.auc for r in q_features.model_scores(spark, str(DATA)).collect()}
    assert set(found) == {"rf", "logreg", "mlp"} and all(0 <= a <= 1 for a in found.values())
    ranks = q_features.rf_channel_rank(spark, str(DATA)).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, len(ranks) + 1))
    assert [r.channel for r in sorted(ranks, key=lambda r: r["rank"])] == [r.channel for r in sorted(ranks, key=lambda r: (-r.importance, r.channel))]
    pools = q_reports.paired_pools(spark, str(DATA)).collect()
    assert sum(r.fold is None for r in pools) == 1 and sum(r.n_test for r in pools if r.fold is not None) == [r.n_test for r in pools if r.fold is None][0]


def test_an_informative_feature_raises_the_paired_area(spark, monkeypatch):
    _small(monkeypatch)
    found = {r.fold: r for r in learn.paired_auc(_rows(spark), ["b__x"], "a__x", "label", "subject").collect()}
    assert found[None].n_test == 600 and found[None].auc_with > 0.8 > found[None].auc_without
