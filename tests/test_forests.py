"""Forests on counted cells: the same trees as by brute force, the same forest as Spark's but for its bags."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quillwave.operators import forests, learn


def _rows(spark, n=1500, copies=1):
    rng = random.Random(7)
    rows = []
    for _ in range(n):
        y = float(rng.random() < 0.3)
        rows.append((y, rng.gauss(1.5 * y, 1.0), rng.gauss(0.5 * y, 1.0), float(rng.randrange(3))))
    return spark.createDataFrame(rows * copies, "y double, a__x double, b__x double, c__x double")


def test_a_split_is_the_best_by_brute_force():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 2000, 24)  # 12 bins of one feature
    weights = (1.0, 2.5)
    low, high, share, importance = forests.grow(np.arange(24), counts, [12], weights, 1, (42, 0))
    bag = np.random.Generator(np.random.PCG64([42, 0])).poisson(counts).reshape(12, 2) * weights

    def impurity(part):
        s = part.sum(axis=0)
        return s.sum() - (s**2).sum() / s.sum()

    best = min(range(1, 12), key=lambda t: impurity(bag[:t]) + impurity(bag[t:]))
    one = [bag[:best].sum(axis=0), bag[best:].sum(axis=0)]
    if (one[0][1] > one[0].sum() / 2) == (one[1][1] > one[1].sum() / 2):  # of one prediction: merged
        assert low.tolist() == [[0]] and high.tolist() == [[12]] and importance.tolist() == [0]
    else:
        assert sorted(zip(low[:, 0], high[:, 0])) == [(0, best), (best, 12)]
        assert sorted(share) == pytest.approx(sorted(s[1] / s.sum() for s in one))


def test_leaves_divide_the_cells():
    rng = np.random.default_rng(2)
    dims = [5, 4, 6]
    codes = np.flatnonzero(rng.random(240) < 0.7)
    low, high, share, _ = forests.grow(codes, rng.integers(1, 9, len(codes)), dims, (1.0, 1.0), 8, (42, 3))
    assert len(low) > 8 and forests.paint(low, high, np.ones(len(low)), dims).tolist() == np.ones(dims).tolist()
    one = forests.paint(low, high, share, dims)
    for a, b, p in zip(low, high, share, strict=True):
        assert one[tuple(slice(x, y) for x, y in zip(a, b, strict=True))] == pytest.approx(p, abs=1e-11)


def test_the_same_forest_as_sparks(spark):
    rows, features, weights = _rows(spark), ["a__x", "b__x", "c__x"], {0.0: 0.7, 1.0: 1.7}
    learner = learn.forest(60, 5)
    mine, theirs = forests.fit_forest(learner, rows, features, weights), forests._by_spark(learner, rows, features, weights)
    assert mine.importances == pytest.approx(theirs.importances, abs=0.05) and sum(mine.importances) == pytest.approx(1)
    both = np.asarray([(r.p, r.q) for r in theirs.score(mine.score(rows, "p"), "q").select("p", "q").collect()])
    assert np.corrcoef(both.T)[0, 1] > 0.98 and abs(both[:, 0] - both[:, 1]).mean() < 0.03


def test_rare_values_have_a_bin(spark):
    rows = spark.range(20_000).selectExpr("CAST(id % 2 AS DOUBLE) AS y", "CAST(id = 77 AS DOUBLE) AS a", "1.0D AS b", "CAST(id AS DOUBLE) AS c")
    a, b, c = forests.bin_edges(rows, ["a", "b", "c"], {0.0: 1.0, 1.0: 1.0}, 32)
    assert a.tolist() == [0.5] and b.tolist() == [] and len(c) == 31
    assert np.diff(np.concatenate([[0], c, [20_000]])) == pytest.approx(np.full(32, 625), abs=25)


def test_cells_don_t_grow_with_the_rows(spark):
    features = ["a__x", "b__x", "c__x"]
    edges = forests.bin_edges(_rows(spark), features, {}, 32)
    codes, counts = forests._cells(_rows(spark), features, edges)
    more, many = forests._cells(_rows(spark, copies=4), features, edges)
    assert counts.sum() == 1500 and more.tolist() == codes.tolist() and many.tolist() == (4 * counts).tolist()


def test_ranks_of_channels_leave_no_level_to_sparks_jobs(spark, monkeypatch):
    """A job for each level, with the statistics of all nodes shuffled, took too long on 0.1 GB."""
    monkeypatch.setattr(learn.RandomForestClassifier, "fit", lambda *_: pytest.fail("by Spark's learner"))
    rows = _rows(spark).selectExpr("*", "CAST(y AS INT) AS label", "'f' AS filename", "monotonically_increasing_id() AS start_ms").drop("y")
    ranks = {r.channel: r["rank"] for r in learn.channel_ranks(rows, ["a__x", "b__x", "c__x"], "label").collect()}
    assert ranks == {"a": 1, "b": 2, "c": 3}


def test_cells_without_a_feature_are_those_counted_without_it(spark):
    rows, weights = _rows(spark), {0.0: 0.7, 1.0: 1.7}
    learner = learn.forest(20, 4)
    fewer = forests.without_last(forests.count_cells(learner, rows, ["a__x", "b__x", "c__x"], weights))
    edges, codes, counts = forests.count_cells(learner, rows, ["a__x", "b__x"], weights)
    assert [e.tolist() for e in fewer[0]] == [e.tolist() for e in edges]
    assert fewer[1].tolist() == codes.tolist() and fewer[2].tolist() == counts.tolist()


def test_paired_areas_leave_no_level_to_sparks_jobs(spark, monkeypatch):
    """Ten forests, each with a job a level, took too long on 1 GB; the rows of a fold are counted once for both."""
    monkeypatch.setattr(learn.RandomForestClassifier, "fit", lambda *_: pytest.fail("by Spark's learner"))
    counted, once = [], forests._cells
    monkeypatch.setattr(forests, "_cells", lambda *a: counted.append(1) or once(*a))
    rows = _rows(spark).selectExpr("*", "CAST(y AS INT) AS label", "'f' AS filename", "monotonically_increasing_id() AS start_ms", "concat('s', pmod(hash(a__x), 20)) AS subject").drop("y")
    found = {r.fold: r for r in learn.paired_auc(rows, ["b__x", "c__x"], "a__x", "label", "subject").collect()}
    assert len(counted) == 5 and found[None].n_test == 1500 and found[None].auc_with > found[None].auc_without + 0.15
