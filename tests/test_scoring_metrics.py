from __future__ import annotations

import random

import pytest

from quillwave.operators import catalog, folds, metrics, sampling, sweep
from quillwave.operators.scoring import ANY_HIT, COVER_70, rates, score
from tests.conftest import rows

EVENT = "run string, start_ms long, end_ms long"


def totals(spark, refs, hyps, rule, duration=3600.0):
    files = spark.createDataFrame([("r", duration)], "run string, duration_sec double")
    ev = lambda x: spark.createDataFrame([("r", a * 1000, b * 1000) for a, b in x], EVENT)
    return rows(score(ev(refs), ev(hyps), files, rule, ["run"]))[0][1:]


def test_any_overlap_with_tolerance(spark):
    assert totals(spark, [(100, 120)], [(70, 75)], ANY_HIT) == (1, 0, 1)  # within the 30 s before
    assert totals(spark, [(100, 120)], [(60, 65)], ANY_HIT) == (0, 1, 1)
    assert totals(spark, [(100, 120)], [], ANY_HIT) == (0, 0, 1)
    assert totals(spark, [], [(5, 9)], ANY_HIT) == (0, 1, 0)


def test_cover_70_drops_short_events(spark):
    assert totals(spark, [(100, 200)], [(100, 170)], COVER_70) == (1, 0, 1)
    assert totals(spark, [(100, 200)], [(100, 169)], COVER_70) == (0, 1, 1)
    assert totals(spark, [(100, 200)], [(100, 110)], COVER_70) == (0, 0, 1)


def test_long_references_are_split_and_clipped(spark):
    assert totals(spark, [(0, 752)], [(0, 752)], ANY_HIT) == (3, 0, 3)
    assert totals(spark, [(3500, 9999)], [], ANY_HIT)[2] == 1
    assert totals(spark, [(4000, 4100)], [(4000, 4100)], ANY_HIT) == (0, 0, 0)


def test_undefined_rates_are_null_and_meet_nothing(spark):
    t = rates(spark.createDataFrame([("r", 0, 0, 0, 2.0)], "run string, tp int, fp int, ref_true int, hours double"))
    assert rows(t, "sens", "fa_per_day") == [(None, 0.0)]
    assert rows(sweep.criteria_met(t, 0.0, 5.0), "met") == [(False,)]


def test_pick_threshold(spark):
    curve = spark.createDataFrame([("a", 10, 0.9, 9.0), ("a", 20, 0.8, 4.0), ("a", 30, 0.8, 3.0), ("b", 10, 0.9, 9.0), ("b", 20, 0.5, 7.0), ("b", 30, 0.6, 7.0), ("c", 10, None, None)], "run string, threshold int, sens double, fa_per_day double")
    assert rows(sweep.pick_threshold(curve, "run", 5.0, False), "run", "threshold") == [("a", 20)]
    assert rows(sweep.pick_threshold(curve, "run", 5.0, True), "run", "threshold", "ceiling_met") == [("a", 20, True), ("b", 30, False), ("c", 10, False)]


def test_threshold_grid():
    grid = sweep.threshold_units()
    assert len(grid) == 279 and grid[0] == 1 and grid[-1] == 9900


def test_auc_and_ap_equal_brute_force(spark):
    rng = random.Random(5)
    data = [("r", rng.randrange(12), int(rng.random() < 0.3)) for _ in range(80)]
    pos, neg = [s for _, s, y in data if y], [s for _, s, y in data if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap = before = 0.0
    for t in sorted({s for _, s, _ in data}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap += (tp / len(pos) - before) * tp / sum(s >= t for _, s, _ in data)
        before = tp / len(pos)
    df = spark.createDataFrame(data, "r string, units int, label int")
    assert rows(metrics.auc_roc(df, ["r"], "units", "label"))[0][1] == pytest.approx(auc)
    assert rows(metrics.average_precision(df, ["r"], "units", "label"))[0][1] == pytest.approx(ap)
    assert rows(metrics.auc_roc(df.where("label = 0"), ["r"], "units", "label")) == [("r", None)]


def test_balanced_folds_and_roles(spark):
    plan = folds.balanced_folds([9, 7, 5, 3, 1, 1], list("abcdef"), 3)
    assert sorted(plan.count(f) for f in range(3)) == [2, 2, 2]
    members = spark.createDataFrame([(1, str(f), s) for f, s in enumerate("abcde")], "plan_id long, fold string, subject string")
    got = [r for r in rows(folds.fold_roles(members), "test_fold", "subject", "role") if r[0] == 4]
    assert got == [(4, "a", "tuning"), (4, "b", "fit"), (4, "c", "fit"), (4, "d", "fit"), (4, "e", "test")]
    ring = rows(folds.ring_pool(members, ["plan_id"], "subject"), "held_out", "tuning")
    assert [t for h, t in ring if h == "d"] == ["a", "b", "e"]


def test_sampling_and_scaling(spark):
    data = [("s", i, int(i < 3), float(i)) for i in range(50)] + [("t", 99, 0, None)]
    df = spark.createDataFrame(data, "g string, key long, label int, x double")
    sample = sampling.undersample(df, ["g"], "label", ["key"], per_positive=2)
    assert [r[0] for r in rows(sample.groupBy("label").count(), "count")] == [3, 6]
    scaled = rows(sampling.minmax(df.where("key < 10"), df, ["x"]), "key", "x")
    assert scaled[9] == (9, 1.0) and scaled[-1] == (99, None) and scaled[18][1] == 2.0
    constant = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert rows(sampling.minmax(constant, constant, ["x"])) == [(0.0,), (0.0,)]
    chi = dict(rows(sampling.chi2_scores(spark.createDataFrame([(0, 1.0, 0.0), (1, 3.0, 0.0)], "y int, a double, b double"), "y", ["a", "b"])))
    assert chi == {"a": 1.0, "b": -1.0}


def test_catalogue_rules(spark):
    audit = spark.createDataFrame(
        [(" S1", "F.edf", 10.0, "a-b; C-D;a-b"), ("s1", "f.edf ", 20.0, "a-b"), ("s2", "g.edf", None, None)], "subject string, filename string, duration_sec double, channel_names string"
    ).selectExpr("*", "timestamp'2025-01-01' AS recorded_at", "1 AS n_seizures", "256.0 AS sampling_rate")
    got = catalog.recordings(audit)
    assert rows(got, "subject", "filename", "duration_sec", "channels") == [("s1", "f.edf", 20.0, ["A-B"]), ("s2", "g.edf", None, [])]
    assert rows(got.select(catalog.covers("channels", ["A-B"]).alias("c"), catalog.lacks_all("channels", ["A-B"]).alias("l"))) == [(False, True), (True, False)]
