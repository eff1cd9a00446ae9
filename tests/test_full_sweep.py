"""The curve at every threshold and under both rules, against the sweep that lays out every threshold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillwave.operators import events, scoring, sweep
from quillwave.plans import inputs, q_events, q_transfer
from tests.conftest import DATA, rows

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
COLUMNS = ["run_id", "threshold", "tp", "fp", "ref_true", "hours", "sens", "fa_per_day"]


@pytest.mark.parametrize("gap", [0, 8000])
def test_states_equal_every_threshold(spark, gap):
    d = str(DATA)
    records = inputs.records(spark, d).where("split = 'tuning' AND grid")
    args = records, inputs.intervals(spark, d), inputs.files(spark, d), "run_id", "filename", sweep.threshold_units()
    found = sweep.state_curves(*args, [gap], q_events.RULES)
    for rule in q_events.RULES:
        mine = rows(found.where(F.col("rule") == rule.name), *COLUMNS)
        assert mine == rows(sweep.sweep_curve(*args, gap, rule), *COLUMNS)
        assert len(mine) == 279 * len({r[0] for r in mine})


def test_picks_and_transfers_use_every_threshold_and_both_rules(spark):
    d = str(DATA)
    curve = [r.asDict() for r in q_events.sweep_curve_full(spark, d).collect()]
    keys = {(c["run_id"], c["rule"]) for c in curve}
    assert {r for _, r in keys} == {"anyhit", "cover70"}
    best = {}
    for k in keys:
        mine = [c for c in curve if (c["run_id"], c["rule"]) == k]
        within = [c for c in mine if c["fa_per_day"] is not None and c["fa_per_day"] <= 5]
        key = lambda c: (-(c["sens"] if c["sens"] is not None else -1), c["threshold"])
        best[k] = min(within, key=key) if within else min(mine, key=lambda c: (c["fa_per_day"], *key(c)))
    picked = {(r.run_id, r.rule): r.threshold for r in q_events.pick_threshold_fallback_full(spark, d).collect()}
    assert picked == {k: b["threshold"] for k, b in best.items()}
    assert {(r.run_id, r.rule) for r in q_events.pick_threshold_full(spark, d).collect()} == {k for k, b in best.items() if b["fa_per_day"] <= 5}
    assert {(r.run_id, r.rule, r.n_thresholds) for r in q_events.criteria_met_full(spark, d).collect()} == {(*k, 279) for k in keys}
    moved = q_events.percentile_transfer_full(spark, d).collect()
    tuning = inputs.records(spark, d).where("units IS NOT NULL AND grid AND split = 'tuning'").select("run_id", "units").collect()
    for r in moved:
        own = [t.units for t in tuning if t.run_id == r.run_id]
        assert abs(r.fraction - sum(u >= picked[r.run_id, r.rule] for u in own) / len(own)) < 1e-8
    used = {(r.run_id, r.rule): r.threshold for r in q_transfer.absolute_transfer_full(spark, d).collect()}
    assert all(t is None or t == picked[k] for k, t in used.items()) and any(t for t in used.values())


def test_sensitivity_sweeps_picks_and_transfers_every_setting(spark):
    d, gap = str(DATA), 12_000
    found = {(r.run_id, r.merge_gap, r.min_duration, r.rule, r.criterion): (r.n_subjects, r.n_met) for r in q_transfer.postprocessing_sensitivity_full(spark, d).collect()}
    runs = {k[0] for k in found}
    assert runs and len(found) == len(runs) * 7 * 3 * 2 * 2
    # one setting by the single steps, with the least duration applied
    records = inputs.records(spark, d).where("units IS NOT NULL AND grid")
    tuning = records.where("split = 'tuning'")
    rows_, refs, listed = q_events._scorable(spark, d, "test")
    curve = q_events._rounded(sweep.sweep_curve(tuning, inputs.intervals(spark, d), inputs.files(spark, d), "run_id", "filename", sweep.threshold_units(), gap, scoring.ANY_HIT), "sens", "fa_per_day")
    points = sweep.pick_threshold(curve, "run_id", 5.0, True).select("run_id", "threshold")
    moved = sweep.percentile_transfer(tuning, rows_, points, "run_id").select("run_id", "threshold").collect()
    for run, threshold in moved:
        own = rows_.where(F.col("run_id") == run)
        hyps = events.candidate_events(own, threshold, q_events.RUN_FILE, gap, 2000)
        mine = lambda df: df.where(F.col("run_id") == run)  # noqa: E731, B023
        totals = scoring.score(mine(refs), hyps, mine(listed), scoring.ANY_HIT, q_events.RUN_FILE).collect()
        count, hours = {}, {}
        for r in own.select("filename").collect():
            hours[r.filename.split("_")[0]] = hours.get(r.filename.split("_")[0], 0) + 4 / 3600
        for r in totals:
            tp, fp, n = count.get(r.filename.split("_")[0], (0, 0, 0))
            count[r.filename.split("_")[0]] = tp + r.tp, fp + r.fp, n + r.ref_true
        met = sum(n > 0 and tp / n >= 0.6 and fp * 24 / hours[s] <= 5 for s, (tp, fp, n) in count.items())
        assert {found[run, gap, m, "anyhit", "medication_titration"] for m in (0, 1000, 2000)} == {(len(hours), met)}
