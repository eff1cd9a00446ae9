"""Windowing, event, scoring and sweep queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.operators import events, scoring, sweep, windows
from quillwave.operators.metrics import macro_micro
from quillwave.plans import inputs
from quillwave.plans.inputs import FILES, INTERVALS, RECORDS, SPANS, merged, split
from quillwave.semantics import ratio
from quillwave.session import materialise
from quillwave.tables import table

RUN_FILE = ["run_id", "filename"]
#: Ten-thousandths and milliseconds used by the queries below.
AT, GAP, LEAST, LONGEST = 3000, 8000, 8000, 20_000
THRESHOLDS = sweep.threshold_units()
#: Least sensitivity and most false alarms a day by criterion.
CRITERIA = {"medication_titration": (0.6, 5.0), "realtime_alert": (0.8, 2.0)}
RULES = (scoring.ANY_HIT, scoring.COVER_70)


def grid_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.grid_starts(inputs.files(spark, d)).select("filename", "start_sample")


def dense_windows(spark: SparkSession, d: str) -> DataFrame:
    return windows.dense_starts(inputs.files(spark, d), inputs.intervals(spark, d)).select("filename", "start_sample")


def schedule_union(spark: SparkSession, d: str) -> DataFrame:
    return windows.schedule(inputs.files(spark, d), inputs.intervals(spark, d)).select("filename", "start_sample", "on_uniform_grid")


def window_label(spark: SparkSession, d: str) -> DataFrame:
    return windows.label_windows(inputs.window_spans(spark, d), inputs.intervals(spark, d)).select("filename", "start_ms", "end_ms", "label", "event_id")


def near_zone_flag(spark: SparkSession, d: str) -> DataFrame:
    return windows.near_zone(inputs.window_spans(spark, d), inputs.intervals(spark, d)).select("filename", "start_ms", "end_ms", "is_near")


def interval_window_count(spark: SparkSession, d: str) -> DataFrame:
    return windows.windows_per_interval(inputs.window_spans(spark, d), inputs.intervals(spark, d))


def zone_false_alarms(spark: SparkSession, d: str) -> DataFrame:
    """False-alarm share of negative windows near events and far from them, per run."""
    rows = inputs.records(spark, d).where("units IS NOT NULL AND label = 0")
    zoned = windows.near_zone(rows, inputs.intervals(spark, d))
    share = lambda near: ratio(F.count_if((F.col("is_near") == near) & (F.col("units") >= AT)), F.count_if(F.col("is_near") == near))
    out = zoned.groupBy("run_id").agg(share(True).alias("near"), share(False).alias("far"))
    return out.select("run_id", F.round("near", 6).alias("near_share"), F.round("far", 6).alias("far_share"), (F.abs(ratio(F.col("near") - F.col("far"), F.col("far"))) <= 0.2).alias("alike"))


def threshold_positive(spark: SparkSession, d: str) -> DataFrame:
    pos = events.positives(inputs.records(spark, d), AT, RUN_FILE)
    return pos.groupBy(*RUN_FILE).agg(F.count(F.lit(1)).alias("n_positive"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return events.merge_spans(events.positives(inputs.records(spark, d), AT, RUN_FILE), RUN_FILE, GAP)


def merge_gap_events(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


def session_window_events(spark: SparkSession, d: str) -> DataFrame:
    return events.session_spans(events.positives(inputs.records(spark, d), AT, RUN_FILE), RUN_FILE, GAP)


def drop_short(spark: SparkSession, d: str) -> DataFrame:
    return events.drop_short(_merged(spark, d), LEAST)


def split_long(spark: SparkSession, d: str) -> DataFrame:
    return events.split_long(_merged(spark, d).drop("n"), LONGEST)


def events_incl_empty(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.records(spark, d).where("units IS NOT NULL")
    return events.with_empty(rows, events.candidate_events(rows, AT, RUN_FILE, GAP, LEAST), RUN_FILE)


def contiguous_runs(spark: SparkSession, d: str) -> DataFrame:
    return events.contiguous_runs(events.positives(inputs.records(spark, d), AT, RUN_FILE), RUN_FILE, 4000)


def run_length_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of runs of positives on the grid and of all positives, per run."""
    rows = inputs.records(spark, d)
    both = []
    for kind, step, part in (("grid", 4000, rows.where("grid")), ("dense", 500, rows)):
        runs = events.contiguous_runs(events.positives(part, AT, RUN_FILE), RUN_FILE, step)
        both.append(runs.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_runs"), F.max("run_ms").alias("longest_ms"), F.round(F.avg("run_ms"), 6).alias("mean_ms")).withColumn("kind", F.lit(kind)))
    return both[0].unionByName(both[1])


def kth_largest_threshold(spark: SparkSession, d: str) -> DataFrame:
    return events.kth_largest(inputs.records(spark, d).where("split IS NOT NULL"), ["run_id", "split"], "units", 0.05)


def fraction_flagged(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.records(spark, d).where("units IS NOT NULL AND split = 'tuning'")
    return rows.groupBy("run_id").agg(F.round(F.avg((F.col("units") >= AT).cast("int")), 9).alias("fraction"), F.count(F.lit(1)).alias("n"))


def _scorable(spark: SparkSession, d: str, split_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid records, references per run and file, listed files) of a split."""
    rows = materialise(inputs.records(spark, d).where((F.col("split") == split_name) & F.col("grid") & F.col("units").isNotNull()), "records")
    listed = materialise(rows.select(*RUN_FILE).distinct().join(inputs.files(spark, d).select("filename", "duration_sec"), "filename"), "listed")
    return rows, listed.join(inputs.intervals(spark, d), "filename").select(*RUN_FILE, "start_ms", "end_ms"), listed


def _score(spark: SparkSession, d: str, rule: scoring.Rule) -> DataFrame:
    rows, refs, listed = _scorable(spark, d, "test")
    return scoring.score(refs, events.candidate_events(rows, AT, RUN_FILE, GAP), listed, rule, RUN_FILE)


def score_rule_a(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d, scoring.ANY_HIT)


def score_rule_b(spark: SparkSession, d: str) -> DataFrame:
    return _score(spark, d, scoring.COVER_70)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def fold_totals(spark: SparkSession, d: str) -> DataFrame:
    rows, refs, listed = _scorable(spark, d, "test")
    totals = scoring.score(refs, events.candidate_events(rows, AT, RUN_FILE, GAP), listed, scoring.ANY_HIT, RUN_FILE)
    hours = rows.groupBy("run_id").agg((F.count(F.lit(1)) * F.lit(4 / 3600)).alias("hours"))
    sums = totals.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])
    return _rounded(scoring.rates(sums.join(hours, "run_id")), "hours", "sens", "fa_per_day")


def always_positive_baseline(spark: SparkSession, d: str) -> DataFrame:
    """What flagging every window scores, under both rules."""
    rows, refs, listed = _scorable(spark, d, "test")
    hyps = events.candidate_events(rows, 0, RUN_FILE, GAP)
    both = [scoring.score(refs, hyps, listed, rule, RUN_FILE).withColumn("rule", F.lit(rule.name)) for rule in (scoring.ANY_HIT, scoring.COVER_70)]
    return both[0].unionByName(both[1]).groupBy("run_id", "rule").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])


def _curve(spark: SparkSession, d: str, rules: Sequence[scoring.Rule]) -> DataFrame:
    """(run_id, rule, threshold, ...) of the tuning splits, at all thresholds of the fine grid."""
    rows = materialise(inputs.records(spark, d).where("split = 'tuning' AND grid"), "records")
    curve = sweep.state_curves(rows, inputs.intervals(spark, d), inputs.files(spark, d), "run_id", "filename", THRESHOLDS, [GAP], rules)
    return _rounded(curve.drop("merge_gap"), "hours", "sens", "fa_per_day")


def sweep_curve(spark: SparkSession, d: str) -> DataFrame:
    return _curve(spark, d, RULES[:1]).drop("rule")


def sweep_curve_full(spark: SparkSession, d: str) -> DataFrame:
    """The curve under both rules."""
    return _curve(spark, d, RULES)


def _pick(spark: SparkSession, d: str, fallback: bool, rules: Sequence[scoring.Rule]) -> DataFrame:
    picked = sweep.pick_threshold(_curve(spark, d, rules), ["run_id", "rule"], 5.0, fallback)
    return picked.select("run_id", "rule", "threshold", "tp", "fp", "ref_true", "sens", "fa_per_day", "ceiling_met")


def pick_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _pick(spark, d, False, RULES[:1]).drop("rule")


def pick_threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _pick(spark, d, True, RULES[:1]).drop("rule")


def pick_threshold_full(spark: SparkSession, d: str) -> DataFrame:
    return _pick(spark, d, False, RULES)


def pick_threshold_fallback_full(spark: SparkSession, d: str) -> DataFrame:
    return _pick(spark, d, True, RULES)


def _met(curve: DataFrame) -> DataFrame:
    """How many thresholds of each run and rule meet each criterion."""
    curve = materialise(curve, "curve")
    parts = []
    for name, (least, most) in CRITERIA.items():
        points = sweep.criteria_met(curve, least, most).groupBy("run_id", "rule")
        parts.append(points.agg(F.count_if("met").alias("n_met"), F.count(F.lit(1)).alias("n_thresholds")).withColumn("criterion", F.lit(name)))
    return parts[0].unionByName(parts[1])


def criteria_met(spark: SparkSession, d: str) -> DataFrame:
    return _met(_curve(spark, d, RULES[:1])).drop("rule")


def criteria_met_full(spark: SparkSession, d: str) -> DataFrame:
    return _met(_curve(spark, d, RULES))


def _percentile(spark: SparkSession, d: str, rules: Sequence[scoring.Rule]) -> DataFrame:
    """Per run and rule: the test threshold that flags the share that the picked one flags on tuning."""
    rows = inputs.records(spark, d).where("units IS NOT NULL AND grid")
    points = materialise(_pick(spark, d, True, rules).select("run_id", "rule", "threshold"), "picked")
    both = [sweep.percentile_transfer(rows.where("split = 'tuning'"), rows.where("split = 'test'"), points.where(F.col("rule") == r.name), "run_id").withColumn("rule", F.lit(r.name)) for r in rules]
    return reduce(DataFrame.unionByName, both).select("run_id", "rule", F.round("fraction", 9).alias("fraction"), "n", "k", "threshold")


def percentile_transfer(spark: SparkSession, d: str) -> DataFrame:
    return _percentile(spark, d, RULES[:1]).drop("rule")


def percentile_transfer_full(spark: SparkSession, d: str) -> DataFrame:
    return _percentile(spark, d, RULES)


def pooled_curve(spark: SparkSession, d: str) -> DataFrame:
    """Per configuration and rule: the curve of the test splits of all its forest runs by five folds, pooled, on the display grid."""
    runs = table(spark, d, "runs").where("model = 'rf' AND scheme = '5fold'").select("run_id", "config")
    rows = inputs.records(spark, d).where("split = 'test' AND grid AND units IS NOT NULL").join(runs, "run_id")
    # a subject is in one fold's test split; where it is in several, every run's records count as a recording of their own
    rows = materialise(rows.withColumn("recording", F.to_json(F.struct("run_id", "filename"))), "records")
    listed = rows.select("config", "recording", "filename").distinct().join(inputs.files(spark, d).select("filename", "duration_sec"), "filename")
    refs = rows.select("recording", "filename").distinct().join(inputs.intervals(spark, d), "filename").select("recording", "start_ms", "end_ms")
    curve = sweep.state_curves(rows, refs, listed.select("recording", "duration_sec"), "config", "recording", sweep.display_units(), [GAP], RULES)
    subjects = rows.groupBy("config").agg(F.count_distinct("subject").alias("n_subjects"))
    return _rounded(curve.drop("merge_gap"), "hours", "sens", "fa_per_day").join(subjects, "config")


def subject_rates(spark: SparkSession, d: str) -> DataFrame:
    """Events and rates of each subject of a run's test split."""
    rows, refs, listed = _scorable(spark, d, "test")
    subject = F.regexp_extract("filename", r"^([a-z]+\d+)_", 1)
    totals = scoring.score(refs, events.candidate_events(rows, AT, RUN_FILE, GAP), listed, scoring.ANY_HIT, RUN_FILE).withColumn("subject", subject)
    hours = rows.withColumn("subject", subject).groupBy("run_id", "subject").agg((F.count(F.lit(1)) * F.lit(4 / 3600)).alias("hours"))
    sums = totals.groupBy("run_id", "subject").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])
    return sums.join(hours, ["run_id", "subject"])


def per_subject(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(scoring.rates(subject_rates(spark, d)), "hours", "sens", "fa_per_day")


def macro_micro_rates(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(macro_micro(subject_rates(spark, d), ["run_id"], "subject", *CRITERIA["medication_titration"]), "macro_sens", "micro_sens", "fa_per_day", "pct_met")


QUERIES = {
    q.__name__: q for q in (
        grid_windows, dense_windows, schedule_union, window_label, near_zone_flag, interval_window_count, zone_false_alarms, threshold_positive, merge_gap_events, session_window_events,
        drop_short, split_long, events_incl_empty, contiguous_runs, run_length_comparison, kth_largest_threshold, fraction_flagged, score_rule_a, score_rule_b, fold_totals,
        always_positive_baseline, sweep_curve, pick_threshold, pick_threshold_fallback, criteria_met, percentile_transfer, per_subject, macro_micro_rates,
        sweep_curve_full, pick_threshold_full, pick_threshold_fallback_full, criteria_met_full, percentile_transfer_full, pooled_curve,
    )
}

_POS = f"""positives AS (SELECT run_id, filename, start_ms, start_ms + 4000 AS end_ms FROM records WHERE units >= {AT})"""
_MERGED = f"WITH {RECORDS},{_POS},{merged('positives', 'merged', 'run_id, filename', GAP)}"
_GRID = "grid AS (SELECT filename, unnest(generate_series(0, n_samples - 1024, 1024)) AS start_sample FROM files WHERE n_samples >= 1024)"
_DENSE = """near AS (
  SELECT f.filename, greatest(0, CAST(floor(i.start_ms * 256 / 1000.0) AS BIGINT) - 15360) AS low,
    least(f.n_samples - 1024, CAST(floor(i.end_ms * 256 / 1000.0) AS BIGINT) + 15360) AS high FROM files f JOIN intervals i USING (filename) WHERE f.n_samples >= 1024),
dense AS (SELECT DISTINCT filename, unnest(generate_series((low + 127) // 128 * 128, high, 128)) AS start_sample FROM near WHERE (low + 127) // 128 * 128 <= high)"""


def _scorable_sql(at: int = AT) -> str:
    """records to hyps, refs and listed of the test split."""
    return f"""WITH {RECORDS},{FILES},{INTERVALS},
rows_ AS (SELECT * FROM records WHERE split = 'test' AND grid AND units IS NOT NULL),
listed AS (SELECT DISTINCT r.run_id, r.filename, f.duration_sec FROM rows_ r JOIN files f USING (filename)),
refs AS (SELECT l.run_id, l.filename, i.start_ms, i.end_ms FROM listed l JOIN intervals i USING (filename)),
pos AS (SELECT run_id, filename, start_ms, start_ms + 4000 AS end_ms FROM rows_ WHERE units >= {at}),{merged("pos", "isl", "run_id, filename", GAP)},{split("isl", "hyps", "run_id, filename", 300000)},"""


def _score_sql(rule: scoring.Rule, at: int = AT) -> str:
    return _scorable_sql(at) + inputs.scored(rule, RUN_FILE, "refs", "hyps", "listed")


_HOURS = "hours AS (SELECT run_id, count(*) * (4 / 3600.0) AS hours FROM rows_ GROUP BY run_id)"
_SUBJECTS = f"""{_score_sql(scoring.ANY_HIT)},
subject_hours AS (SELECT run_id, regexp_extract(filename, '^([a-z]+[0-9]+)_', 1) AS subject, count(*) * (4 / 3600.0) AS hours FROM rows_ GROUP BY ALL),
subjects AS (SELECT s.run_id, s.subject, s.tp, s.fp, s.ref_true, h.hours, s.tp / nullif(s.ref_true, 0) AS sens, s.fp * 24 / nullif(h.hours, 0) AS fa_per_day
  FROM (SELECT run_id, regexp_extract(filename, '^([a-z]+[0-9]+)_', 1) AS subject, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true
        FROM scored GROUP BY ALL) s JOIN subject_hours h USING (run_id, subject))"""



def _curves_sql(rules: Sequence[scoring.Rule], thresholds: Sequence[int] = THRESHOLDS, split_name: str = "tuning", run: str = "run_id", file: str = "filename", base: str = "") -> str:
    """Relation ``curve`` (run, rule, threshold, ...); ``base`` defines rows_ and listed_ otherwise."""
    base = base or f"""rows_ AS (SELECT * FROM records WHERE split = '{split_name}' AND grid AND units IS NOT NULL),
listed_ AS (SELECT DISTINCT r.run_id, r.filename, r.filename AS source, f.duration_sec FROM rows_ r JOIN files f USING (filename)),"""
    one = lambda r: f"""SELECT s.{run}, '{r.name}' AS rule, s.threshold, tp, fp, ref_true, round(hours, 6) AS hours, round(tp / nullif(ref_true, 0), 6) AS sens, round(fp * 24 / nullif(hours, 0), 6) AS fa_per_day
  FROM (SELECT {run}, threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM scored_{r.name} GROUP BY ALL) s JOIN hours USING ({run})"""  # noqa: E731
    keys = [run, "threshold", file]
    scores = ",".join(inputs.scored(r, keys, "refs", "hyps", "listed", f"scored_{r.name}", f"{r.name}_") for r in rules)
    return f"""WITH {RECORDS},{FILES},{INTERVALS},
{base}
grid_ AS (SELECT unnest([{", ".join(map(str, thresholds))}]) AS threshold),
listed AS (SELECT l.{run}, g.threshold, l.{file}, l.source, l.duration_sec FROM listed_ l CROSS JOIN grid_ g),
refs AS (SELECT l.{run}, l.threshold, l.{file}, i.start_ms, i.end_ms FROM listed l JOIN intervals i ON l.source = i.filename),
pos AS (SELECT {run}, threshold, {file}, start_ms, start_ms + 4000 AS end_ms FROM rows_ JOIN grid_ ON units >= threshold),
{merged("pos", "isl", f"{run}, threshold, {file}", GAP)},{split("isl", "hyps", f"{run}, threshold, {file}", 300000)},
{scores},
hours AS (SELECT {run}, count(*) * (4 / 3600.0) AS hours FROM rows_ GROUP BY {run}),
curve AS ({" UNION ALL ".join(map(one, rules))})"""


def _pick_sql(fallback: bool, rules: Sequence[scoring.Rule]) -> str:
    where = "" if fallback else "WHERE coalesce(fa_per_day <= 5.0, false)"
    return f"""{_curves_sql(rules)}, picked AS (SELECT *, coalesce(fa_per_day <= 5.0, false) AS ceiling_met FROM curve {where}
  QUALIFY row_number() OVER (PARTITION BY run_id, rule ORDER BY coalesce(fa_per_day <= 5.0, false) DESC,
    CASE WHEN coalesce(fa_per_day <= 5.0, false) THEN 0.0 ELSE fa_per_day END ASC NULLS LAST, sens DESC NULLS LAST, threshold) = 1)"""


def _met_sql(rules: Sequence[scoring.Rule], keys: str) -> str:
    return f"""{_curves_sql(rules)} SELECT {keys}, criterion, count(*) FILTER (coalesce(sens >= least AND fa_per_day <= most, false)) AS n_met, count(*) AS n_thresholds
FROM curve CROSS JOIN (VALUES {", ".join(f"('{c}', {a}, {b})" for c, (a, b) in CRITERIA.items())}) c(criterion, least, most) GROUP BY {keys}, criterion"""


def _moved_sql(rules: Sequence[scoring.Rule]) -> str:
    """Relation ``moved`` (run_id, rule, fraction, n, k, threshold): the picked thresholds moved to the test split by percentile."""
    return f"""{_pick_sql(True, rules)},
share AS (SELECT r.run_id, p.rule, avg(CAST(r.units >= p.threshold AS INTEGER)) AS fraction FROM rows_ r JOIN picked p USING (run_id) GROUP BY r.run_id, p.rule),
test AS (SELECT r.run_id, s.rule, r.units, s.fraction, count(*) OVER (PARTITION BY r.run_id, s.rule) AS n, row_number() OVER (PARTITION BY r.run_id, s.rule ORDER BY r.units DESC) AS i
  FROM records r JOIN share s USING (run_id) WHERE r.split = 'test' AND r.grid AND r.units IS NOT NULL),
k AS (SELECT *, greatest(1, least(n, CAST(round_even(fraction * n, 0) AS BIGINT))) AS k, max(units) OVER (PARTITION BY run_id, rule) AS top FROM test),
moved AS (SELECT run_id, rule, round(fraction, 9) AS fraction, n, k, CASE WHEN fraction <= 0 THEN top + 1 ELSE units END AS threshold FROM k WHERE i = k)"""


_POOLED = """pooled AS (SELECT run_id, config FROM runs WHERE model = 'rf' AND scheme = '5fold'),
rows_ AS (SELECT p.config, r.run_id || '/' || r.filename AS recording, r.filename AS source, r.subject, r.start_ms, r.units FROM records r JOIN pooled p USING (run_id) WHERE r.split = 'test' AND r.grid AND r.units IS NOT NULL),
listed_ AS (SELECT DISTINCT r.config, r.recording, r.source, f.duration_sec FROM rows_ r JOIN files f ON r.source = f.filename),"""
_PICKED = "run_id, threshold, tp, fp, ref_true, sens, fa_per_day, ceiling_met"

SQL = {
    "grid_windows": f"WITH {FILES}, {_GRID} SELECT filename, start_sample FROM grid",
    "dense_windows": f"WITH {FILES},{INTERVALS},{_DENSE} SELECT filename, start_sample FROM dense",
    "schedule_union": f"WITH {FILES},{INTERVALS},{_GRID},{_DENSE} SELECT filename, start_sample, start_sample % 1024 = 0 AS on_uniform_grid FROM (SELECT * FROM grid UNION SELECT * FROM dense)",
    "window_label": f"""WITH {INTERVALS},{SPANS},
hit AS (SELECT s.filename, s.start_ms, s.end_ms, min(i.idx) AS idx FROM spans s JOIN intervals i ON s.filename = i.filename
  AND least(s.end_ms, i.end_ms) - greatest(s.start_ms, i.start_ms) >= 0.5 * (s.end_ms - s.start_ms) GROUP BY ALL)
SELECT s.filename, s.start_ms, s.end_ms, CAST(h.idx IS NOT NULL AS INTEGER) AS label, s.filename || '_sz' || h.idx AS event_id FROM spans s LEFT JOIN hit h USING (filename, start_ms, end_ms)""",
    "near_zone_flag": f"""WITH {INTERVALS},{SPANS} SELECT filename, start_ms, end_ms, EXISTS (SELECT 1 FROM intervals i WHERE i.filename = s.filename
  AND s.start_ms BETWEEN i.start_ms - 60000 AND i.end_ms + 60000) AS is_near FROM spans s""",
    "interval_window_count": f"""WITH {INTERVALS},{SPANS} SELECT i.filename, i.idx, count(s.start_ms) AS n_windows FROM intervals i LEFT JOIN spans s ON i.filename = s.filename
  AND least(s.end_ms, i.end_ms) - greatest(s.start_ms, i.start_ms) >= 2000 GROUP BY i.filename, i.idx""",
    "zone_false_alarms": f"""WITH {RECORDS},{INTERVALS},
z AS (SELECT run_id, units, EXISTS (SELECT 1 FROM intervals i WHERE i.filename = r.filename AND r.start_ms BETWEEN i.start_ms - 60000 AND i.end_ms + 60000) AS near
  FROM records r WHERE units IS NOT NULL AND label = 0),
s AS (SELECT run_id, count(*) FILTER (near AND units >= {AT}) / nullif(count(*) FILTER (near), 0) AS n, count(*) FILTER (NOT near AND units >= {AT}) / nullif(count(*) FILTER (NOT near), 0) AS f FROM z GROUP BY run_id)
SELECT run_id, round(n, 6) AS near_share, round(f, 6) AS far_share, abs((n - f) / nullif(f, 0)) <= 0.2 AS alike FROM s""",
    "threshold_positive": f"WITH {RECORDS},{_POS} SELECT run_id, filename, count(*) AS n_positive, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM positives GROUP BY run_id, filename",
    "merge_gap_events": f"{_MERGED} SELECT run_id, filename, start_ms, end_ms, n FROM merged",
    "session_window_events": f"{_MERGED} SELECT run_id, filename, start_ms, end_ms, n FROM merged",
    "drop_short": f"{_MERGED} SELECT run_id, filename, start_ms, end_ms, n FROM merged WHERE end_ms - start_ms >= {LEAST}",
    "split_long": f"{_MERGED},{split('merged', 'cut', 'run_id, filename', LONGEST)} SELECT run_id, filename, start_ms, end_ms FROM cut",
    "events_incl_empty": f"""{_MERGED}, kept AS (SELECT * FROM merged WHERE end_ms - start_ms >= {LEAST}),{split('kept', 'cut', 'run_id, filename', 300000)}
SELECT f.run_id, f.filename, count(c.start_ms) AS n_events, CAST(coalesce(sum(c.end_ms - c.start_ms), 0) AS BIGINT) AS event_ms
FROM (SELECT DISTINCT run_id, filename FROM records WHERE units IS NOT NULL) f LEFT JOIN cut c USING (run_id, filename) GROUP BY ALL""",
    "contiguous_runs": f"""WITH {RECORDS},{_POS}, g AS (SELECT *, start_ms - row_number() OVER (PARTITION BY run_id, filename ORDER BY start_ms) * 4000 AS g FROM positives)
SELECT run_id, filename, min(start_ms) AS start_ms, count(*) AS n, count(*) * 4000 AS run_ms FROM g GROUP BY run_id, filename, g""",
    "run_length_comparison": f"""WITH {RECORDS}, p AS (
  SELECT 'grid' AS kind, 4000 AS step, run_id, filename, start_ms FROM records WHERE units >= {AT} AND grid UNION ALL SELECT 'dense', 500, run_id, filename, start_ms FROM records WHERE units >= {AT}),
g AS (SELECT *, start_ms - row_number() OVER (PARTITION BY kind, run_id, filename ORDER BY start_ms) * step AS g FROM p),
r AS (SELECT kind, run_id, filename, g, count(*) * step AS run_ms FROM g GROUP BY kind, run_id, filename, g, step)
SELECT run_id, count(*) AS n_runs, max(run_ms) AS longest_ms, round(avg(run_ms), 6) AS mean_ms, kind FROM r GROUP BY run_id, kind""",
    "kth_largest_threshold": f"""WITH {RECORDS}, r AS (SELECT run_id, split, units, count(*) OVER (PARTITION BY run_id, split) AS n,
  row_number() OVER (PARTITION BY run_id, split ORDER BY units DESC) AS i FROM records WHERE units IS NOT NULL AND split IS NOT NULL),
k AS (SELECT *, greatest(1, least(n, CAST(round_even(0.05 * n, 0) AS BIGINT))) AS k FROM r) SELECT run_id, split, n, k, units AS threshold FROM k WHERE i = k""",
    "fraction_flagged": f"WITH {RECORDS} SELECT run_id, round(avg(CAST(units >= {AT} AS INTEGER)), 9) AS fraction, count(*) AS n FROM records WHERE units IS NOT NULL AND split = 'tuning' GROUP BY run_id",
    "score_rule_a": _score_sql(scoring.ANY_HIT) + " SELECT * FROM scored",
    "score_rule_b": _score_sql(scoring.COVER_70) + " SELECT * FROM scored",
    "fold_totals": f"""{_score_sql(scoring.ANY_HIT)},{_HOURS}
SELECT s.run_id, tp, fp, ref_true, round(hours, 6) AS hours, round(tp / nullif(ref_true, 0), 6) AS sens, round(fp * 24 / nullif(hours, 0), 6) AS fa_per_day
FROM (SELECT run_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM scored GROUP BY run_id) s JOIN hours USING (run_id)""",
    "always_positive_baseline": " UNION ALL ".join(
        f"SELECT * FROM ({_score_sql(rule, 0)} SELECT run_id, '{rule.name}' AS rule, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM scored GROUP BY run_id)"
        for rule in (scoring.ANY_HIT, scoring.COVER_70)
    ),
    "sweep_curve": f"{_curves_sql(RULES[:1])} SELECT * EXCLUDE (rule) FROM curve",
    "sweep_curve_full": f"{_curves_sql(RULES)} SELECT * FROM curve",
    "pick_threshold": f"{_pick_sql(False, RULES[:1])} SELECT {_PICKED} FROM picked",
    "pick_threshold_full": f"{_pick_sql(False, RULES)} SELECT rule, {_PICKED} FROM picked",
    "pick_threshold_fallback": f"{_pick_sql(True, RULES[:1])} SELECT {_PICKED} FROM picked",
    "pick_threshold_fallback_full": f"{_pick_sql(True, RULES)} SELECT rule, {_PICKED} FROM picked",
    "criteria_met": _met_sql(RULES[:1], "run_id"),
    "criteria_met_full": _met_sql(RULES, "run_id, rule"),
    "percentile_transfer": f"{_moved_sql(RULES[:1])} SELECT * EXCLUDE (rule) FROM moved",
    "percentile_transfer_full": f"{_moved_sql(RULES)} SELECT * FROM moved",
    "pooled_curve": f"""{_curves_sql(RULES, sweep.display_units(), run="config", file="recording", base=_POOLED)}
SELECT c.*, n_subjects FROM curve c JOIN (SELECT config, count(DISTINCT subject) AS n_subjects FROM rows_ GROUP BY config) s USING (config)""",
    "per_subject": f"{_SUBJECTS} SELECT run_id, subject, tp, fp, ref_true, round(hours, 6) AS hours, round(sens, 6) AS sens, round(fa_per_day, 6) AS fa_per_day FROM subjects",
    "macro_micro_rates": f"""{_SUBJECTS} SELECT run_id, count(DISTINCT subject) AS n_subjects, round(avg(sens), 6) AS macro_sens, round(sum(tp) / nullif(sum(ref_true), 0), 6) AS micro_sens,
  round(sum(fp) * 24 / nullif(sum(hours), 0), 6) AS fa_per_day, count(*) FILTER (coalesce(sens >= 0.6 AND fa_per_day <= 5.0, false)) AS n_met,
  round(100 * (count(*) FILTER (coalesce(sens >= 0.6 AND fa_per_day <= 5.0, false)) / count(DISTINCT subject)), 6) AS pct_met FROM subjects GROUP BY run_id""",
}
