"""Operating points carried to the test splits, per run and per subject, and the extracts that reports are made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.operators import catalog, events, learn, sampling, scoring, sweep
from quillwave.plans import inputs, q_catalog, q_events, q_metrics
from quillwave.plans.inputs import INTERVALS, merged, split
from quillwave.plans.q_catalog import FEATURES
from quillwave.plans.q_events import CRITERIA, GAP, RULES, RUN_FILE
from quillwave.semantics import finite, normal, ratio
from quillwave.session import materialise
from quillwave.tables import table

#: Subjects that analyses mark, the order in which configurations are shown, and the least rate a log axis has room for.
HARD_CASES = ["pt000003", "pt000007", "pt000042"]
SHOWN = ["wide18", "lateral8", "left4", "pair2"]
LEAST_RATE = 0.01
#: The feature that is optional, and from how many rows on it is ranked.
OPTIONAL, LEAST_ROWS = "fp1_f7__variance", 10
_POINT = ["run_id", "rule", "criterion"]


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(points, test records): per run, rule and criterion the threshold picked on tuning and moved to the test split by the share it flags."""
    curve = materialise(q_events._curve(spark, d, RULES), "curve")
    parts = []
    for name, (least, most) in CRITERIA.items():
        best = sweep.pick_threshold(curve, ["run_id", "rule"], most, True)
        parts.append(best.select("run_id", "rule", F.lit(name).alias("criterion"), F.lit(least).alias("_least"), F.lit(most).alias("_most"), F.col("threshold").alias("picked"), F.col("sens").alias("tuning_sens"), F.col("fa_per_day").alias("tuning_fa"), "ceiling_met"))
    picked = materialise(reduce(DataFrame.unionByName, parts), "picked")
    grid = inputs.records(spark, d).where("units IS NOT NULL AND grid")
    tuning, test = grid.where("split = 'tuning'"), materialise(grid.where("split = 'test'"), "records")
    share = tuning.join(picked.select("run_id", "picked").distinct(), "run_id").groupBy("run_id", "picked").agg(F.avg((F.col("units") >= F.col("picked")).cast("int")).alias("fraction"))
    moved = events.kth_largest(test.join(share, "run_id"), ["run_id", "picked"], "units", "fraction").select("run_id", "picked", "fraction", "threshold")
    return materialise(picked.join(moved, ["run_id", "picked"]), "points"), test


def _scored(spark: SparkSession, d: str, points: DataFrame, test: DataFrame) -> DataFrame:
    """(run_id, rule, threshold, filename, tp, fp, ref_true) of the test files at the points' thresholds."""
    listed = materialise(test.select(*RUN_FILE).distinct().join(inputs.files(spark, d).select("filename", "duration_sec"), "filename"), "listed")
    refs = listed.join(inputs.intervals(spark, d), "filename").select(*RUN_FILE, "start_ms", "end_ms")
    keys, parts = [*RUN_FILE, "threshold"], []
    for rule in RULES:
        at = points.where(F.col("rule") == rule.name).select("run_id", "threshold").distinct()
        spans = events.positives(test.join(at, "run_id"), "threshold", keys)
        hyps = events.split_long(events.merge_spans(spans, keys, GAP).drop("n"))
        parts.append(scoring.score(refs.join(at, "run_id"), hyps, listed.join(at, "run_id"), rule, keys).withColumn("rule", F.lit(rule.name)))
    return materialise(reduce(DataFrame.unionByName, parts), "scored")


def _sums() -> list:
    return [F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")]



def operating_points(spark: SparkSession, d: str) -> DataFrame:
    """Each run's points for both rules and criteria: what was picked on tuning, and what it reaches on the test split."""
    points, test = _points(spark, d)
    totals = _scored(spark, d, points, test).groupBy("run_id", "rule", "threshold").agg(*_sums())
    hours = test.groupBy("run_id").agg((F.count(F.lit(1)) * F.lit(4 / 3600)).alias("hours"))
    rated = scoring.rates(points.join(hours, "run_id").join(totals, ["run_id", "rule", "threshold"]))
    met = sweep.criteria_met(rated, F.col("_least"), F.col("_most"))
    return q_events._rounded(met.select(*_POINT, "picked", "ceiling_met", "tuning_sens", "tuning_fa", "fraction", "threshold", "tp", "fp", "ref_true", "sens", "fa_per_day", "met"), "fraction", "sens", "fa_per_day")


def _per_subject(spark: SparkSession, d: str) -> DataFrame:
    points, test = _points(spark, d)
    named = F.regexp_extract("filename", r"^([a-z]+\d+)_", 1)
    totals = _scored(spark, d, points, test).groupBy("run_id", "rule", "threshold", named.alias("subject")).agg(*_sums())
    # window counts of every score, so that all thresholds of a run are read off one aggregate
    by_score = test.groupBy("run_id", named.alias("subject"), "units").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    above = F.col("units") >= F.col("threshold")
    windows = by_score.join(points.select("run_id", "threshold").distinct(), "run_id").groupBy("run_id", "subject", "threshold").agg(
        (F.sum("n") * F.lit(4 / 3600)).alias("hours"), F.sum(F.when(above, F.col("p")).otherwise(0)).alias("window_tp"), F.sum(F.when(above, F.col("q")).otherwise(0)).alias("window_fp"),
        F.sum(F.when(above, 0).otherwise(F.col("q"))).alias("window_tn"), F.sum(F.when(above, 0).otherwise(F.col("p"))).alias("window_fn"),
    )
    rated = scoring.rates(points.join(windows, ["run_id", "threshold"]).join(totals, ["run_id", "rule", "threshold", "subject"]))
    met = sweep.criteria_met(rated, F.col("_least"), F.col("_most"))
    return met.select(*_POINT, "subject", "threshold", "hours", "tp", "fp", "ref_true", "sens", "fa_per_day", "met", "window_tp", "window_fp", "window_tn", "window_fn")


def operating_points_per_subject(spark: SparkSession, d: str) -> DataFrame:
    """Every subject scored with its fold's thresholds: events, windows, and whether it meets the criterion."""
    return q_events._rounded(_per_subject(spark, d), "hours", "sens", "fa_per_day")


def subject_extract(spark: SparkSession, d: str) -> DataFrame:
    """Rates per configuration, subject and criterion of the forests by five folds, with the marked subjects and rates a log axis can show."""
    runs = table(spark, d, "runs").where("model = 'rf' AND scheme = '5fold'").select("run_id", "config")
    rows = _per_subject(spark, d).where(F.col("rule") == RULES[0].name).join(runs, "run_id")
    shown = F.log10(F.greatest("fa_per_day", F.lit(LEAST_RATE)))
    out = rows.select("run_id", "config", "subject", "criterion", "sens", "fa_per_day", "met", "hours", F.col("subject").isin(HARD_CASES).alias("is_hard_case"), shown.alias("fa_log10"))
    return q_events._rounded(out, "sens", "fa_per_day", "hours", "fa_log10")


def groups_by_mean(spark: SparkSession, d: str) -> DataFrame:
    """Configurations by their mean share of subjects that meet a criterion, the best first, beside the order in which they are listed."""
    rows = q_metrics._grid(spark, d).groupBy("criterion", "config").agg(F.avg("pct_met").alias("mean_pct"))
    best = Window.partitionBy("criterion").orderBy(F.round("mean_pct", 9).desc_nulls_last(), "config")
    listed = F.nullif(F.array_position(F.array(*[F.lit(c) for c in SHOWN]), F.col("config")), F.lit(0))
    return rows.select("criterion", "config", F.round("mean_pct", 6).alias("mean_pct"), F.row_number().over(best).alias("place"), listed.cast("int").alias("listed"))


def delta_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Least, most and mean difference between the rules' pass rates, by criterion."""
    rows = q_metrics.rule_delta(spark, d)
    return rows.groupBy("criterion").agg(F.min("pct_met_delta").alias("least"), F.max("pct_met_delta").alias("most"), F.round(F.avg("pct_met_delta"), 5).alias("mean"), F.count("pct_met_delta").alias("n"))


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the schedule has for each recording, those with most of them first."""
    counts = q_events.schedule_union(spark, d).groupBy("filename").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if("on_uniform_grid").alias("n_grid"))
    every = inputs.files(spark, d).select("filename").join(counts, "filename", "left")
    return every.select("filename", F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("n_grid", F.lit(0)).alias("n_grid"))


def fixed_picks(spark: SparkSession, d: str) -> DataFrame:
    """A check sample that never varies: first, middle and last subject with events, their first such recording, and windows at fixed parts of it."""
    a = q_catalog._audit(spark, d).where("n_seizures > 0 AND duration_sec >= 4")
    first = a.groupBy("subject").agg(F.min("filename").alias("filename"))
    place, size = F.row_number().over(Window.orderBy("subject")) - 1, F.count(F.lit(1)).over(Window.partitionBy())  # a row per subject
    chosen = first.withColumn("_i", place).withColumn("_n", size).where("_i = 0 OR _i = _n - 1 OR _i = floor(_n / 2)").drop("_i", "_n")
    rows = chosen.join(a.groupBy("filename").agg(F.max("duration_sec").alias("duration_sec")), "filename")
    last = F.floor(F.col("duration_sec") * 256).cast("long") - 1024
    return rows.select("subject", "filename", F.explode(F.array(*[F.floor(last * f).cast("long") for f in (0.1, 0.6)])).alias("start_sample"))


def recordings_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Recordings and hours by month."""
    a = table(spark, d, "recordings").where("recorded_at IS NOT NULL").groupBy(F.date_format(F.col("recorded_at").cast("timestamp"), "yyyy-MM").alias("month"))
    return a.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(normal("subject")).alias("n_subjects"), F.round(F.sum(finite("duration_sec")) / 3600, 6).alias("hours"))


def missing_split(spark: SparkSession, d: str) -> DataFrame:
    """Missing cells of each feature: structural where the recording lacks the channel, computational otherwise."""
    long = q_catalog._features(spark, d).unpivot(["filename", "start_ms"], FEATURES, "feature", "value").where("value IS NULL")
    flags = [c for c in table(spark, d, "recordings").columns if c.startswith("has_")]
    has = q_catalog._audit(spark, d).groupBy("filename").agg(*[F.bool_or(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in flags]).unpivot(["filename"], flags, "flag", "present")
    named = long.withColumn("flag", F.concat(F.lit("has_"), F.split("feature", "__")[0])).join(has, ["filename", "flag"], "left")
    return named.groupBy("feature").agg(F.count_if(~F.coalesce("present", F.lit(False))).alias("n_structural"), F.count_if(F.coalesce("present", F.lit(False))).alias("n_computational"))


def optional_rank(spark: SparkSession, d: str) -> DataFrame:
    """The chi-square rank of the optional feature among those of its channel, over rows with all of them; with too few rows it has none."""
    block = [c for c in FEATURES if c.split("__")[0] == OPTIONAL.split("__")[0]]
    rows = q_catalog._features(spark, d).where(F.col("label").isNotNull() & reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in block])).select("label", *block)
    scored = sampling.top_k(sampling.chi2_scores(sampling.minmax(rows, rows, block), "label", block).withColumn("channel", F.lit(block[0].split("__")[0])), ["channel"], "chi2", "feature", len(block))
    n = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    out = n.crossJoin(F.broadcast(scored.where(F.col("feature") == OPTIONAL).agg(F.max("rank").alias("rank"))))  # one row each
    return out.select(F.lit(OPTIONAL).alias("feature"), "n_rows", F.when(F.col("n_rows") >= LEAST_ROWS, F.col("rank")).alias("rank"))


def paired_pools(spark: SparkSession, d: str) -> DataFrame:
    """What the optional feature adds: areas under the curve with and without it, fold by fold of subjects, and pooled."""
    rows = q_catalog._features(spark, d).where("subject IS NOT NULL")
    return learn.paired_auc(rows, [c for c in FEATURES if c != OPTIONAL], OPTIONAL, "label", "subject")


QUERIES = {
    q.__name__: q for q in (
        operating_points, operating_points_per_subject, subject_extract, groups_by_mean, delta_ranges, window_counts, fixed_picks, recordings_by_month, missing_split, optional_rank, paired_pools,
    )
}


def _points_sql() -> str:
    """Relations points, trows and scored (run_id, rule, threshold, filename, tp, fp, ref_true)."""
    steps, unions = [], []
    for r in RULES:
        t = f"o_{r.name}_"
        keys = "run_id, threshold, filename"
        steps.append(f"""{t}at AS (SELECT DISTINCT run_id, threshold FROM points WHERE rule = '{r.name}'),
{t}listed AS (SELECT l.run_id, a.threshold, l.filename, l.duration_sec FROM tlisted l JOIN {t}at a USING (run_id)),
{t}refs AS (SELECT l.run_id, l.threshold, l.filename, i.start_ms, i.end_ms FROM {t}listed l JOIN intervals i USING (filename)),
{t}pos AS (SELECT r.run_id, a.threshold, r.filename, r.start_ms, r.start_ms + 4000 AS end_ms FROM trows r JOIN {t}at a ON r.run_id = a.run_id AND r.units >= a.threshold),
{merged(f"{t}pos", f"{t}isl", keys, GAP)},{split(f"{t}isl", f"{t}hyps", keys, 300000)},{inputs.scored(r, ["run_id", "threshold", "filename"], f"{t}refs", f"{t}hyps", f"{t}listed", f"{t}scored", t)}""")
        unions.append(f"SELECT *, '{r.name}' AS rule FROM {t}scored")
    return f"""{q_events._curves_sql(RULES)},
crit(criterion, least, most) AS (VALUES {", ".join(f"('{c}', {a}, {b})" for c, (a, b) in CRITERIA.items())}),
picked AS (SELECT u.run_id, u.rule, c.*, u.threshold AS picked, u.sens AS tuning_sens, u.fa_per_day AS tuning_fa, coalesce(u.fa_per_day <= c.most, false) AS ceiling_met FROM curve u CROSS JOIN crit c
  QUALIFY row_number() OVER (PARTITION BY u.run_id, u.rule, c.criterion ORDER BY coalesce(u.fa_per_day <= c.most, false) DESC,
    CASE WHEN coalesce(u.fa_per_day <= c.most, false) THEN 0.0 ELSE u.fa_per_day END ASC NULLS LAST, u.sens DESC NULLS LAST, u.threshold) = 1),
share AS (SELECT p.run_id, p.picked, avg(CAST(r.units >= p.picked AS INTEGER)) AS fraction FROM (SELECT DISTINCT run_id, picked FROM picked) p JOIN rows_ r USING (run_id) GROUP BY ALL),
trows AS (SELECT * FROM records WHERE split = 'test' AND grid AND units IS NOT NULL),
tlisted AS (SELECT DISTINCT r.run_id, r.filename, f.duration_sec FROM trows r JOIN files f USING (filename)),
ranked AS (SELECT s.run_id, s.picked, s.fraction, r.units, count(*) OVER w AS n, max(r.units) OVER w AS top, row_number() OVER (PARTITION BY s.run_id, s.picked ORDER BY r.units DESC) AS i
  FROM share s JOIN trows r USING (run_id) WINDOW w AS (PARTITION BY s.run_id, s.picked)),
moved AS (SELECT run_id, picked, fraction, CASE WHEN fraction <= 0 THEN top + 1 ELSE units END AS threshold FROM ranked WHERE i = greatest(1, least(n, CAST(round_even(fraction * n, 0) AS BIGINT)))),
points AS (SELECT * FROM picked JOIN moved USING (run_id, picked)),
{", ".join(steps)},
scored AS ({" UNION ALL ".join(unions)})"""


_SUBJECTS_SQL = rf"""{_points_sql()},
totals AS (SELECT run_id, rule, threshold, regexp_extract(filename, '^([a-z]+[0-9]+)_', 1) AS subject, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM scored GROUP BY ALL),
wins AS (SELECT r.run_id, regexp_extract(r.filename, '^([a-z]+[0-9]+)_', 1) AS subject, a.threshold, count(*) * (4 / 3600.0) AS hours, count(*) FILTER (label = 1 AND units >= a.threshold) AS window_tp,
  count(*) FILTER (label <> 1 AND units >= a.threshold) AS window_fp, count(*) FILTER (label <> 1 AND units < a.threshold) AS window_tn, count(*) FILTER (label = 1 AND units < a.threshold) AS window_fn
  FROM trows r JOIN (SELECT DISTINCT run_id, threshold FROM points) a USING (run_id) GROUP BY ALL),
rated AS (SELECT p.run_id, p.rule, p.criterion, w.subject, p.threshold, p.least, p.most, w.hours, t.tp, t.fp, t.ref_true, t.tp / nullif(t.ref_true, 0) AS sens, t.fp * 24 / nullif(w.hours, 0) AS fa, w.window_tp, w.window_fp, w.window_tn, w.window_fn
  FROM points p JOIN wins w USING (run_id, threshold) JOIN totals t ON t.run_id = p.run_id AND t.rule = p.rule AND t.threshold = p.threshold AND t.subject = w.subject),
subjects AS (SELECT * EXCLUDE (least, most, hours, sens, fa), hours, sens, fa, coalesce(sens >= least AND fa <= most, false) AS met FROM rated)"""
_FEATURE_BLOCK = [c for c in FEATURES if c.split("__")[0] == OPTIONAL.split("__")[0]]
_BLOCK_EACH = lambda t: ", ".join(t.replace("$", c) for c in _FEATURE_BLOCK)
_LISTED = ", ".join(f"'{c}'" for c in SHOWN)

SQL = {
    "operating_points": f"""{_points_sql()},
thours AS (SELECT run_id, count(*) * (4 / 3600.0) AS hours FROM trows GROUP BY run_id),
totals AS (SELECT run_id, rule, threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM scored GROUP BY ALL),
rated AS (SELECT p.*, t.tp, t.fp, t.ref_true, t.tp / nullif(t.ref_true, 0) AS sens, t.fp * 24 / nullif(h.hours, 0) AS fa FROM points p JOIN thours h USING (run_id) JOIN totals t USING (run_id, rule, threshold))
SELECT run_id, rule, criterion, picked, ceiling_met, tuning_sens, tuning_fa, round(fraction, 6) AS fraction, threshold, tp, fp, ref_true, round(sens, 6) AS sens, round(fa, 6) AS fa_per_day, coalesce(sens >= least AND fa <= most, false) AS met FROM rated""",
    "operating_points_per_subject": f"""{_SUBJECTS_SQL} SELECT run_id, rule, criterion, subject, threshold, round(hours, 6) AS hours, tp, fp, ref_true, round(sens, 6) AS sens, round(fa, 6) AS fa_per_day, met,
  window_tp, window_fp, window_tn, window_fn FROM subjects""",
    "subject_extract": f"""{_SUBJECTS_SQL} SELECT s.run_id, u.config, s.subject, s.criterion, round(sens, 6) AS sens, round(fa, 6) AS fa_per_day, met, round(hours, 6) AS hours, s.subject IN ({", ".join(f"'{s}'" for s in HARD_CASES)}) AS is_hard_case,
  round(log10(greatest(fa, {LEAST_RATE})), 6) AS fa_log10 FROM subjects s JOIN runs u USING (run_id) WHERE s.rule = '{RULES[0].name}' AND u.model = 'rf' AND u.scheme = '5fold'""",
    "groups_by_mean": f"""WITH {q_metrics._GRID}, m AS (SELECT criterion, config, avg(pct_met) AS m FROM sgrid GROUP BY ALL)
SELECT criterion, config, round(m, 6) AS mean_pct, CAST(row_number() OVER (PARTITION BY criterion ORDER BY round(m, 9) DESC NULLS LAST, config) AS INTEGER) AS place, CAST(list_position([{_LISTED}], config) AS INTEGER) AS listed FROM m""",
    "delta_ranges": f"""WITH {q_metrics._GRID}, m AS (SELECT config, criterion, round(avg(pct_met) FILTER (rule = 'cover70') - avg(pct_met) FILTER (rule = 'anyhit'), 6) AS x FROM sgrid GROUP BY ALL)
SELECT criterion, min(x) AS least, max(x) AS most, round(avg(x), 5) AS mean, count(x) AS n FROM m GROUP BY criterion""",
    "window_counts": f"""WITH {inputs.FILES},{INTERVALS},{q_events._GRID},{q_events._DENSE}, s AS (SELECT filename, start_sample FROM grid UNION SELECT filename, start_sample FROM dense)
SELECT f.filename, count(s.start_sample) AS n_windows, count(*) FILTER (s.start_sample % 1024 = 0) AS n_grid FROM files f LEFT JOIN s USING (filename) GROUP BY f.filename""",
    "fixed_picks": f"""WITH {q_catalog._AUDIT}, a AS (SELECT * FROM audit WHERE n_seizures > 0 AND duration_sec >= 4), f AS (SELECT subject, min(filename) AS filename, row_number() OVER (ORDER BY subject) - 1 AS i, count(*) OVER () AS n FROM a GROUP BY subject),
c AS (SELECT subject, filename FROM f WHERE i = 0 OR i = n - 1 OR i = n // 2)
SELECT subject, c.filename, CAST(floor((CAST(floor(m.x * 256) AS BIGINT) - 1024) * p.p) AS BIGINT) AS start_sample FROM c JOIN (SELECT filename, max(duration_sec) AS x FROM a GROUP BY filename) m USING (filename) CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.6 AS DOUBLE))) p(p)""",
    "recordings_by_month": """SELECT strftime(recorded_at, '%Y-%m') AS month, count(*) AS n, count(DISTINCT nullif(lower(trim(subject)), '')) AS n_subjects, round(sum(CASE WHEN isfinite(duration_sec) THEN duration_sec END) / 3600, 6) AS hours
FROM recordings WHERE recorded_at IS NOT NULL GROUP BY 1""",
    "missing_split": f"""WITH {q_catalog._AUDIT},{q_catalog._FEATURES},
h AS (SELECT filename, {", ".join(f"bool_or(coalesce({c}, false)) AS {c}" for c in q_catalog._HAS)} FROM audit GROUP BY filename),
x AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(h.has_{c.split('__')[0]}, false) AS p FROM features f LEFT JOIN h USING (filename) WHERE f.{c} IS NULL" for c in FEATURES)})
SELECT feature, count(*) FILTER (NOT p) AS n_structural, count(*) FILTER (p) AS n_computational FROM x GROUP BY feature""",
    "optional_rank": f"""WITH {q_catalog._FEATURES}, f AS (SELECT label, {_BLOCK_EACH("$")} FROM features WHERE label IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in _FEATURE_BLOCK)}), e AS (SELECT {_BLOCK_EACH("min($) AS lo_$, max($) AS hi_$")} FROM f),
long AS (SELECT label, unnest([{_BLOCK_EACH("{'c': '$', 'x': coalesce(($ - lo_$) / nullif(hi_$ - lo_$, 0), 0)}")}]) AS v FROM f CROSS JOIN e),
o AS (SELECT v.c AS feature, label, sum(v.x) AS o, count(*) AS n FROM long GROUP BY ALL),
x AS (SELECT feature, o, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM o),
s AS (SELECT feature, coalesce(sum((o - e) ** 2 / nullif(e, 0)), -1) AS chi2 FROM x GROUP BY feature),
r AS (SELECT feature, row_number() OVER (ORDER BY chi2 DESC NULLS LAST, feature) AS rank FROM s)
SELECT '{OPTIONAL}' AS feature, (SELECT count(*) FROM f) AS n_rows, CASE WHEN (SELECT count(*) FROM f) >= {LEAST_ROWS} THEN CAST((SELECT max(rank) FROM r WHERE feature = '{OPTIONAL}') AS INTEGER) END AS rank""",
}
