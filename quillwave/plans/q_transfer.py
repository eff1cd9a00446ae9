"""Transfer, sensitivity, detection and sink queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.operators import events, scoring, sweep
from quillwave.operators.metrics import _by_score
from quillwave.operators.windows import overlap_join, overlap_ms
from quillwave.plans import inputs, q_catalog, q_events
from quillwave.plans.inputs import FILES, INTERVALS, RECORDS, merged, split
from quillwave.plans.q_events import AT, CRITERIA, GAP, RULES, RUN_FILE
from quillwave.semantics import ratio
from quillwave.session import materialise, scratch_path
from quillwave.sources import sinks
from quillwave.tables import table

GAPS, LEASTS = (0, 10_000, 28_000), (0, 6000)
#: The settings of the whole sensitivity analysis.
GAPS_FULL, LEASTS_FULL = (0, 4000, 8000, 12_000, 16_000, 20_000, 28_000), (0, 1000, 2000)


def _absolute(spark: SparkSession, d: str, picked: DataFrame, rule: scoring.Rule) -> DataFrame:
    rows, refs, listed = q_events._scorable(spark, d, "test")
    spans = events.positives(rows.join(picked, "run_id"), "threshold", RUN_FILE)
    hyps = events.split_long(events.merge_spans(spans, RUN_FILE, GAP).drop("n"))
    totals = scoring.score(refs, hyps, listed, rule, RUN_FILE).groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])
    hours = rows.groupBy("run_id").agg((F.count(F.lit(1)) * F.lit(4 / 3600)).alias("hours"))
    has = picked.withColumn("_t", F.col("threshold"))
    rated = scoring.rates(totals.join(hours, "run_id").join(has, "run_id", "left"))
    found = F.col("threshold").isNotNull()
    out = sweep.criteria_met(rated, *CRITERIA["medication_titration"])
    return out.select("run_id", "threshold", *[F.when(found, F.col(c)).alias(c) for c in ("tp", "fp")], "ref_true", *[F.round(F.when(found, F.col(c)), 6).alias(c) for c in ("sens", "fa_per_day")], (F.col("met") & found).alias("met"))


def absolute_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Each run's tuning threshold used as it is on its test split; runs without one don't meet the criterion."""
    return _absolute(spark, d, materialise(q_events.pick_threshold(spark, d).select("run_id", "threshold"), "picked"), scoring.ANY_HIT)


def absolute_transfer_full(spark: SparkSession, d: str) -> DataFrame:
    """The same for thresholds picked from all 279, under both rules."""
    picked = materialise(q_events.pick_threshold_full(spark, d).select("run_id", "rule", "threshold"), "picked")
    both = [_absolute(spark, d, picked.where(F.col("rule") == r.name).drop("rule"), r).withColumn("rule", F.lit(r.name)) for r in RULES]
    return both[0].unionByName(both[1])


def postprocessing_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every run's test split by merge gap and least duration."""
    rows, refs, listed = q_events._scorable(spark, d, "test")
    spans = events.positives(rows, AT, RUN_FILE)
    grid = F.explode(F.array(*[F.lit(g) for g in LEASTS]))
    keys = [*RUN_FILE, "merge_gap", "min_duration"]
    parts = [events.merge_spans(spans, RUN_FILE, g).withColumn("merge_gap", F.lit(g)) for g in GAPS]
    each = reduce(DataFrame.unionByName, parts).withColumn("min_duration", grid)
    hyps = events.split_long(each.where(F.col("end_ms") - F.col("start_ms") >= F.col("min_duration")).drop("n"))
    both = lambda df: df.withColumn("merge_gap", F.explode(F.array(*[F.lit(g) for g in GAPS]))).withColumn("min_duration", grid)
    totals = scoring.score(both(refs), hyps, both(listed), scoring.ANY_HIT, keys)
    return totals.groupBy("run_id", "merge_gap", "min_duration").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])


def postprocessing_sensitivity_full(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that meet each criterion, by run, merge gap, least duration and rule.

    For every setting the tuning curve is swept, a threshold picked (with
    fallback), moved to the test split by the share it flags, and scored there.
    """
    # no span is shorter than one window, so least durations up to that leave the same spans and are laid out last
    assert max(LEASTS_FULL) <= events.WINDOW_MS
    grid = inputs.records(spark, d).where("units IS NOT NULL AND grid")
    tuning = materialise(grid.where("split = 'tuning'"), "records")
    rows, refs, listed = q_events._scorable(spark, d, "test")
    curve = sweep.state_curves(tuning, inputs.intervals(spark, d), inputs.files(spark, d), "run_id", "filename", sweep.threshold_units(), GAPS_FULL, RULES)
    curve = materialise(q_events._rounded(curve, "hours", "sens", "fa_per_day"), "curve")
    setting = ["run_id", "merge_gap", "rule"]
    picks = [sweep.pick_threshold(curve, setting, most, True).select(*setting, F.lit(name).alias("criterion"), F.lit(least).alias("least"), F.lit(most).alias("most"), F.col("threshold").alias("picked")) for name, (least, most) in CRITERIA.items()]
    picked = materialise(reduce(DataFrame.unionByName, picks), "picked")
    share = tuning.join(picked.select("run_id", "picked").distinct(), "run_id").groupBy("run_id", "picked").agg(F.avg((F.col("units") >= F.col("picked")).cast("int")).alias("fraction"))
    moved = events.kth_largest(rows.join(share, "run_id"), ["run_id", "picked"], "units", "fraction").select("run_id", "picked", "threshold")
    moved = materialise(picked.join(moved, ["run_id", "picked"]), "moved")
    subject = F.regexp_extract("filename", r"^([a-z]+\d+)_", 1).alias("subject")
    hours = rows.groupBy("run_id", subject).agg((F.count(F.lit(1)) * F.lit(4 / 3600)).alias("hours"))
    keys = [*RUN_FILE, "merge_gap", "threshold"]
    parts = []
    for rule in RULES:
        points = moved.where(F.col("rule") == rule.name).select("run_id", "merge_gap", "threshold").distinct()
        spans = events.positives(rows.join(points, "run_id"), "threshold", keys)
        hyps = events.split_long(events.merge_spans(spans, keys, "merge_gap").drop("n"))
        totals = scoring.score(refs.join(points, "run_id"), hyps, listed.join(points, "run_id"), rule, keys)
        sums = totals.groupBy("run_id", subject, "merge_gap", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "ref_true")])
        parts.append(sums.withColumn("rule", F.lit(rule.name)))
    every = moved.join(hours, "run_id")
    rated = scoring.rates(every.join(reduce(DataFrame.unionByName, parts), [*setting, "threshold", "subject"], "left"))
    met = sweep.criteria_met(rated, F.col("least"), F.col("most"))
    out = met.groupBy(*setting, "criterion").agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if("met").alias("n_met"))
    out = out.withColumn("pct_met", F.round(100 * ratio(F.col("n_met"), F.col("n_subjects")), 6))
    return out.withColumn("min_duration", F.explode(F.array(*[F.lit(m) for m in LEASTS_FULL])))


def threshold_for_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The highest threshold whose window sensitivity reaches four fifths: it has fewest false positives."""
    s = _by_score(inputs.records(spark, d), ["run_id"], "units", "label")
    ok = s.where(F.col("_allp") > 0).where(F.col("_tp") * 5 >= F.col("_allp") * 4)
    order = Window.partitionBy("run_id").orderBy(F.col("_x").desc())
    best = ok.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("run_id", F.col("_x").alias("threshold"), F.col("_tp").alias("tp"), (F.col("_upto") - F.col("_tp")).alias("fp"), F.round(ratio(F.col("_tp"), F.col("_allp")), 6).alias("sens"))


def detection_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Share of short and of long labelled events that a flagged window overlaps, per run."""
    rows = inputs.records(spark, d).where("units IS NOT NULL AND split = 'test'")
    events_of = rows.select(*RUN_FILE).distinct().join(inputs.intervals(spark, d), "filename").withColumn("_k", F.to_json(F.struct(*RUN_FILE)))
    flagged = events.positives(rows, AT, RUN_FILE).withColumn("_k", F.to_json(F.struct(*RUN_FILE))).select("_k", "start_ms", "end_ms")
    hit = overlap_join(events_of, flagged, "_k").where(overlap_ms() > 0).select("_k", "idx").distinct().withColumn("hit", F.lit(1))
    out = events_of.join(hit, ["_k", "idx"], "left").withColumn("length", F.when(F.col("end_ms") - F.col("start_ms") < 30_000, "short").otherwise("long"))
    return out.groupBy("run_id", "length").agg(F.count(F.lit(1)).alias("n_events"), F.count("hit").alias("n_found"))


def tier_base_shift(spark: SparkSession, d: str) -> DataFrame:
    """The same scores on all recordings and on those with every channel: counts on both bases and the difference."""
    from quillwave.operators import catalog

    audit = catalog.recordings(table(spark, d, "recordings"))
    full = audit.where(catalog.has_all([c for c in audit.columns if c.startswith("has_")])).select("filename").distinct()
    per_file = q_events.score_rule_a(spark, d).join(full.withColumn("_a", F.lit(1)), "filename", "left")
    out = per_file.groupBy("run_id").agg(*[F.sum(c).alias(f"{c}_all") for c in ("tp", "ref_true")], *[F.sum(F.when(F.col("_a") == 1, F.col(c)).otherwise(0)).alias(f"{c}_full") for c in ("tp", "ref_true")])
    delta = ratio(F.col("tp_full"), F.col("ref_true_full")) - ratio(F.col("tp_all"), F.col("ref_true_all"))
    return out.withColumn("sens_delta", F.round(delta, 6))


def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The recordings written as delimited text and read with an explicit schema: doubles come back exactly."""
    a = table(spark, d, "recordings").select("subject", "filename", "duration_sec", "n_seizures")
    path = scratch_path(spark, "csv")
    sinks.write_text(a, path)
    return sinks.read_text(a.schema, spark, path)


def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The runs written as one JSON document a line, lists included, and read with an explicit schema."""
    runs = table(spark, d, "runs").select("run_id", "plan_id", "fold_label", "test_subjects", "elapsed_sec")
    path = scratch_path(spark, "json")
    sinks.write_documents(runs, path)
    back = sinks.read_documents(runs.schema, spark, path)
    return back.select("run_id", "plan_id", "fold_label", F.array_join("test_subjects", ";").alias("test_subjects"), "elapsed_sec")


def partitioned_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Scores written by configuration and model; one configuration's partitions read back."""
    runs = table(spark, d, "runs").select("run_id", "config", "model")
    path = scratch_path(spark, "predictions")
    sinks.write_partitioned(inputs.records(spark, d).select("run_id", "filename", "start_ms", "units").join(runs, "run_id"), path, ["config", "model"])
    back = spark.read.parquet(path).where("config = 'wide18'")
    return back.groupBy("config", "model").agg(F.count(F.lit(1)).alias("n"), F.count("units").alias("n_usable"), F.sum("units").cast("long").alias("units"))


def pending_runs(spark: SparkSession, d: str) -> DataFrame:
    """Recordings of a run's test subjects that have no predictions yet."""
    wanted = table(spark, d, "runs").select("run_id", F.explode("test_subjects").alias("s")).select("run_id", F.lower(F.trim("s")).alias("subject")).distinct()
    files = table(spark, d, "recordings").select(F.lower(F.trim("subject")).alias("subject"), F.lower(F.trim("filename")).alias("filename")).dropna().distinct()
    return sinks.pending(wanted.join(files, "subject").select("run_id", "filename"), inputs.records(spark, d), ["run_id", "filename"])


QUERIES = {q.__name__: q for q in (absolute_transfer, absolute_transfer_full, postprocessing_sensitivity, postprocessing_sensitivity_full, threshold_for_sensitivity, detection_by_length, tier_base_shift, csv_roundtrip, json_roundtrip, partitioned_roundtrip, pending_runs)}

_BASE = f"""WITH {RECORDS},{FILES},{INTERVALS},
rows_ AS (SELECT * FROM records WHERE split = 'test' AND grid AND units IS NOT NULL),
listed0 AS (SELECT DISTINCT r.run_id, r.filename, f.duration_sec FROM rows_ r JOIN files f USING (filename)),
refs0 AS (SELECT l.run_id, l.filename, i.start_ms, i.end_ms FROM listed0 l JOIN intervals i USING (filename)),
pos AS (SELECT run_id, filename, start_ms, start_ms + 4000 AS end_ms FROM rows_ WHERE units >= {AT})"""
_SETTINGS = f"settings AS (SELECT g.g AS merge_gap, m.m AS min_duration FROM (SELECT unnest({list(GAPS)}) AS g) g CROSS JOIN (SELECT unnest({list(LEASTS)}) AS m) m)"
_EVERY_GAP = ",".join(merged("pos", f"isl{g}", "run_id, filename", g) for g in GAPS)
_UNION = " UNION ALL ".join(f"SELECT *, {g} AS merge_gap FROM isl{g}" for g in GAPS)


def _transferred_sql(picks: str, points: str, rules) -> str:
    """Relation ``transferred``: test splits scored with the thresholds of relation ``points`` (run_id, rule, threshold)."""
    steps, unions = [], []
    for r in rules:
        t = f"t_{r.name}_"
        steps.append(f"""{t}pos AS (SELECT r.run_id, r.filename, r.start_ms, r.start_ms + 4000 AS end_ms FROM trows r JOIN {points} p ON r.run_id = p.run_id AND p.rule = '{r.name}' AND r.units >= p.threshold),
{merged(f"{t}pos", f"{t}isl", "run_id, filename", GAP)},{split(f"{t}isl", f"{t}hyps", "run_id, filename", 300000)},{inputs.scored(r, RUN_FILE, "trefs", f"{t}hyps", "tlisted", f"{t}scored", t)}""")
        unions.append(f"""SELECT s.run_id, '{r.name}' AS rule, p.threshold, s.tp, s.fp, s.ref_true, s.tp / nullif(s.ref_true, 0) AS sens, s.fp * 24 / nullif(h.hours, 0) AS fa
  FROM (SELECT run_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM {t}scored GROUP BY run_id) s JOIN thours h USING (run_id)
  LEFT JOIN (SELECT * FROM {points} WHERE rule = '{r.name}') p ON s.run_id = p.run_id""")
    return f"""{picks},
trows AS (SELECT * FROM records WHERE split = 'test' AND grid AND units IS NOT NULL),
tlisted AS (SELECT DISTINCT r.run_id, r.filename, f.duration_sec FROM trows r JOIN files f USING (filename)),
trefs AS (SELECT l.run_id, l.filename, i.start_ms, i.end_ms FROM tlisted l JOIN intervals i USING (filename)),
thours AS (SELECT run_id, count(*) * (4 / 3600.0) AS hours FROM trows GROUP BY run_id),
{", ".join(steps)},
sums AS ({" UNION ALL ".join(unions)}),
transferred AS (SELECT run_id, rule, threshold, CASE WHEN threshold IS NOT NULL THEN tp END AS tp, CASE WHEN threshold IS NOT NULL THEN fp END AS fp, ref_true, CASE WHEN threshold IS NOT NULL THEN round(sens, 6) END AS sens,
  CASE WHEN threshold IS NOT NULL THEN round(fa, 6) END AS fa_per_day, coalesce(sens >= 0.6 AND fa <= 5.0, false) AND threshold IS NOT NULL AS met FROM sums)"""


_KEYS4 = [*RUN_FILE, "merge_gap", "min_duration"]

SQL = {
    "absolute_transfer": f"{_transferred_sql(q_events._pick_sql(False, RULES[:1]), 'picked', RULES[:1])} SELECT * EXCLUDE (rule) FROM transferred",
    "absolute_transfer_full": f"{_transferred_sql(q_events._pick_sql(False, RULES), 'picked', RULES)} SELECT * FROM transferred",
    "postprocessing_sensitivity": f"""{_BASE},{_SETTINGS},{_EVERY_GAP},
every_gap AS ({_UNION}),
kept AS (SELECT e.run_id, e.filename, e.merge_gap, s.min_duration, e.start_ms, e.end_ms FROM every_gap e JOIN settings s USING (merge_gap) WHERE e.end_ms - e.start_ms >= s.min_duration),
{split("kept", "hyps", ", ".join(_KEYS4), 300000)},
listed AS (SELECT l.*, s.merge_gap, s.min_duration FROM listed0 l CROSS JOIN settings s), refs AS (SELECT r.*, s.merge_gap, s.min_duration FROM refs0 r CROSS JOIN settings s),
{inputs.scored(scoring.ANY_HIT, _KEYS4, "refs", "hyps", "listed")}
SELECT run_id, merge_gap, min_duration, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(ref_true) AS BIGINT) AS ref_true FROM scored GROUP BY ALL""",
    "threshold_for_sensitivity": f"""WITH {RECORDS}, c AS (SELECT run_id, units, count(*) AS n, sum(label) AS p FROM records WHERE units IS NOT NULL AND label IS NOT NULL GROUP BY ALL),
s AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS upto, sum(p) OVER (PARTITION BY run_id) AS pp FROM c WINDOW w AS (PARTITION BY run_id ORDER BY units DESC))
SELECT run_id, units AS threshold, CAST(tp AS BIGINT) AS tp, CAST(upto - tp AS BIGINT) AS fp, round(tp / pp, 6) AS sens FROM s WHERE pp > 0 AND tp * 5 >= pp * 4 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY units DESC) = 1""",
    "detection_by_length": f"""WITH {RECORDS},{INTERVALS}, r AS (SELECT * FROM records WHERE units IS NOT NULL AND split = 'test'),
e AS (SELECT f.run_id, i.* FROM (SELECT DISTINCT run_id, filename FROM r) f JOIN intervals i USING (filename))
SELECT run_id, CASE WHEN end_ms - start_ms < 30000 THEN 'short' ELSE 'long' END AS length, count(*) AS n_events, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.run_id = e.run_id AND r.filename = e.filename AND r.units >= {AT}
  AND r.start_ms < e.end_ms AND r.start_ms + 4000 > e.start_ms)) AS n_found FROM e GROUP BY ALL""",
    "tier_base_shift": f"""{q_events._score_sql(scoring.ANY_HIT)},{q_catalog._AUDIT},
full_ AS (SELECT DISTINCT filename FROM audit WHERE {q_catalog._ALL}),
sums AS (SELECT run_id, CAST(sum(tp) AS BIGINT) AS tp_all, CAST(sum(ref_true) AS BIGINT) AS ref_true_all, CAST(sum(CASE WHEN f.filename IS NOT NULL THEN tp ELSE 0 END) AS BIGINT) AS tp_full,
  CAST(sum(CASE WHEN f.filename IS NOT NULL THEN ref_true ELSE 0 END) AS BIGINT) AS ref_true_full FROM scored s LEFT JOIN full_ f USING (filename) GROUP BY run_id)
SELECT *, round(tp_full / nullif(ref_true_full, 0) - tp_all / nullif(ref_true_all, 0), 6) AS sens_delta FROM sums""",
    "csv_roundtrip": "SELECT subject, filename, duration_sec, n_seizures FROM recordings",
    "json_roundtrip": "SELECT run_id, plan_id, fold_label, array_to_string(test_subjects, ';') AS test_subjects, elapsed_sec FROM runs",
    "partitioned_roundtrip": f"WITH {RECORDS} SELECT config, model, count(*) AS n, count(units) AS n_usable, CAST(sum(units) AS BIGINT) AS units FROM records JOIN runs USING (run_id) WHERE config = 'wide18' GROUP BY ALL",
    "pending_runs": f"""WITH {RECORDS}, w AS (SELECT DISTINCT run_id, lower(trim(s)) AS subject FROM (SELECT run_id, unnest(test_subjects) AS s FROM runs)),
f AS (SELECT DISTINCT lower(trim(subject)) AS subject, lower(trim(filename)) AS filename FROM recordings WHERE subject IS NOT NULL AND filename IS NOT NULL)
SELECT w.run_id, f.filename FROM w JOIN f USING (subject) WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.run_id = w.run_id AND r.filename = f.filename)""",
}
