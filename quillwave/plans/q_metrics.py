"""Metric, join, set and reshaping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwave.operators import metrics
from quillwave.plans import inputs
from quillwave.plans.inputs import RECORDS
from quillwave.semantics import fold_id, normal, ratio
from quillwave.tables import table


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def confusion_by_group(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(inputs.records(spark, d).where("split IS NOT NULL"), ["run_id", "split"], predicted="units >= 3000")


def prf_specificity(spark: SparkSession, d: str) -> DataFrame:
    return _r6(metrics.window_rates(confusion_by_group(spark, d)), "precision", "recall", "specificity", "f1")


def auc_roc(spark: SparkSession, d: str) -> DataFrame:
    return _r6(metrics.auc_roc(inputs.records(spark, d), ["run_id"], "units", "label"), "auc")


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return _r6(metrics.average_precision(inputs.records(spark, d), ["run_id"], "units", "label"), "ap")


def pooled_auc_by_config(spark: SparkSession, d: str) -> DataFrame:
    """Test scores of all folds pooled, each record once, by configuration and model."""
    runs = table(spark, d, "runs").select("run_id", "config", "model")
    rows = inputs.records(spark, d).where("split = 'test' AND grid").join(runs, "run_id")
    keys = ["config", "model"]
    return _r6(metrics.auc_roc(rows, keys, "units", "label").join(metrics.average_precision(rows, keys, "units", "label"), keys), "auc", "ap")


def macro_window_rates(spark: SparkSession, d: str) -> DataFrame:
    """Mean over subjects of their window recall and precision, and the pooled ones."""
    counts = metrics.confusion(inputs.records(spark, d).where("subject IS NOT NULL AND split = 'test'"), ["run_id", "subject"], predicted="units >= 3000")
    rates = metrics.window_rates(counts)
    out = rates.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_subjects"), F.avg("recall").alias("macro_recall"), F.avg("precision").alias("macro_precision"),
        ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("micro_recall"), ratio(F.sum("tp"), F.sum(F.col("tp") + F.col("fp"))).alias("micro_precision"),
    )
    return _r6(out, "macro_recall", "macro_precision", "micro_recall", "micro_precision")


def constant_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Window rates of flagging nothing and of flagging all."""
    rows = inputs.records(spark, d).where("split = 'test'")
    both = [metrics.window_rates(metrics.confusion(rows, ["run_id"], predicted=p)).withColumn("baseline", F.lit(n)) for n, p in (("never", "units > 10000"), ("always", "units >= 0"))]
    return _r6(both[0].unionByName(both[1]), "precision", "recall", "specificity", "f1")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """The sensitivity grid without copies and spelling variants."""
    rows = table(spark, d, "sensitivity_grid")
    keys = [F.col("plan_id"), F.col("config"), normal("scheme").alias("scheme"), fold_id("scheme", "fold").alias("fold_id"), F.col("merge_gap"), F.col("min_duration"), F.col("criterion"), F.col("rule")]
    return rows.groupBy(*keys).agg(F.max("n_subjects").alias("n_subjects"), F.max("n_met").alias("n_met"), F.max("pct_met").alias("pct_met"))


def sensitivity_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Share of subjects that meet each criterion, over all folds, by merge gap and least duration."""
    out = _grid(spark, d).groupBy("merge_gap", "min_duration", "criterion", "rule").agg(F.sum("n_subjects").alias("n_subjects"), F.sum("n_met").alias("n_met"), F.round(F.avg("pct_met"), 6).alias("mean_pct"))
    return out.withColumn("pooled_pct", F.round(100 * ratio(F.col("n_met"), F.col("n_subjects")), 6))


def best_setting(spark: SparkSession, d: str) -> DataFrame:
    """The setting with the best pooled share of each criterion and rule, ties to the smaller setting."""
    order = Window.partitionBy("criterion", "rule").orderBy(F.col("pooled_pct").desc_nulls_last(), "merge_gap", "min_duration")
    return sensitivity_pooled(spark, d).withColumn("_r", F.row_number().over(order)).where("_r = 1").select("criterion", "rule", "merge_gap", "min_duration", "pooled_pct")


def pivot_rate(spark: SparkSession, d: str) -> DataFrame:
    """Pooled share by merge gap, one column per least duration."""
    return sensitivity_pooled(spark, d).groupBy("merge_gap", "criterion", "rule").pivot("min_duration", [0, 6]).agg(F.first("pooled_pct")).select("merge_gap", "criterion", "rule", F.col("0").alias("min_0"), F.col("6").alias("min_6"))


def rule_delta(spark: SparkSession, d: str) -> DataFrame:
    """Second rule minus first, by configuration and criterion."""
    deltas = metrics.lift_deltas(_grid(spark, d), ["config", "criterion"], "rule", ("anyhit", "cover70"), ["pct_met"])
    return _r6(deltas, "pct_met_a", "pct_met_b", "pct_met_delta", "pct_met_pct")


def rule_compare_union(spark: SparkSession, d: str) -> DataFrame:
    """Both rules' means, one below the other, with labels."""
    rows = _grid(spark, d)
    parts = [rows.where(F.col("rule") == r).groupBy("config", "criterion").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pct_met"), 6).alias("mean_pct")).withColumn("label", F.lit(label)) for r, label in (("anyhit", "any overlap"), ("cover70", "70 % overlap"))]
    return parts[0].unionByName(parts[1])


def config_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Configurations with their electrodes, score quality and pass rates, by left joins; a category from the name."""
    runs = table(spark, d, "runs")
    electrodes = F.array_size(F.array_distinct(F.flatten(F.transform("channels", lambda c: F.split(F.lower(c), "-")))))
    base = runs.groupBy("config").agg(F.max("n_channels").alias("n_channels"), F.max(electrodes).alias("n_electrodes"), F.count(F.lit(1)).alias("n_runs"))
    auc = metrics.auc_roc(inputs.records(spark, d).where("split = 'test'").join(runs.select("run_id", "config"), "run_id"), ["config"], "units", "label")
    passed = _grid(spark, d).where("rule = 'anyhit'").groupBy("config").agg(F.round(F.avg("pct_met"), 6).alias("pct_met"))
    family = F.when(F.col("config").startswith("wide"), "wide").when(F.col("config") == "pair2", "pair").otherwise("reduced")
    out = base.join(auc, "config", "left").join(passed, "config", "left")
    return out.select("config", "n_channels", "n_electrodes", "n_runs", F.round("auc", 6).alias("auc"), "pct_met", family.alias("family"))


def ladder_families(spark: SparkSession, d: str) -> DataFrame:
    """Each family's configurations with the widest as shared anchor in every family, in the order of their size."""
    ladder = config_ladder(spark, d)
    top = ladder.agg(F.max(F.struct("n_channels", "config")).alias("_t")).select(F.col("_t.config").alias("_top"))
    marked = ladder.crossJoin(F.broadcast(top))  # one row
    families = F.when(F.col("config") == F.col("_top"), F.array(F.lit("wide"), F.lit("pair"), F.lit("reduced"))).otherwise(F.array("family"))
    rows = marked.withColumn("line", F.explode(families))
    return rows.select("line", "config", "n_channels", F.row_number().over(Window.partitionBy("line").orderBy(F.col("n_channels").desc(), "config")).alias("place"))


def run_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """Runs that the plans call for, configurations and models times the folds of their plan, and whether they were made."""
    runs = table(spark, d, "runs")
    wanted = runs.select("plan_id", "config", "model", "scheme").distinct().join(runs.select("plan_id", "scheme", "fold").distinct(), ["plan_id", "scheme"])
    keys = ["plan_id", "config", "model", "scheme", "fold"]
    made = runs.select(*keys).distinct().withColumn("made", F.lit(True))
    return wanted.join(made, keys, "left").select(*keys, F.coalesce("made", F.lit(False)).alias("made"))


def semi_isin(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that have windows with a positive label."""
    positive = table(spark, d, "windows").where("label = 1").select(normal("filename").alias("filename"))
    return inputs.files(spark, d).join(positive, "filename", "left_semi").select("filename", F.round("duration_sec", 6).alias("duration_sec"))


def anti_done(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that still have no windows."""
    done = table(spark, d, "windows").select(normal("filename").alias("filename")).where("filename IS NOT NULL")
    return inputs.files(spark, d).join(done, "filename", "left_anti").select("filename")


def except_foreign(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of the windows that the recordings don't know, and the other way round."""
    a = table(spark, d, "windows").select(normal("subject_id").alias("subject")).where("subject IS NOT NULL")
    b = table(spark, d, "recordings").select(normal("subject").alias("subject")).where("subject IS NOT NULL")
    only = lambda x, y, side: x.distinct().subtract(y.distinct()).withColumn("side", F.lit(side))
    return only(a, b, "windows").unionByName(only(b, a, "recordings"))


def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    """The first extracted window of each start."""
    w = table(spark, d, "windows").select(normal("filename").alias("filename"), F.round(F.nanvl("window_start_sec", F.lit(None).cast("double")) * 1000).cast("long").alias("start_ms"), F.unix_micros(F.col("extracted_at").cast("timestamp")).alias("at"))
    return w.dropna(subset=["filename", "start_ms"]).groupBy("filename", "start_ms").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n_versions"))


def reindex_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every run with every split, also where it has no records."""
    counts = inputs.records(spark, d).groupBy("run_id", "split").agg(F.count(F.lit(1)).alias("n"))
    every = table(spark, d, "runs").select("run_id", F.explode(F.array(F.lit("test"), F.lit("tuning"), F.lit("warmup"))).alias("split"))
    return every.join(counts, ["run_id", "split"], "left").select("run_id", "split", "n", F.when(F.col("n").isNull(), "no records").otherwise("records").alias("status"))


def features_to_scores(spark: SparkSession, d: str) -> DataFrame:
    """Mean feature values of flagged and other windows, joined on whole milliseconds."""
    w = table(spark, d, "windows").select(normal("filename").alias("filename"), F.round(F.nanvl("window_start_sec", F.lit(None).cast("double")) * 1000).cast("long").alias("start_ms"), F.nanvl(F.col("t7_p7__linelength").cast("double"), F.lit(None).cast("double")).alias("x"))
    one = w.dropna(subset=["filename", "start_ms"]).groupBy("filename", "start_ms").agg(F.max("x").alias("x"))
    joined = inputs.records(spark, d).where("units IS NOT NULL").join(one, ["filename", "start_ms"])
    return joined.groupBy("run_id", (F.col("units") >= 3000).alias("flagged")).agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean_x"))


QUERIES = {
    q.__name__: q for q in (
        confusion_by_group, prf_specificity, auc_roc, average_precision, pooled_auc_by_config, macro_window_rates, constant_baselines, sensitivity_pooled, best_setting, pivot_rate, rule_delta,
        rule_compare_union, config_ladder, ladder_families, run_enumeration, semi_isin, anti_done, except_foreign, dedup_first, reindex_grid, features_to_scores,
    )
}


def _confusion(keys: str, where: str, predicted: str) -> str:
    return f"""SELECT {keys}, count(*) FILTER (label = 1 AND {predicted}) AS tp, count(*) FILTER (label <> 1 AND {predicted}) AS fp, count(*) FILTER (label = 1 AND NOT {predicted}) AS fn,
  count(*) FILTER (label <> 1 AND NOT {predicted}) AS tn FROM records WHERE units IS NOT NULL AND {where} GROUP BY {keys}"""


def _rates(source: str, keys: str, digits: str = "6") -> str:
    return f"""SELECT {keys}, tp, fp, fn, tn, round(p, {digits}) AS precision, round(r, {digits}) AS recall, round(s, {digits}) AS specificity, round(2 * p * r / nullif(p + r, 0), {digits}) AS f1
  FROM (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tn / nullif(tn + fp, 0) AS s FROM ({source}))"""


def _auc(source: str, keys: str) -> str:
    return f"""SELECT {keys}, sum((n - p) * (tp - p + p / 2)) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auc, sum(p / nullif(pp, 0) * tp / upto) AS ap FROM (
    SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS upto, sum(p) OVER (PARTITION BY {keys}) AS pp, sum(n) OVER (PARTITION BY {keys}) AS nn
    FROM (SELECT {keys}, units, count(*) AS n, sum(label) AS p FROM {source} WHERE units IS NOT NULL AND label IS NOT NULL GROUP BY {keys}, units)
    WINDOW w AS (PARTITION BY {keys} ORDER BY units DESC)) GROUP BY {keys}"""


_GRID = r"""
sgrid AS (
  SELECT plan_id, config, lower(trim(scheme)) AS scheme,
    CASE WHEN lower(trim(scheme)) = 'loo' THEN regexp_extract(lower(fold), '([a-z]+[0-9]+)', 1) ELSE regexp_extract(regexp_replace(trim(fold), '\.0*$', ''), '([0-9]+)$', 1) END AS fold_id,
    merge_gap, min_duration, criterion, rule, max(n_subjects) AS n_subjects, max(n_met) AS n_met, max(pct_met) AS pct_met FROM sensitivity_grid GROUP BY ALL)"""
_POOLED = f"""{_GRID},
pooled AS (SELECT merge_gap, min_duration, criterion, rule, CAST(sum(n_subjects) AS BIGINT) AS n_subjects, CAST(sum(n_met) AS BIGINT) AS n_met, round(avg(pct_met), 6) AS mean_pct,
  round(100 * (sum(n_met) / nullif(sum(n_subjects), 0)), 6) AS pooled_pct FROM sgrid GROUP BY ALL)"""
_LADDER = f"""{RECORDS},{_GRID},
base AS (SELECT config, max(n_channels) AS n_channels, max(len(list_distinct(flatten(list_transform(channels, lambda c: string_split(lower(c), '-')))))) AS n_electrodes, count(*) AS n_runs FROM runs GROUP BY config),
aucs AS ({_auc("(SELECT r.*, u.config FROM records r JOIN runs u USING (run_id) WHERE r.split = 'test')", "config")}),
passed AS (SELECT config, round(avg(pct_met), 6) AS pct_met FROM sgrid WHERE rule = 'anyhit' GROUP BY config),
ladder AS (SELECT config, n_channels, n_electrodes, n_runs, round(auc, 6) AS auc, pct_met,
  CASE WHEN config LIKE 'wide%' THEN 'wide' WHEN config = 'pair2' THEN 'pair' ELSE 'reduced' END AS family FROM base LEFT JOIN aucs USING (config) LEFT JOIN passed USING (config))"""
_FILENAMES = "SELECT lower(trim(filename)) AS filename FROM windows WHERE filename IS NOT NULL"
_STARTS = "SELECT lower(trim(filename)) AS filename, CAST(round(window_start_sec * 1000) AS BIGINT) AS start_ms, extracted_at, CAST(t7_p7__linelength AS DOUBLE) AS x FROM windows WHERE filename IS NOT NULL AND window_start_sec IS NOT NULL AND NOT isnan(window_start_sec)"

SQL = {
    "confusion_by_group": f"WITH {RECORDS} {_confusion('run_id, split', 'split IS NOT NULL', '(units >= 3000)')}",
    "prf_specificity": f"WITH {RECORDS} {_rates(_confusion('run_id, split', 'split IS NOT NULL', '(units >= 3000)'), 'run_id, split')}",
    "auc_roc": f"WITH {RECORDS} SELECT run_id, round(auc, 6) AS auc FROM ({_auc('records', 'run_id')})",
    "average_precision": f"WITH {RECORDS} SELECT run_id, round(ap, 6) AS ap FROM ({_auc('records', 'run_id')})",
    "pooled_auc_by_config": f"""WITH {RECORDS} SELECT config, model, round(auc, 6) AS auc, round(ap, 6) AS ap
  FROM ({_auc("(SELECT r.*, u.config, u.model FROM records r JOIN runs u USING (run_id) WHERE r.split = 'test' AND r.grid)", "config, model")})""",
    "macro_window_rates": f"""WITH {RECORDS}, c AS ({_confusion("run_id, subject", "subject IS NOT NULL AND split = 'test'", "(units >= 3000)")})
SELECT run_id, count(*) AS n_subjects, round(avg(tp / nullif(tp + fn, 0)), 6) AS macro_recall, round(avg(tp / nullif(tp + fp, 0)), 6) AS macro_precision,
  round(sum(tp) / nullif(sum(tp + fn), 0), 6) AS micro_recall, round(sum(tp) / nullif(sum(tp + fp), 0), 6) AS micro_precision FROM c GROUP BY run_id""",
    "constant_baselines": f"""WITH {RECORDS} {_rates(_confusion("run_id", "split = 'test'", "(units > 10000)"), "run_id")
        .replace("SELECT run_id, tp", "SELECT 'never' AS baseline, run_id, tp", 1)} UNION ALL {_rates(_confusion("run_id", "split = 'test'", "(units >= 0)"), "run_id").replace("SELECT run_id, tp", "SELECT 'always' AS baseline, run_id, tp", 1)}""",
    "sensitivity_pooled": f"WITH {_POOLED} SELECT * FROM pooled",
    "best_setting": f"WITH {_POOLED} SELECT criterion, rule, merge_gap, min_duration, pooled_pct FROM pooled QUALIFY row_number() OVER (PARTITION BY criterion, rule ORDER BY pooled_pct DESC NULLS LAST, merge_gap, min_duration) = 1",
    "pivot_rate": f"WITH {_POOLED} SELECT merge_gap, criterion, rule, max(pooled_pct) FILTER (min_duration = 0) AS min_0, max(pooled_pct) FILTER (min_duration = 6) AS min_6 FROM pooled GROUP BY ALL",
    "rule_delta": f"""WITH {_GRID}, m AS (SELECT config, criterion, avg(pct_met) FILTER (rule = 'anyhit') AS a, avg(pct_met) FILTER (rule = 'cover70') AS b FROM sgrid GROUP BY ALL)
SELECT config, criterion, round(a, 6) AS pct_met_a, round(b, 6) AS pct_met_b, round(b - a, 6) AS pct_met_delta, round(100 * (b - a) / nullif(a, 0), 6) AS pct_met_pct FROM m""",
    "rule_compare_union": f"""WITH {_GRID} SELECT config, criterion, count(*) AS n, round(avg(pct_met), 6) AS mean_pct, CASE rule WHEN 'anyhit' THEN 'any overlap' ELSE '70 % overlap' END AS label
  FROM sgrid WHERE rule IN ('anyhit', 'cover70') GROUP BY config, criterion, rule""",
    "config_ladder": f"WITH {_LADDER} SELECT * FROM ladder",
    "ladder_families": f"""WITH {_LADDER}, top AS (SELECT config FROM ladder ORDER BY n_channels DESC, config DESC LIMIT 1),
lines AS (SELECT unnest(CASE WHEN config = (SELECT config FROM top) THEN ['wide', 'pair', 'reduced'] ELSE [family] END) AS line, config, n_channels FROM ladder)
SELECT line, config, n_channels, CAST(row_number() OVER (PARTITION BY line ORDER BY n_channels DESC, config) AS INTEGER) AS place FROM lines""",
    "run_enumeration": """SELECT w.plan_id, w.config, w.model, w.scheme, f.fold, EXISTS (SELECT 1 FROM runs r WHERE r.plan_id = w.plan_id AND r.config = w.config AND r.model = w.model AND r.scheme = w.scheme AND r.fold = f.fold) AS made
  FROM (SELECT DISTINCT plan_id, config, model, scheme FROM runs) w JOIN (SELECT DISTINCT plan_id, scheme, fold FROM runs) f USING (plan_id, scheme)""",
    "semi_isin": f"WITH {inputs.FILES} SELECT filename, round(duration_sec, 6) AS duration_sec FROM files WHERE filename IN (SELECT lower(trim(filename)) FROM windows WHERE label = 1)",
    "anti_done": f"WITH {inputs.FILES} SELECT filename FROM files WHERE filename NOT IN ({_FILENAMES})",
    "except_foreign": """WITH a AS (SELECT DISTINCT lower(trim(subject_id)) AS subject FROM windows WHERE trim(subject_id) <> ''), b AS (SELECT DISTINCT lower(trim(subject)) AS subject FROM recordings WHERE trim(subject) <> '')
SELECT subject, 'windows' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT subject, 'recordings' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "dedup_first": f"SELECT filename, start_ms, epoch_us(min(extracted_at)) AS first_at, count(*) AS n_versions FROM ({_STARTS}) GROUP BY filename, start_ms",
    "reindex_grid": f"""WITH {RECORDS}, c AS (SELECT run_id, split, count(*) AS n FROM records GROUP BY ALL), e AS (SELECT run_id, unnest(['test', 'tuning', 'warmup']) AS split FROM runs)
SELECT e.run_id, e.split, c.n, CASE WHEN c.n IS NULL THEN 'no records' ELSE 'records' END AS status FROM e LEFT JOIN c ON e.run_id = c.run_id AND e.split = c.split""",
    "features_to_scores": f"""WITH {RECORDS}, w AS (SELECT filename, start_ms, max(CASE WHEN isnan(x) THEN NULL ELSE x END) AS x FROM ({_STARTS}) GROUP BY ALL)
SELECT run_id, units >= 3000 AS flagged, count(x) AS n, round(avg(x), 4) AS mean_x FROM records JOIN w USING (filename, start_ms) WHERE units IS NOT NULL GROUP BY ALL""",
}
