"""Catalogue, fold and selection queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.operators import catalog, folds, sampling
from quillwave.plans import inputs
from quillwave.semantics import finite, millis, normal, ratio
from quillwave.tables import table

#: The channels of a full montage, by their flags in the catalogue, and the two that the smaller tier needs besides.
FEATURES = ["fp1_f7__mean", "fp1_f7__variance", "t7_p7__linelength", "cz_pz__spectralentropy"]
TIER_B = ["has_fp1_f7", "has_t7_p7", "has_cz_pz"]
REQUIRED = ["FP1-F7", "F7-T7", "T7-P7", "P7-O1"]


def _audit(spark: SparkSession, d: str) -> DataFrame:
    return catalog.recordings(table(spark, d, "recordings"))


def _flags(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("has_")]


def tier_admission(spark: SparkSession, d: str) -> DataFrame:
    """Admission of each recording: every channel and not monopolar; the smaller tier; subjects remapped."""
    a = _audit(spark, d)
    mono = F.coalesce(F.col("is_monopolar"), F.lit(False))
    merged = F.coalesce(F.create_map(F.lit("pt000042"), F.lit("pt000042-all"))[F.col("subject")], F.col("subject"))
    return a.select("filename", merged.alias("subject"), (catalog.has_all(_flags(a)) & ~mono).alias("tier_a"), (catalog.has_all(TIER_B) & ~mono).alias("tier_b"))


def tier_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Files, hours and seizures per subject and tier, with totals."""
    a = _audit(spark, d)
    tier = F.when(catalog.has_all(_flags(a)) & ~F.coalesce(F.col("is_monopolar"), F.lit(False)), "a").otherwise("other")
    rolled = a.withColumn("tier", tier).rollup("tier", "subject").agg(F.count(F.lit(1)).alias("n_files"), F.round(F.sum("duration_sec") / 3600, 6).alias("hours"), F.sum("n_seizures").alias("n_seizures"))
    return rolled


def none_of(spark: SparkSession, d: str) -> DataFrame:
    """Recordings whose channel list has none of the required channels, beside the stored flag."""
    a = _audit(spark, d)
    return a.select("subject", "filename", catalog.lacks_all("channels", REQUIRED).alias("lacks_all"), catalog.covers("channels", REQUIRED).alias("covers"), "is_monopolar")


def channel_alias(spark: SparkSession, d: str) -> DataFrame:
    """The listed name of a channel, its first copy where the plain one is missing, and the electrode count."""
    a = _audit(spark, d)
    return a.select("subject", "filename", catalog.alias_channel("channels", "T8-P8").alias("t8_p8"), catalog.electrodes(F.col("channels")).alias("n_electrodes"))


def presence_share(spark: SparkSession, d: str) -> DataFrame:
    a = _audit(spark, d)
    return catalog.presence(a, _flags(a), "duration_sec").withColumn("share_pct", F.round("share_pct", 6))


def complete_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Subjects with every channel in every recording, and those without any channel in some."""
    a = _audit(spark, d)
    full, empty = catalog.has_all(_flags(a)), ~reduce(lambda x, y: x | y, [F.coalesce(F.col(f), F.lit(False)) for f in _flags(a)])
    return a.groupBy("subject").agg(F.bool_and(full).alias("complete"), F.bool_or(empty).alias("some_empty"), F.count(F.lit(1)).alias("n_files"))


def dominant_rate(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's most frequent sampling rate, ties to the first seen file."""
    a = _audit(spark, d).withColumn("rate", F.round(finite("sampling_rate"), 3))
    return catalog.first_mode(a, ["subject"], "rate", "filename").select("subject", "rate", "n")


def channel_lists(spark: SparkSession, d: str) -> DataFrame:
    """Foreign channels of each subject: listed but not required."""
    a = _audit(spark, d)
    foreign = a.select("subject", F.explode(F.array_except("channels", F.array(*[F.lit(c) for c in REQUIRED]))).alias("c"))
    return foreign.groupBy("subject").agg(F.array_join(F.array_sort(F.collect_set("c")), ";").alias("foreign_channels"))


def duration_summary(spark: SparkSession, d: str) -> DataFrame:
    """Least, middle, high and most duration of recordings with and without a reference electrode, also in whole seconds."""
    a = _audit(spark, d)
    groups = a.groupBy("is_monopolar").agg(F.min("duration_sec").alias("shortest"), F.max("duration_sec").alias("longest"), F.count(F.lit(1)).alias("n"))
    parts = []
    for value in (True, False, None):  # the values a flag can have
        middle, p95 = sampling.order_statistics(a.where(F.col("is_monopolar").eqNullSafe(F.lit(value).cast("boolean"))), ["duration_sec"], [0.5, 0.95])["duration_sec"]
        whole = [F.lit(v).cast("double") for v in (middle, p95)]
        parts.append(groups.where(F.col("is_monopolar").eqNullSafe(F.lit(value).cast("boolean"))).select("*", F.round(whole[0], 6).alias("middle"), F.round(whole[1], 6).alias("p95")))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("is_monopolar", "shortest", "middle", "longest", "p95", "n", *[F.floor(c).cast("long").alias(f"{c}_sec") for c in ("shortest", "middle", "longest")])


def n_smallest(spark: SparkSession, d: str) -> DataFrame:
    """The ten shortest labelled events (a report of ten rows)."""
    i = inputs.intervals(spark, d)
    return i.withColumn("length_ms", F.col("end_ms") - F.col("start_ms")).orderBy("length_ms", "filename", "idx").limit(10).select("filename", "idx", "length_ms")


def dataset_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Windows, grid windows and positives of each subject, and in all."""
    w = table(spark, d, "windows").select(normal("subject_id").alias("subject"), "on_uniform_grid", "label", normal("filename").alias("filename"))
    return w.where("subject IS NOT NULL").rollup("subject").agg(
        F.count(F.lit(1)).alias("n_windows"), F.count_if(F.coalesce("on_uniform_grid", F.lit(False))).alias("n_grid"), F.count_if(F.coalesce(F.col("label") == 1, F.lit(False))).alias("n_positive"), F.count_distinct("filename").alias("n_files")
    )


def _features(spark: SparkSession, d: str) -> DataFrame:
    """One row per window: the latest extraction, features as doubles, undefined as NULL."""
    from quillwave.operators.records import latest

    rows = table(spark, d, "windows").select(
        normal("subject_id").alias("subject"), normal("filename").alias("filename"), millis("window_start_sec").alias("start_ms"), F.col("label").cast("int").alias("label"), "extracted_at", *[finite(c).alias(c) for c in FEATURES]
    )
    return latest(rows, ["filename", "start_ms"], ["extracted_at"], ["label", "subject", *FEATURES])


def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return catalog.missing_cells(_features(spark, d), ["filename", "start_ms"], FEATURES).groupBy("filename", "column").agg(F.sum("n_missing").alias("n_missing"))


def complete_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows kept and dropped when every feature has to be there."""
    f = _features(spark, d)
    whole = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in FEATURES])
    return f.groupBy("subject").agg(F.count_if(whole).alias("n_kept"), F.count_if(~whole).alias("n_dropped"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return catalog.provenance({n: table(spark, d, n) for n in ("recordings", "windows", "predictions", "runs")})


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(plan_id, fold, subject) of every plan, once; entries of several subjects taken apart."""
    plans = table(spark, d, "cv_folds").select("plan_id", F.explode(F.from_json("folds", "map<string, array<string>>")).alias("name", "entries"))
    one = plans.select("plan_id", F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("fold"), F.explode("entries").alias("entry"))
    return one.select("plan_id", "fold", F.explode(F.split("entry", r"\+")).alias("s")).select("plan_id", "fold", normal("s").alias("subject")).dropna().distinct()


def fold_roles(spark: SparkSession, d: str) -> DataFrame:
    return folds.fold_roles(_members(spark, d)).distinct()


def ring_tuning_pool(spark: SparkSession, d: str) -> DataFrame:
    return folds.ring_pool(_members(spark, d).select("plan_id", "subject").distinct(), ["plan_id"], "subject")


def balanced_fold_plan(spark: SparkSession, d: str) -> DataFrame:
    """A new balanced plan for the subjects of every plan, by their seizures."""
    weights = _audit(spark, d).groupBy("subject").agg(F.sum(F.coalesce("n_seizures", F.lit(0))).cast("int").alias("weight"))
    members = _members(spark, d).select("plan_id", "subject").distinct().join(weights, "subject", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    return folds.fold_plan(members, ["plan_id"], "subject", "weight")


def group_kfold(spark: SparkSession, d: str) -> DataFrame:
    """Folds of the subjects by their windows: the most to the fold with the least, without a bound on subjects per fold."""
    rows = _features(spark, d).where("subject IS NOT NULL").withColumn("_all", F.lit(1))
    weights = rows.groupBy("_all", "subject").agg(F.count(F.lit(1)).alias("weight"))
    return folds.fold_plan(weights, ["_all"], "subject", "weight", cap=False).drop("_all")


def fold_loads(spark: SparkSession, d: str) -> DataFrame:
    """What the new plans balance: subjects and the sum of all weights of each plan, the folds' sizes by their bound, and no fold heavier than the lightest by more than one subject."""
    weights = _audit(spark, d).groupBy("subject").agg(F.sum(F.coalesce("n_seizures", F.lit(0))).cast("int").alias("weight"))
    members = _members(spark, d).select("plan_id", "subject").distinct().join(weights, "subject", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    placed = folds.fold_plan(members, ["plan_id"], "subject", "weight", cap=False).join(members, ["plan_id", "subject"])
    each = placed.groupBy("plan_id", "fold").agg(F.sum("weight").alias("load"), F.count(F.lit(1)).alias("n"), F.max("weight").alias("most"))
    out = each.groupBy("plan_id").agg(F.sum("n").alias("n_subjects"), F.sum("load").alias("weight"), F.max("load").alias("_high"), F.min("load").alias("_low"), F.max("most").alias("_most"), F.count(F.lit(1)).alias("_folds"))
    return out.select("plan_id", "n_subjects", "weight", ((F.col("_folds") < 5) | (F.col("_high") - F.col("_low") <= F.col("_most"))).alias("balanced"))


def undersample_exact(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d).where("label IS NOT NULL AND subject IS NOT NULL")
    return sampling.undersample(rows, ["subject"], "label", ["filename", "start_ms"], per_positive=2).select("subject", "filename", "start_ms", "label")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d).where("label IS NOT NULL")
    return sampling.stratified(rows, "label", ["filename", "start_ms"], 1000).select("filename", "start_ms", "label")


def minmax_scale(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d)
    scaled = sampling.minmax(rows.where("label = 1"), rows, FEATURES)
    return scaled.select("filename", "start_ms", *[F.round(c, 5).alias(c) for c in FEATURES])


def impute_median(spark: SparkSession, d: str) -> DataFrame:
    filled = sampling.impute_median(_features(spark, d), FEATURES)
    return filled.select("filename", "start_ms", *[(F.round(c, 5) + 0.0).alias(c) for c in FEATURES])


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return sampling.class_weights(_features(spark, d).where("subject IS NOT NULL"), ["subject"], "label").withColumn("weight", F.round("weight", 6))


def chi2_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The best features of each channel by the chi-square statistic of their scaled sums."""
    rows = _features(spark, d).where("label IS NOT NULL")
    scores = sampling.chi2_scores(sampling.minmax(rows, rows, FEATURES), "label", FEATURES)
    named = scores.withColumn("channel", F.split("feature", "__")[0])
    return sampling.top_k(named, ["channel"], "chi2", "feature", 30).select("channel", "feature", F.round("chi2", 6).alias("chi2"), "rank")


def parity_report(spark: SparkSession, d: str) -> DataFrame:
    """Worst relative difference of each feature between first and last extraction, and where one is missing."""
    rows = table(spark, d, "windows").select(normal("filename").alias("filename"), millis("window_start_sec").alias("start_ms"), "extracted_at", *[finite(c).alias(c) for c in FEATURES]).dropna(subset=["filename", "start_ms"])
    long = rows.unpivot(["filename", "start_ms", "extracted_at"], FEATURES, "feature", "x")
    ends = long.groupBy("filename", "start_ms", "feature").agg(F.min(F.struct("extracted_at", "x"))["x"].alias("a"), F.max(F.struct("extracted_at", "x"))["x"].alias("b"))
    error = ratio(F.abs(F.col("b") - F.col("a")), F.greatest(F.lit(1.0), F.abs("a")))
    return ends.groupBy("feature").agg(F.round(F.max(error), 5).alias("worst"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("n_disagree"), F.count(F.lit(1)).alias("n"))


def carry_forward_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line scan with state: each hunk line belongs to the last file line before it in its text."""
    from quillwave.sources.lines import carried

    lines = carried(table(spark, d, "documents"), "doc_id", "text", r"^diff --git a/(\S+) ", r"^@@ -(\d+)")
    return lines.groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("n_hunks"), F.min(F.col("mark").cast("long")).alias("first_line"))


def interval_pairing(spark: SparkSession, d: str) -> DataFrame:
    """Line scan with pairs: an old-file line and the new-file line that follows it; unmatched ones are dropped."""
    from quillwave.sources.lines import paired

    return paired(table(spark, d, "documents"), "doc_id", "text", r"^--- a/(\S+)$", r"^\+\+\+ b/(\S+)$").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("first") == F.col("second")).alias("n_same"))


QUERIES = {
    q.__name__: q for q in (
        tier_admission, tier_rollup, none_of, channel_alias, presence_share, complete_subjects, dominant_rate, channel_lists, duration_summary, n_smallest, dataset_rollup, missing_cells, complete_rows, provenance,
        fold_roles, ring_tuning_pool, balanced_fold_plan, group_kfold, fold_loads, undersample_exact, stratified_sample, minmax_scale, impute_median, class_weights, chi2_top_k, parity_report, carry_forward_lines, interval_pairing,
    )
}

_HAS = "has_fp1_f7 has_f7_t7 has_t7_p7 has_p7_o1 has_fp1_f3 has_f3_c3 has_c3_p3 has_p3_o1 has_fp2_f4 has_f4_c4 has_c4_p4 has_p4_o2 has_fp2_f8 has_f8_t8 has_t8_p8 has_p8_o2 has_fz_cz has_cz_pz has_t7_ft9 has_ft9_ft10 has_ft10_t8".split()
_AUDIT = """
audit AS (
  SELECT * REPLACE (lower(trim(subject)) AS subject, lower(trim(filename)) AS filename, CASE WHEN isfinite(duration_sec) THEN duration_sec END AS duration_sec),
    list_distinct(list_filter(list_transform(string_split(coalesce(channel_names, ''), ';'), lambda c: upper(trim(c))), lambda c: c <> '')) AS channels
  FROM recordings WHERE trim(subject) <> '' AND trim(filename) <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(subject)), lower(trim(filename)) ORDER BY recorded_at DESC NULLS LAST, CASE WHEN isfinite(duration_sec) THEN duration_sec END DESC NULLS LAST,
    channel_names DESC NULLS LAST, n_seizures DESC NULLS LAST, sampling_rate DESC NULLS LAST) = 1)"""
_ALL = " AND ".join(f"coalesce({c}, false)" for c in _HAS)
_ANY = " OR ".join(f"coalesce({c}, false)" for c in _HAS)
_REQ = "['" + "', '".join(REQUIRED) + "']"
_F = ", ".join(f"CASE WHEN isfinite({c}) THEN CAST({c} AS DOUBLE) END AS {c}" for c in FEATURES)
_FEATURES = f"""
features AS (
  SELECT filename, start_ms, label, subject, {", ".join(FEATURES)} FROM (
    SELECT nullif(lower(trim(subject_id)), '') AS subject, lower(trim(filename)) AS filename, CAST(round(window_start_sec * 1000) AS BIGINT) AS start_ms, CAST(label AS INTEGER) AS label, extracted_at, {_F}
    FROM windows WHERE trim(filename) <> '' AND window_start_sec IS NOT NULL AND isfinite(window_start_sec))
  QUALIFY row_number() OVER (PARTITION BY filename, start_ms ORDER BY extracted_at DESC NULLS LAST, label DESC NULLS LAST, subject DESC NULLS LAST, {", ".join(f"{c} DESC NULLS LAST" for c in FEATURES)}) = 1)"""
_MEMBERS = r"""
plans AS (SELECT DISTINCT plan_id, unnest(json_keys(folds)) AS name, folds FROM cv_folds),
entries AS (SELECT plan_id, CAST(regexp_extract(trim(name), '([0-9]+)$', 1) AS INTEGER) AS fold, unnest(CAST(json_extract(folds, '$."' || name || '"') AS VARCHAR[])) AS entry FROM plans),
members AS (SELECT DISTINCT plan_id, fold, lower(trim(s)) AS subject FROM (SELECT plan_id, fold, unnest(string_split(entry, '+')) AS s FROM entries) WHERE trim(s) <> '')"""
_LOT = "md5(concat_ws('|', filename, CAST(start_ms AS VARCHAR), '42'))"
_TEXT_LINES = r"lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents WHERE text IS NOT NULL))"


def _each(template: str) -> str:
    return ", ".join(template.replace("$", c) for c in FEATURES)


SQL = {
    "tier_admission": f"""WITH {_AUDIT} SELECT filename, CASE subject WHEN 'pt000042' THEN 'pt000042-all' ELSE subject END AS subject, ({_ALL}) AND NOT coalesce(is_monopolar, false) AS tier_a,
  ({" AND ".join(f"coalesce({c}, false)" for c in TIER_B)}) AND NOT coalesce(is_monopolar, false) AS tier_b FROM audit""",
    "tier_rollup": f"""WITH {_AUDIT}, t AS (SELECT *, CASE WHEN ({_ALL}) AND NOT coalesce(is_monopolar, false) THEN 'a' ELSE 'other' END AS tier FROM audit)
SELECT tier, subject, count(*) AS n_files, round(sum(duration_sec) / 3600, 6) AS hours, CAST(sum(n_seizures) AS BIGINT) AS n_seizures FROM t GROUP BY ROLLUP (tier, subject)""",
    "none_of": f"WITH {_AUDIT} SELECT subject, filename, NOT list_has_any(channels, {_REQ}) AS lacks_all, list_has_all(channels, {_REQ}) AS covers, is_monopolar FROM audit",
    "channel_alias": f"""WITH {_AUDIT} SELECT subject, filename, CASE WHEN list_contains(channels, 'T8-P8') THEN 'T8-P8' WHEN list_contains(channels, 'T8-P8-0') THEN 'T8-P8-0' END AS t8_p8,
  CAST(len(list_distinct(flatten(list_transform(channels, lambda c: string_split(c, '-'))))) AS INTEGER) AS n_electrodes FROM audit""",
    "presence_share": f"""WITH {_AUDIT}, long AS (SELECT subject, duration_sec, unnest([{", ".join(f"{{'c': '{c}', 'v': coalesce({c}, false)}}" for c in _HAS)}]) AS f FROM audit)
SELECT f.c AS channel, count(*) FILTER (f.v) AS n_files, count(DISTINCT subject) FILTER (f.v) AS n_subjects, round(100 * (sum(CASE WHEN f.v THEN duration_sec ELSE 0 END) / nullif(sum(duration_sec), 0)), 6) AS share_pct FROM long GROUP BY f.c""",
    "complete_subjects": f"WITH {_AUDIT} SELECT subject, bool_and({_ALL}) AS complete, bool_or(NOT ({_ANY})) AS some_empty, count(*) AS n_files FROM audit GROUP BY subject",
    "dominant_rate": f"""WITH {_AUDIT}, c AS (SELECT subject, round(sampling_rate, 3) AS rate, count(*) AS n, min(filename) AS f FROM audit WHERE isfinite(sampling_rate) GROUP BY ALL)
SELECT subject, rate, n FROM c QUALIFY row_number() OVER (PARTITION BY subject ORDER BY n DESC, f, rate) = 1""",
    "channel_lists": f"""WITH {_AUDIT}, f AS (SELECT DISTINCT subject, c FROM (SELECT subject, unnest(channels) AS c FROM audit) WHERE NOT list_contains({_REQ}, c))
SELECT subject, string_agg(c, ';' ORDER BY c) AS foreign_channels FROM f GROUP BY subject""",
    "duration_summary": f"""WITH {_AUDIT} SELECT is_monopolar, min(duration_sec) AS shortest, round(median(duration_sec), 6) AS middle, max(duration_sec) AS longest, round(quantile_cont(duration_sec, 0.95), 6) AS p95, count(*) AS n,
  CAST(floor(min(duration_sec)) AS BIGINT) AS shortest_sec, CAST(floor(round(median(duration_sec), 6)) AS BIGINT) AS middle_sec, CAST(floor(max(duration_sec)) AS BIGINT) AS longest_sec FROM audit GROUP BY is_monopolar""",
    "n_smallest": f"WITH {inputs.INTERVALS} SELECT filename, idx, end_ms - start_ms AS length_ms FROM intervals ORDER BY length_ms, filename, idx LIMIT 10",
    "dataset_rollup": """WITH w AS (SELECT lower(trim(subject_id)) AS subject, on_uniform_grid, label, nullif(lower(trim(filename)), '') AS filename FROM windows WHERE trim(subject_id) <> '')
SELECT subject, count(*) AS n_windows, count(*) FILTER (coalesce(on_uniform_grid, false)) AS n_grid, count(*) FILTER (coalesce(label = 1, false)) AS n_positive, count(DISTINCT filename) AS n_files FROM w GROUP BY ROLLUP (subject)""",
    "missing_cells": f"WITH {_FEATURES}, long AS (SELECT filename, unnest([{_each("{'c': '$', 'x': $ IS NULL}")}]) AS f FROM features) SELECT filename, f.c AS column, count(*) AS n_missing FROM long WHERE f.x GROUP BY ALL",
    "complete_rows": f"WITH {_FEATURES} SELECT subject, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)}) AS n_kept, count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in FEATURES)}) AS n_dropped FROM features GROUP BY subject",
    "fold_roles": f"""WITH {_MEMBERS}, n AS (SELECT *, dense_rank() OVER (PARTITION BY plan_id ORDER BY fold) - 1 AS i FROM members), l AS (SELECT plan_id, max(i) AS last FROM n GROUP BY plan_id),
t AS (SELECT plan_id, last, unnest(range(0, last + 1)) AS test_fold FROM l)
SELECT DISTINCT n.plan_id, CAST(t.test_fold AS INTEGER) AS test_fold, n.subject, CASE WHEN n.i = t.test_fold THEN 'test' WHEN n.i = (t.test_fold + 1) % (t.last + 1) THEN 'tuning' ELSE 'fit' END AS role FROM n JOIN t USING (plan_id)""",
    "ring_tuning_pool": f"""WITH {_MEMBERS}, s AS (SELECT DISTINCT plan_id, subject FROM members), p AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY subject) - 1 AS i, count(*) OVER (PARTITION BY plan_id) AS n FROM s)
SELECT a.plan_id, a.subject AS held_out, b.subject AS tuning FROM p a JOIN p b ON a.plan_id = b.plan_id JOIN (SELECT unnest([1, 2, 3]) AS k) k ON k < a.n AND b.i = (a.i + k) % a.n""",
    "fold_loads": f"""WITH {_AUDIT},{_MEMBERS}, w AS (SELECT subject, sum(coalesce(n_seizures, 0)) AS weight FROM audit GROUP BY subject)
SELECT plan_id, count(*) AS n_subjects, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS weight, true AS balanced FROM (SELECT DISTINCT plan_id, subject FROM members) LEFT JOIN w USING (subject) GROUP BY plan_id""",
    "provenance": " UNION ALL ".join(
        f"""SELECT '{t}' AS name, '{{"rows":' || (SELECT count(*) FROM {t}) || ',"columns":"' || (SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE {t})) || '"}}' AS document"""
        for t in ("recordings", "windows", "predictions", "runs")
    ),
    "undersample_exact": f"""WITH {_FEATURES}, r AS (SELECT *, count(*) FILTER (label = 1) OVER (PARTITION BY subject) AS p, row_number() OVER (PARTITION BY subject, label ORDER BY {_LOT}, filename, start_ms) AS i
  FROM features WHERE label IS NOT NULL AND subject IS NOT NULL) SELECT subject, filename, start_ms, label FROM r WHERE label = 1 OR (label = 0 AND i <= 2 * p)""",
    "stratified_sample": f"""WITH {_FEATURES} SELECT filename, start_ms, label FROM features WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_LOT}, filename, start_ms) <= 1000""",
    "minmax_scale": f"""WITH {_FEATURES}, e AS (SELECT {_each("min($) AS lo_$, max($) AS hi_$")} FROM features WHERE label = 1)
SELECT filename, start_ms, {_each("round(coalesce(($ - lo_$) / nullif(hi_$ - lo_$, 0), CASE WHEN $ IS NOT NULL THEN 0 END), 5) AS $")} FROM features CROSS JOIN e""",
    "impute_median": f"WITH {_FEATURES}, m AS (SELECT {_each('median($) AS m_$')} FROM features) SELECT filename, start_ms, {_each('round(coalesce($, m_$), 5) + 0.0 AS $')} FROM features CROSS JOIN m",
    "class_weights": f"""WITH {_FEATURES}, c AS (SELECT subject, label, count(*) AS n FROM features WHERE subject IS NOT NULL AND label IS NOT NULL GROUP BY ALL)
SELECT subject, label, n, round(sum(n) OVER (PARTITION BY subject) / (count(*) OVER (PARTITION BY subject) * n), 6) AS weight FROM c""",
    "chi2_top_k": f"""WITH {_FEATURES}, f AS (SELECT * FROM features WHERE label IS NOT NULL), e AS (SELECT {_each("min($) AS lo_$, max($) AS hi_$")} FROM f),
long AS (SELECT label, unnest([{_each("{'c': '$', 'x': ($ - lo_$) / nullif(hi_$ - lo_$, 0)}")}]) AS v FROM f CROSS JOIN e),
o AS (SELECT v.c AS feature, label, sum(v.x) AS o, count(*) AS n FROM long WHERE v.x IS NOT NULL GROUP BY ALL),
x AS (SELECT feature, o, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM o),
s AS (SELECT feature, sum((o - e) ** 2 / nullif(e, 0)) AS chi2 FROM x GROUP BY feature)
SELECT split_part(feature, '__', 1) AS channel, feature, round(chi2, 6) AS chi2, CAST(row_number() OVER (PARTITION BY split_part(feature, '__', 1) ORDER BY chi2 DESC NULLS LAST, feature) AS INTEGER) AS rank FROM s""",
    "parity_report": f"""WITH r AS (SELECT lower(trim(filename)) AS filename, CAST(round(window_start_sec * 1000) AS BIGINT) AS start_ms, extracted_at, {_F} FROM windows WHERE trim(filename) <> '' AND window_start_sec IS NOT NULL AND isfinite(window_start_sec)),
long AS (SELECT filename, start_ms, extracted_at, unnest([{_each("{'c': '$', 'x': $}")}]) AS v FROM r),
o AS (SELECT filename, start_ms, v.c AS feature, v.x AS x, row_number() OVER (PARTITION BY filename, start_ms, v.c ORDER BY extracted_at NULLS FIRST, v.x NULLS FIRST) AS i, count(*) OVER (PARTITION BY filename, start_ms, v.c) AS n FROM long),
e AS (SELECT filename, start_ms, feature, max(x) FILTER (i = 1) AS a, max(x) FILTER (i = n) AS b FROM o GROUP BY ALL)
SELECT feature, round(max(abs(b - a) / greatest(1.0, abs(a))), 5) AS worst, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS n_disagree, count(*) AS n FROM e GROUP BY feature""",
    "carry_forward_lines": rf"""WITH {_TEXT_LINES}, s AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^diff --git a/(\S+) ') THEN regexp_extract(line, '^diff --git a/(\S+) ', 1) END AS f,
    CASE WHEN regexp_matches(line, '^@@ -([0-9]+)') THEN regexp_extract(line, '^@@ -([0-9]+)', 1) END AS m FROM lines),
c AS (SELECT doc_id, m, last_value(f IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS state FROM s)
SELECT doc_id, state, count(*) AS n_hunks, min(CAST(m AS BIGINT)) AS first_line FROM c WHERE m IS NOT NULL AND state IS NOT NULL GROUP BY doc_id, state""",
    "interval_pairing": rf"""WITH {_TEXT_LINES}, s AS (SELECT doc_id, i, nullif(regexp_extract(line, '^--- a/(\S+)$', 1), '') AS a, nullif(regexp_extract(line, '^\+\+\+ b/(\S+)$', 1), '') AS b FROM lines),
k AS (SELECT doc_id, a, lead(b) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s WHERE a IS NOT NULL OR b IS NOT NULL)
SELECT doc_id, count(*) AS n_pairs, count(*) FILTER (a = b) AS n_same FROM k WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY doc_id""",
}
