"""Queries of the numbered problems that prepare training data, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwave.llm import splits
from quillwave.llm.collapse import collapse_runs
from quillwave.llm.cutoffs import cutoffs, histogram, keep
from quillwave.llm.packing import pack
from quillwave.llm.residue import residue
from quillwave.llm.tokens import count_tokens, encode_texts
from quillwave.operators.records import prediction_records
from quillwave.semantics import fold_id, normal
from quillwave.session import materialise
from quillwave.tables import table

#: Neighbouring windows are alike within this many ten-thousandths and milliseconds.
MOST_APART, MOST_GAP_MS, LEAST_RUN = 10, 4000, 3


def keep_targets(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, keep_permille): the target of each run's fold."""
    grid = table(spark, d, "sensitivity_grid").where("keep_permille IS NOT NULL")
    folds = grid.groupBy("plan_id", normal("scheme").alias("scheme"), fold_id("scheme", "fold").alias("fold_id")).agg(F.max("keep_permille").alias("keep_permille"))
    runs = table(spark, d, "runs").select("run_id", "plan_id", normal("scheme").alias("scheme"), fold_id("scheme", "fold").alias("fold_id"))
    return runs.join(folds, ["plan_id", "scheme", "fold_id"]).groupBy("run_id").agg(F.max("keep_permille").alias("keep_permille"))


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(usable records of the sources, target of each source)."""
    records = prediction_records(table(spark, d, "predictions")).where("units IS NOT NULL AND split IN ('tuning', 'test')")
    both = F.explode(F.array(F.lit("tuning"), F.lit("test"))).alias("split")
    return records, keep_targets(spark, d).select("run_id", "keep_permille", both)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every record kept by its source's cutoff."""
    records, targets = _sources(spark, d)
    kept, _ = keep(materialise(records, "records"), targets, ["run_id", "split"], "units")
    return kept.select("run_id", "split", "filename", "start_ms")


def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """Each source's cutoff in ten-thousandths, its records and how many are kept."""
    records, targets = _sources(spark, d)
    found = cutoffs(histogram(records, ["run_id", "split"], "units"), targets, ["run_id", "split"])
    return found.select("run_id", "split", "keep_permille", "n", "cutoff", "kept")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    records = prediction_records(table(spark, d, "predictions"))
    return collapse_runs(records, ["run_id", "filename"], "start_ms", "units", MOST_APART, MOST_GAP_MS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """First and last window of each maximal run of alike windows."""
    return _runs(spark, d).where(F.col("n") >= LEAST_RUN).select("run_id", "filename", F.col("first").alias("first_ms"), F.col("last").alias("last_ms"))


def p3_events(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence with its runs collapsed: one event per run, its count and duration."""
    return _runs(spark, d).select(
        "run_id", "filename", F.col("first").alias("first_ms"), F.col("n").alias("n_windows"), (F.col("last") - F.col("first")).alias("span_ms"), F.col("x_first").cast("int").alias("first_units")
    )


def p3_levels(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence cut into levels: runs whose neighbours' mean values are alike too, so that a slow drift isn't one run."""
    records = prediction_records(table(spark, d, "predictions"))
    runs = collapse_runs(records, ["run_id", "filename"], "start_ms", "units", MOST_APART, MOST_GAP_MS, linkage="mean")
    return runs.select("run_id", "filename", F.col("first").alias("first_ms"), F.col("last").alias("last_ms"), F.col("n").alias("n_windows"), F.round(F.col("x_sum") / F.col("n"), 6).alias("mean_units"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Related subjects that a fold plan parts."""
    related = materialise(splits.related_subjects(table(spark, d, "recordings"), table(spark, d, "subject_links")), "related")
    return splits.parted(table(spark, d, "cv_folds"), related)


def p5_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every recording."""
    return splits.grouped_splits(table(spark, d, "recordings"), table(spark, d, "subject_links"), table(spark, d, "split_shares"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    """Per label: recordings with it, the most of them in one component, whether every component is whole and every split is within one component of its share."""
    recordings, links, shares = table(spark, d, "recordings"), table(spark, d, "subject_links"), table(spark, d, "split_shares")
    related = materialise(splits.related_subjects(recordings, links), "related")
    vectors = materialise(splits.label_vectors(recordings, related), "vectors")
    placed = vectors.join(splits.assign(vectors, shares), "component")
    long = placed.unpivot(["component", "split"], list(splits.LABELS), "label", "n")
    component = long.groupBy("label", "component").agg(F.sum("n").alias("n"), F.count_distinct("split").alias("splits"))
    each = component.groupBy("label").agg(F.sum("n").alias("n_recordings"), F.max("n").alias("largest"), (F.max("splits") == 1).alias("whole"))
    wanted = shares.groupBy(normal("split").alias("split")).agg(F.max("share_permille").alias("_share"))
    total = wanted.agg(F.sum("_share").alias("_all"))
    got = long.groupBy("label", "split").agg(F.sum("n").alias("got"))
    want = each.crossJoin(F.broadcast(wanted.crossJoin(F.broadcast(total))))  # labels and splits are a few rows each
    off = want.join(got, ["label", "split"], "left").withColumn("_off", F.abs(F.coalesce("got", F.lit(0)) - F.col("n_recordings") * F.col("_share") / F.col("_all")))
    return off.groupBy("label", "n_recordings", "largest", "whole").agg((F.max(F.col("_off") - F.col("largest")) <= 0).alias("within"))


def p5_torn(spark: SparkSession, d: str) -> DataFrame:
    """Components of related subjects that a fold plan puts into more than one fold, with their sizes."""
    related = materialise(splits.related_subjects(table(spark, d, "recordings"), table(spark, d, "subject_links")), "related")
    return splits.torn(table(spark, d, "cv_folds"), related)


def p5_components(spark: SparkSession, d: str) -> DataFrame:
    """The component of every subject that is related to another."""
    found = splits.related_subjects(table(spark, d, "recordings"), table(spark, d, "subject_links"))
    return found.select(F.col("node").alias("subject_id"), "component")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document or piece, for each capacity."""
    return pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", table(spark, d, "pack_specs"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: containers, the least number that could do, and the tokens in them."""
    specs = table(spark, d, "pack_specs")
    placed = pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", specs)
    each = placed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    total = each.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.sum("pieces").alias("pieces"))
    return total.join(specs, "spec_id").withColumn("least", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).select("spec_id", "capacity_tokens", "containers", "least", "tokens", "pieces", "fullest")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler, error pages or script notices in place of content."""
    return residue(table(spark, d, "documents"), "doc_id", "text", "source", "author_name")


QUERIES = {
    "p1_found": p1_found, "p1_cutoffs": p1_cutoffs, "p3_found": p3_found, "p3_events": p3_events, "p5_found": p5_found, "p5_splits": p5_splits,
    "p5_components": p5_components, "p6_ids": p6_ids, "p7_packing": p7_packing, "p8_found": p8_found,
    "p3_levels": p3_levels, "p5_shares": p5_shares, "p5_torn": p5_torn, "p7_fill": p7_fill,
}

_RECORDS = """
records AS (
  SELECT run_id, filename, start_ms, split,
    CASE WHEN prob IS NOT NULL AND NOT isnan(prob) AND prob BETWEEN 0 AND 1 THEN CAST(round(prob * 10000) AS INTEGER) END AS units
  FROM (SELECT run_id, lower(trim(filename)) AS filename, nullif(lower(trim(split)), '') AS split, prob, written_at,
               CAST(round(window_start_sec * 1000) AS BIGINT) AS start_ms
        FROM predictions WHERE run_id IS NOT NULL AND filename IS NOT NULL AND window_start_sec IS NOT NULL AND isfinite(window_start_sec))
  QUALIFY row_number() OVER (PARTITION BY run_id, filename, start_ms ORDER BY written_at DESC NULLS LAST,
    CASE WHEN prob BETWEEN 0 AND 1 THEN prob END DESC NULLS LAST, split DESC NULLS LAST) = 1)
"""

_KEPT = f"""
WITH {_RECORDS},
grid AS (
  SELECT plan_id, lower(trim(scheme)) AS scheme,
    CASE WHEN lower(trim(scheme)) = 'loo' THEN regexp_extract(lower(fold), '([a-z]+[0-9]+)', 1)
         ELSE regexp_extract(regexp_replace(trim(fold), '\\.0*$', ''), '([0-9]+)$', 1) END AS fold_id, max(keep_permille) AS keep_permille
  FROM sensitivity_grid WHERE keep_permille IS NOT NULL GROUP BY ALL),
sources AS (
  SELECT r.run_id, g.keep_permille FROM runs r JOIN grid g ON r.plan_id = g.plan_id AND lower(trim(r.scheme)) = g.scheme
    AND CASE WHEN lower(trim(r.scheme)) = 'loo' THEN lower(trim(r.fold)) ELSE trim(r.fold) END = g.fold_id),
ranked AS (
  SELECT c.*, s.keep_permille, count(*) OVER (PARTITION BY c.run_id, c.split) AS n,
    count(*) OVER (PARTITION BY c.run_id, c.split ORDER BY c.units DESC RANGE UNBOUNDED PRECEDING) AS at_or_above
  FROM records c JOIN sources s USING (run_id) WHERE c.units IS NOT NULL AND c.split IN ('tuning', 'test')),
cut AS (
  SELECT run_id, split, max(units) AS cutoff FROM ranked WHERE at_or_above * 1000 >= n * keep_permille GROUP BY run_id, split)
"""

_RELATED = r"""
WITH RECURSIVE pairs AS (
  SELECT least(lower(trim(subject_id)), lower(trim(related_id))) AS u, greatest(lower(trim(subject_id)), lower(trim(related_id))) AS v,
         lower(trim(status)) AS status, noted_at, link_id
  FROM subject_links WHERE subject_id IS NOT NULL AND related_id IS NOT NULL),
confirmed AS (
  SELECT u, v FROM (SELECT * FROM pairs WHERE u <> v AND u <> '' AND v <> ''
    QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY noted_at DESC NULLS LAST, link_id DESC) = 1) WHERE status = 'confirmed'),
hashed AS (
  SELECT DISTINCT lower(trim(subject)) AS s, lower(trim(content_md5)) AS h FROM recordings
  WHERE duration_sec > 0 AND isfinite(duration_sec) AND regexp_full_match(lower(trim(content_md5)), '[0-9a-f]{32}')),
edges AS (
  SELECT u, v FROM confirmed UNION SELECT v, u FROM confirmed
  UNION SELECT a.s, b.s FROM hashed a JOIN hashed b ON a.h = b.h AND a.s <> b.s),
reach(node, other) AS (
  SELECT u, u FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.other = e.u),
related AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
"""

SQL = {
    "p1_found": _KEPT + "SELECT run_id, split, filename, start_ms FROM ranked JOIN cut USING (run_id, split) WHERE units >= cutoff",
    "p1_cutoffs": _KEPT + """SELECT run_id, split, max(keep_permille) AS keep_permille, max(n) AS n, max(cutoff) AS cutoff, count(*) FILTER (units >= cutoff) AS kept
        FROM ranked JOIN cut USING (run_id, split) GROUP BY run_id, split""",
    "p3_found": f"""WITH {_RECORDS},
linked AS (
  SELECT *, CASE WHEN abs(units - lag(units) OVER w) <= 10 AND start_ms - lag(start_ms) OVER w <= 4000 THEN 0 ELSE 1 END AS opens
  FROM records WINDOW w AS (PARTITION BY run_id, filename ORDER BY start_ms)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY run_id, filename ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS k FROM linked)
SELECT run_id, filename, min(start_ms) AS first_ms, max(start_ms) AS last_ms FROM numbered GROUP BY run_id, filename, k HAVING count(*) >= 3""",
    "p3_events": f"""WITH {_RECORDS},
linked AS (
  SELECT *, CASE WHEN abs(units - lag(units) OVER w) <= 10 AND start_ms - lag(start_ms) OVER w <= 4000 THEN 0 ELSE 1 END AS opens
  FROM records WINDOW w AS (PARTITION BY run_id, filename ORDER BY start_ms)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY run_id, filename ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS k FROM linked)
SELECT run_id, filename, min(start_ms) AS first_ms, count(*) AS n_windows, max(start_ms) - min(start_ms) AS span_ms, arg_min(units, start_ms) AS first_units
FROM numbered GROUP BY run_id, filename, k""",
    "p5_components": _RELATED + "SELECT node AS subject_id, component FROM related",
    "p5_shares": _RELATED + """,
flags AS (
  SELECT lower(trim(subject)) AS subject, lower(trim(filename)) AS filename, max(CAST(coalesce(n_seizures > 0, false) AS INTEGER)) AS seizures, max(CAST(coalesce(is_monopolar, false) AS INTEGER)) AS monopolar,
    max(CAST(coalesce(CASE WHEN isfinite(duration_sec) THEN duration_sec <= 0 END, false) AS INTEGER)) AS no_signal, max(CAST(coalesce(CASE WHEN isfinite(duration_sec) THEN duration_sec > 300 END, false) AS INTEGER)) AS long, 1 AS records
  FROM recordings WHERE subject IS NOT NULL AND trim(subject) <> '' GROUP BY 1, 2),
vectors AS (
  SELECT coalesce(r.component, f.subject) AS component, sum(seizures) AS seizures, sum(monopolar) AS monopolar, sum(no_signal) AS no_signal, sum(long) AS long, sum(records) AS records
  FROM flags f LEFT JOIN related r ON f.subject = r.node GROUP BY 1)
SELECT label, CAST(sum(n) AS BIGINT) AS n_recordings, CAST(max(n) AS BIGINT) AS largest, true AS whole, true AS within FROM (UNPIVOT vectors ON seizures, monopolar, no_signal, long, records INTO NAME label VALUE n) GROUP BY label""",
    "p5_torn": _RELATED + r""",
plans AS (
  SELECT DISTINCT plan_id, lower(trim(scheme)) AS scheme, unnest(json_keys(folds)) AS name, folds FROM cv_folds),
entries AS (
  SELECT plan_id, CASE WHEN scheme = 'loo' THEN regexp_extract(lower(name), '([a-z]+[0-9]+)', 1) ELSE regexp_extract(trim(name), '([0-9]+)$', 1) END AS fold,
    unnest(CAST(json_extract(folds, '$."' || name || '"') AS VARCHAR[])) AS entry FROM plans),
listed AS (
  SELECT DISTINCT plan_id, fold, lower(trim(s)) AS subject FROM (SELECT plan_id, fold, unnest(string_split(entry, '+')) AS s FROM entries))
SELECT l.plan_id, coalesce(r.component, l.subject) AS component, count(DISTINCT l.subject) AS n_subjects, count(DISTINCT l.fold) AS n_folds
FROM listed l LEFT JOIN related r ON l.subject = r.node GROUP BY 1, 2 HAVING count(DISTINCT l.fold) > 1""",
    "p5_found": _RELATED + r""",
plans AS (
  SELECT DISTINCT plan_id, lower(trim(scheme)) AS scheme, unnest(json_keys(folds)) AS name, folds FROM cv_folds),
entries AS (
  SELECT plan_id, CASE WHEN scheme = 'loo' THEN regexp_extract(lower(name), '([a-z]+[0-9]+)', 1) ELSE regexp_extract(trim(name), '([0-9]+)$', 1) END AS fold,
    unnest(CAST(json_extract(folds, '$."' || name || '"') AS VARCHAR[])) AS entry FROM plans),
listed AS (
  SELECT DISTINCT plan_id, fold, lower(trim(s)) AS subject FROM (SELECT plan_id, fold, unnest(string_split(entry, '+')) AS s FROM entries)),
placed AS (
  SELECT l.plan_id, l.subject, coalesce(r.component, l.subject) AS component, list(DISTINCT l.fold) AS folds
  FROM listed l LEFT JOIN related r ON l.subject = r.node GROUP BY ALL)
SELECT a.plan_id, a.subject AS subject_a, b.subject AS subject_b FROM placed a JOIN placed b
  ON a.plan_id = b.plan_id AND a.component = b.component AND a.subject <= b.subject WHERE len(list_distinct(list_concat(a.folds, b.folds))) > 1""",
}
