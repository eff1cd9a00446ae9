"""Splits that keep related records together: grouped iterative stratification.

1. Related subjects are joined into components.
2. Each component's recordings are aggregated into a vector of label counts.
3. Components are placed whole: the label with the fewest outstanding records
   comes first; its components, largest first, each go to the split that lacks most of that
   label (ties: most records, then the earlier split) among those with room for
   at least half of the component's records.

Step 3 looks at one label after the other, and at the components of a label in
three parts of which none is too large for a task, at every size alike: the
largest are placed one by one; the bulk is dealt into lots side by side, each
aiming at its part of what every split then lacks; the smallest are placed one
by one at the end and settle what the lots have left uneven.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwave.llm.components import components
from quillwave.operators.records import latest
from quillwave.semantics import finite, fold_id, normal
from quillwave.session import materialise

#: The most components of one label that a task places, and the most splits.
BLOCK_COMPONENTS, MOST_SPLITS = 20_000, 1000

#: Labels of a recording that the splits should share out evenly; the last counts the recordings.
LABELS = {
    "seizures": "n_seizures > 0",
    "monopolar": "is_monopolar",
    "no_signal": "duration_sec <= 0",
    "long": "duration_sec > 300",
    "records": "true",
}


def relations(recordings: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (u, v) between subjects that are directly related.

    A pair is related if its latest link, in either direction, is confirmed
    (links equal in time: the greater link_id counts), or if recordings of both
    with a duration above 0 have the same content hash of 32 hex digits.
    Subjects of equal hashes are joined in a star, not in all pairs.  Links of a
    subject with itself or with NULL ends relate nothing.
    """
    a, b = normal("subject_id"), normal("related_id")
    pairs = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), "noted_at", "link_id", normal("status").alias("status")).where(a.isNotNull() & b.isNotNull() & (a != b))
    confirmed = latest(pairs, ["u", "v"], ["noted_at", "link_id"], ["status"]).where("status = 'confirmed'").select("u", "v")
    md5 = normal("content_md5")
    hashed = recordings.where((finite("duration_sec") > 0) & md5.rlike("^[0-9a-f]{32}$")).select(normal("subject").alias("v"), md5.alias("md5")).where("v IS NOT NULL").distinct()
    least = hashed.groupBy("md5").agg(F.min("v").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return confirmed.unionByName(hashed.join(least, "md5").where("u <> v").select("u", "v"))


def related_subjects(recordings: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) of the subjects that are related to another."""
    return components(relations(recordings, links))


def label_vectors(recordings: DataFrame, related: DataFrame) -> DataFrame:
    """(component, count of each label): recordings count once, NULL labels as absent."""
    rows = recordings.select(normal("subject").alias("subject"), normal("filename").alias("filename"), "n_seizures", "is_monopolar", finite("duration_sec").alias("duration_sec"))
    flags = rows.dropna(subset=["subject"]).groupBy("subject", "filename").agg(*[F.max(F.coalesce(F.expr(c), F.lit(False)).cast("int")).alias(k) for k, c in LABELS.items()])
    named = flags.join(related.withColumnRenamed("node", "subject"), "subject", "left").withColumn("component", F.coalesce("component", "subject"))
    return named.groupBy("component").agg(*[F.sum(k).cast("long").alias(k) for k in LABELS])


def deal(vectors: np.ndarray, names: list[str], need: np.ndarray, label: int) -> np.ndarray:
    """The split of each component (rows of label counts), largest in ``label`` first; ``need`` (splits, labels) is what the splits lack and is lowered."""
    records = vectors.shape[1] - 1
    split = np.zeros(len(vectors), int)
    tie = np.argsort(np.argsort(np.asarray(names, dtype=object))) if len(names) else np.zeros(0, int)
    lacks = need.tolist()
    for c in np.lexsort((tie, -vectors[:, records], -vectors[:, label])).tolist():
        v = vectors[c].tolist()
        room = [i for i, n in enumerate(lacks) if n[records] >= v[records] / 2] or range(len(lacks))
        s = max(room, key=lambda i: (lacks[i][label], lacks[i][records], -i))
        split[c] = s
        lacks[s] = [n - x for n, x in zip(lacks[s], v, strict=True)]
    need[:] = lacks
    return split


def place(vectors: np.ndarray, names: list[str], shares: np.ndarray) -> np.ndarray:
    """The split of each component by iterative stratification, all in one go: what ``assign`` does where no label has many components."""
    need = np.outer(shares, vectors.sum(axis=0)).astype(float)
    split = np.full(len(vectors), int(np.argmax(shares)) if len(shares) else 0)
    waiting, todo = np.ones(len(vectors), bool), set(range(vectors.shape[1]))
    while (label := _rarest(need.sum(0), todo)) is not None:
        todo.remove(label)
        members = np.flatnonzero(waiting & (vectors[:, label] > 0))
        split[members] = deal(vectors[members], [names[i] for i in members], need, label)
        waiting[members] = False
    return split


def _rarest(outstanding: np.ndarray, todo: set[int]) -> int | None:
    """The label of ``todo`` with the fewest outstanding records, if any has some."""
    return min((i for i in todo if round(outstanding[i]) > 0), key=lambda i: (round(outstanding[i]), i), default=None)


def _after(df: DataFrame, label: str, bound) -> DataFrame:
    """``df`` with _d: whether a row stands behind ``bound`` in the order of dealing."""
    v, r, c = F.col(label), F.col("records"), F.col("component")
    return v.isNull() if bound is None else (v < bound[0]) | ((v == bound[0]) & ((r < bound[1]) | ((r == bound[1]) & (c > bound[2]))))


def _bound(df: DataFrame, label: str, count: int, last: bool):
    """The last of the ``count`` first (or the one before the ``count`` last) components in the order of dealing."""
    v, r, c = F.col(label), F.col("records"), F.col("component")
    order = [v.asc(), r.asc(), c.desc()] if last else [v.desc(), r.desc(), c.asc()]
    # the row alone comes to the driver, found by a top-n of each task
    row = df.orderBy(*order).limit(count + last).select(label, "records", "component").orderBy(*([v.desc(), r.desc(), c.asc()] if last else [v.asc(), r.asc(), c.desc()])).first()
    return None if row is None else tuple(row)


def assign(vectors: DataFrame, shares: DataFrame, block_components: int = BLOCK_COMPONENTS) -> DataFrame:
    """(component, split): every component placed whole.

    ``shares`` is the fixed small table of splits; more than ``MOST_SPLITS``
    are an error.  Components without any label go to the largest split.  An
    empty table gives an empty result.
    """
    rows = sorted(shares.select(normal("split"), "share_permille").dropna().limit(MOST_SPLITS + 1).collect(), key=lambda r: (-r[1], r[0]))
    if len(rows) > MOST_SPLITS or not rows:
        raise ValueError(f"{len(rows)} splits")
    splits, weights = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    weights = weights / weights.sum()
    names = list(LABELS)
    vectors, totals = materialise(vectors, "vectors", **{k: F.coalesce(F.sum(k), F.lit(0)) for k in names})
    need = np.outer(weights, [totals[k] for k in names])
    none = [F.col(k) == 0 for k in names]
    found = [vectors.where(reduce(lambda a, b: a & b, none)).select("component", F.lit(splits[0]).alias("split"))]

    def fill(part: DataFrame, label: str, lots: int, whole: bool) -> None:
        """Place the components of ``part``, as one group against all that is lacking, or in lots against their part of it."""
        lacking, at = need.copy(), names.index(label)
        ratio = np.maximum(lacking, 0)
        ratio = ratio / np.where(ratio.sum(0) > 0, ratio.sum(0), 1)

        def run(lot: pd.DataFrame) -> pd.DataFrame:
            counts = lot[names].to_numpy()
            mine = lacking.copy() if whole else ratio * counts.sum(0)
            to = deal(counts, lot["component"].tolist(), mine, at)
            return lot[["component", *names]].assign(split=[splits[i] for i in to])

        placed = part.withColumn("_lot", F.pmod(F.xxhash64("component"), F.lit(lots))).groupBy("_lot").applyInPandas(run, f"component string, {', '.join(f'{k} long' for k in names)}, split string")
        sums = {f"s{i}_{k}": F.coalesce(F.sum(F.when(F.col("split") == s, F.col(k))), F.lit(0)) for i, s in enumerate(splits) for k in names}
        placed, used = materialise(placed, "placed", **sums)
        need[:] -= np.array([[used[f"s{i}_{k}"] for k in names] for i in range(len(splits))], float)
        found.append(placed.select("component", "split"))

    todo, unplaced = set(range(len(names))), F.lit(True)
    while (i := _rarest(need.sum(0), todo)) is not None:
        todo.remove(i)
        label, mine = names[i], vectors.where(unplaced & (F.col(names[i]) > 0))
        unplaced = unplaced & (F.col(label) == 0)
        # the largest, the bulk in lots, the smallest
        first = _bound(mine, label, block_components, False)
        fill(mine.where(~_after(mine, label, first)), label, 1, True)
        rest = mine.where(_after(mine, label, first))
        left = rest.count()
        if left > block_components:
            border = _bound(rest, label, block_components, True)
            fill(rest.where(~_after(rest, label, border)), label, -(-(left - block_components) // block_components), False)
            rest = rest.where(_after(rest, label, border))
        if left:
            fill(rest, label, 1, True)
    return reduce(DataFrame.unionByName, found)


def grouped_splits(recordings: DataFrame, links: DataFrame, shares: DataFrame) -> DataFrame:
    """(subject_id, filename, component, split) of every recording, once.

    Recordings of a subject and of all subjects related to it are in one split.
    Recordings with a NULL subject can't be kept with their like and go; one
    with a NULL filename is a recording.  Other columns don't come out.
    """
    related = materialise(related_subjects(recordings, links), "related")
    placed = assign(label_vectors(recordings, related), shares)
    rows = recordings.select(normal("subject").alias("subject_id"), normal("filename").alias("filename")).dropna(subset=["subject_id"]).distinct()
    named = rows.join(related.withColumnRenamed("node", "subject_id"), "subject_id", "left").withColumn("component", F.coalesce("component", "subject_id"))
    return named.join(placed, "component").select("subject_id", "filename", "component", "split")


def listed_folds(plans: DataFrame) -> DataFrame:
    """(plan_id, subject, fold): the subjects that each fold plan lists, once.

    ``folds`` is JSON: fold to list of entries, an entry several subjects joined
    by ``+``.  Text that isn't such JSON lists nothing.
    """
    lists = F.from_json("folds", "map<string, array<string>>")
    one = plans.select("plan_id", "scheme", F.explode(lists).alias("name", "entries"))
    named = one.select("plan_id", fold_id("scheme", "name").alias("fold"), F.explode("entries").alias("entry"))
    subjects = named.select("plan_id", "fold", F.explode(F.split("entry", r"\+")).alias("subject"))
    return subjects.select("plan_id", normal("subject").alias("subject"), "fold").dropna().distinct()


def _listed(plans: DataFrame, related: DataFrame) -> DataFrame:
    """(plan_id, component, subject, folds) of the listed subjects."""
    listed = listed_folds(plans).join(related.withColumnRenamed("node", "subject"), "subject", "left").withColumn("component", F.coalesce("component", "subject"))
    return listed.groupBy("plan_id", "component", "subject").agg(F.sort_array(F.collect_set("fold")).alias("folds"))


def torn(plans: DataFrame, related: DataFrame) -> DataFrame:
    """(plan_id, component, n_subjects, n_folds): components that a plan puts into more than one fold, one row each."""
    listed = listed_folds(plans).join(related.withColumnRenamed("node", "subject"), "subject", "left").withColumn("component", F.coalesce("component", "subject"))
    return listed.groupBy("plan_id", "component").agg(F.count_distinct("subject").alias("n_subjects"), F.count_distinct("fold").alias("n_folds")).where("n_folds > 1")


def parted(plans: DataFrame, related: DataFrame) -> DataFrame:
    """(plan_id, subject_a, subject_b): related subjects of a plan whose folds, together, are more than one.

    A subject in several folds is a pair with itself.  Only components that a
    plan really parts are expanded into pairs; ``torn`` has them as classes.
    """
    each = _listed(plans, related)
    # the range of the folds is a plain aggregate, so a large component is no task
    ends = each.groupBy("plan_id", "component").agg(F.min(F.array_min("folds")).alias("_lo"), F.max(F.array_max("folds")).alias("_hi")).where("_lo <> _hi").drop("_lo", "_hi")
    apart = each.join(ends, ["plan_id", "component"])
    a, b = apart.alias("a"), apart.alias("b")
    on = (F.col("a.plan_id") == F.col("b.plan_id")) & (F.col("a.component") == F.col("b.component")) & (F.col("a.subject") <= F.col("b.subject"))
    pair = F.size(F.array_union("a.folds", "b.folds")) > 1
    return a.join(b, on).where(pair).select(F.col("a.plan_id").alias("plan_id"), F.col("a.subject").alias("subject_a"), F.col("b.subject").alias("subject_b"))
