"""Random forests on the counts of binned rows, grown as Spark grows them, each tree in one task.

A forest sees a row only by the bins of its features.  So rows are counted by
cell (one bin of every feature) and class; there are at most MOST_CELLS cells
however many rows.  Poisson bags of equal rows add up to a Poisson bag of their
count, and the classes in a box of cells are differences of cumulated counts,
so that a node costs the same whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from math import ceil, prod, sqrt

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Cells at most: 32 bins of four features. Forests on more features are left to Spark's learner.
MOST_CELLS = 1 << 20
#: Ranks of each class from which the edges of bins are made, and the precision of a rank.
POINTS, ACCURACY = 1024, 20_000
#: Votes are added up as whole parts of this, so their order doesn't matter.
VOTE = 1 << 40


class Forest:
    """``importances`` of the features; ``score`` adds the probability of class 1, to 9 digits, to rows with the features."""

    def __init__(self, importances: np.ndarray, score: Callable[[DataFrame, str], DataFrame]):
        self.importances, self.score = importances, score


#: (edges of the bins of each feature, codes, counts) of ``count_cells``.
Cells = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def count_cells(learner: RandomForestClassifier, fit: DataFrame, features: Sequence[str], weights: dict[float, float], found: list[Row] | None = None) -> Cells | None:
    """What forests on ``fit`` need of its rows; None for too many features. ``found`` are the ranks of its parts, if they are known."""
    if learner.getMaxBins() ** len(features) > MOST_CELLS:
        return None
    edges = bin_edges(fit, list(features), weights, learner.getMaxBins(), found)
    return (edges, *_cells(fit, list(features), edges))


def without_last(cells: Cells | None) -> Cells | None:
    """The cells of all features but the last."""
    if cells is None:
        return None
    edges, codes, counts = cells
    less, place = np.unique((codes >> 1) // (len(edges[-1]) + 1) * 2 + (codes & 1), return_inverse=True)
    total = np.zeros(len(less), np.int64)
    np.add.at(total, place, counts)
    return edges[:-1], less, total


def fit_forest(learner: RandomForestClassifier, fit: DataFrame, features: Sequence[str], weights: dict[float, float], cells: Cells | None = None) -> Forest:
    """The forest that ``learner`` describes, on ``fit`` (y of 0 or 1, features); ``weights`` are those of the classes, ``cells`` those of the rows, if they are counted."""
    features = list(features)
    cells = cells or count_cells(learner, fit, features, weights)
    if cells is None:
        return _by_spark(learner, fit, features, weights)
    edges, codes, counts = cells
    dims = [len(e) + 1 for e in edges]
    sc = fit.sparkSession.sparkContext
    trees, depth, seed, w = learner.getNumTrees(), learner.getMaxDepth(), learner.getSeed(), (weights.get(0.0, 1.0), weights.get(1.0, 1.0))
    held = sc.broadcast((codes, counts))

    def run(numbers):
        codes, counts = held.value
        places = _places(codes, dims)
        return [grow(codes, counts, dims, w, depth, (seed, t), places) for t in numbers]

    grown = sc.parallelize(range(trees), min(trees, 2 * sc.defaultParallelism)).mapPartitions(run).collect()
    held.destroy()
    total = sum(g[3] for g in grown)
    grid = paint(np.concatenate([g[0] for g in grown]), np.concatenate([g[1] for g in grown]), np.concatenate([g[2] for g in grown]), dims) / trees
    return Forest(total / (total.sum() or 1.0), _lookup(sc, grid.reshape(-1), edges, dims, features))


def _by_spark(learner: RandomForestClassifier, fit: DataFrame, features: list[str], weights: dict[float, float]) -> Forest:
    assemble = VectorAssembler(inputCols=features, outputCol="v").transform
    weight = F.when(F.col("y") == 1, F.lit(weights.get(1.0, 1.0))).otherwise(F.lit(weights.get(0.0, 1.0)))
    model = learner.fit(assemble(fit.select("y", *features, weight.alias("weight"))))

    def score(rows: DataFrame, name: str) -> DataFrame:
        return model.transform(assemble(rows)).withColumn(name, F.round(vector_to_array("probability")[1], 9)).drop("v", "rawPrediction", "probability", "prediction")

    return Forest(model.featureImportances.toArray(), score)


def ranks_of(rows: DataFrame, features: Sequence[str], parts: Sequence[str]) -> list[Row]:
    """The number of rows and the ranks r0, r1, ... of the features, in each part and class."""
    ranks = [i / POINTS for i in range(POINTS + 1)]
    return rows.groupBy(*parts, "y").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, ranks, ACCURACY).alias(f"r{i}") for i, c in enumerate(features)]).collect()


def bin_edges(fit: DataFrame, features: list[str], weights: dict[float, float], bins: int, found: list[Row] | None = None) -> list[np.ndarray]:
    """The upper ends of all bins but the last, by weighted ranks; with no more values than bins, between each two of them."""
    found = ranks_of(fit, features, []) if found is None else found
    out = []
    for i, c in enumerate(features):
        values = np.concatenate([np.asarray(r[f"r{i}"], float) for r in found])
        mass = np.concatenate([np.full(POINTS + 1, weights.get(r["y"], 1.0) * r["n"] / (POINTS + 1)) for r in found])
        distinct, place = np.unique(values, return_inverse=True)
        if len(distinct) <= bins:  # a rare value has no rank of its own
            all_values = sorted(r[0] for r in fit.select(c).distinct().limit(bins + 1).collect())
            if len(all_values) <= bins:
                out.append(_between(np.asarray(all_values, float), np.arange(len(all_values) - 1)))
                continue
        out.append(_between(distinct, _cuts(np.bincount(place, mass), bins)))
    return out


def _cuts(mass: np.ndarray, bins: int) -> np.ndarray:
    """After which values to cut, so that bins are alike in mass: at the value whose running mass is nearest to a multiple of the stride."""
    if len(mass) <= bins:
        return np.arange(len(mass) - 1)
    stride = mass.sum() / bins
    upto, target, out = np.cumsum(mass), stride, []
    for i in range(1, len(mass)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(i - 1)
            target += stride
            if len(out) == bins - 1:
                break
    return np.asarray(out, int)


def _between(values: np.ndarray, after: np.ndarray) -> np.ndarray:
    return values[after] / 2 + values[after + 1] / 2


def _code(columns: Sequence[np.ndarray], edges: list[np.ndarray], dims: list[int]) -> np.ndarray:
    """The cell of each row."""
    code = np.zeros(len(columns[0]), np.int64)
    for x, e, d in zip(columns, edges, dims, strict=True):
        code = code * d + np.searchsorted(e, np.asarray(x, float))
    return code


def _cells(fit: DataFrame, features: list[str], edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): 2 * cell + class of the cells that have rows, in order."""
    dims = [len(e) + 1 for e in edges]

    def run(batches):
        counts = np.zeros(2 * prod(dims), np.int64)
        for b in batches:
            codes, n = np.unique(2 * _code([b[c] for c in features], edges, dims) + b["y"].to_numpy().astype(np.int64), return_counts=True)
            counts[codes] += n
        there = np.flatnonzero(counts)
        for i in range(0, len(there), 100_000):
            part = there[i : i + 100_000]
            yield pd.DataFrame({"code": part, "n": counts[part]})

    found = fit.select("y", *features).mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    codes, counts = found["code"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order].astype(np.int32), counts[order]


def _lookup(sc, grid: np.ndarray, edges: list[np.ndarray], dims: list[int], features: list[str]) -> Callable[[DataFrame, str], DataFrame]:
    held = sc.broadcast(np.round(grid, 9))

    def probability(rows: pd.DataFrame) -> pd.Series:
        return pd.Series(held.value[_code([rows[c] for c in features], edges, dims)])

    return lambda rows, name: rows.withColumn(name, F.pandas_udf(probability, "double")(F.struct(*features)))


def grow(codes: np.ndarray, counts: np.ndarray, dims: list[int], weights: tuple[float, float], depth: int, seed: tuple[int, int], places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, share of class 1) of the leaves' boxes and the importances, of one tree on a bag of the counts.

    As in Spark: the best split of ceil(sqrt(k)) features drawn for each node, by
    the weighted Gini impurity; leaves of one prediction are merged.
    """
    rng = np.random.Generator(np.random.PCG64([abs(seed[0]), seed[1]]))
    k, m = len(dims), ceil(sqrt(len(dims))) if len(dims) > 1 else 1
    bag = rng.poisson(counts)
    upto, strides = _cumulated(_places(codes, dims) if places is None else places, bag, dims)
    w = np.asarray(weights)
    low, high = [np.zeros((1, k), int)], [np.asarray([dims])]
    stats, kids, cut = [_inside(upto, strides, low[0], high[0])], [], []
    for level in range(depth):
        lo, hi, own = low[-1], high[-1], stats[-1] * w[:, None]
        best, feature, at = np.zeros(len(lo)), np.full(len(lo), -1), np.zeros(len(lo), int)
        drawn = np.argsort(rng.random((len(lo), k)), axis=1)[:, :m]
        for f in range(k):
            gain = np.where((drawn == f).any(axis=1)[:, None], _gains(upto, strides, lo, hi, stats[-1], own, w, f, dims[f]), -1.0)
            t = gain.argmax(axis=1)
            g = gain[np.arange(len(lo)), t]
            better = g > best
            best[better], feature[better], at[better] = g[better], f, t[better]
        parents = np.flatnonzero(feature >= 0)
        cut.append((feature, best * own.sum(axis=0)))
        kids.append(np.full(len(lo), -1))
        kids[-1][parents] = 2 * np.arange(len(parents))  # the left one; the right one follows
        if not len(parents):
            break
        nlo, nhi = np.repeat(lo[parents], 2, axis=0), np.repeat(hi[parents], 2, axis=0)
        nhi[0::2][np.arange(len(parents)), feature[parents]] = at[parents]
        nlo[1::2][np.arange(len(parents)), feature[parents]] = at[parents]
        low.append(nlo)
        high.append(nhi)
        stats.append(_inside(upto, strides, nlo, nhi))
    while len(kids) < len(low):
        kids.append(np.full(len(low[-1]), -1))
    importance = np.zeros(k)
    share, leaf = [], []
    for s, left in zip(stats, kids, strict=True):
        weighted = s * w[:, None]
        share.append(weighted[1] / np.maximum(weighted.sum(axis=0), 1e-300))
        leaf.append(left < 0)
    for level in range(len(kids) - 2, -1, -1):  # from below: two leaves of one prediction become one
        left = kids[level]
        inner = np.flatnonzero(left >= 0)
        a, b = left[inner], left[inner] + 1
        one = leaf[level + 1][a] & leaf[level + 1][b] & ((share[level + 1][a] > 0.5) == (share[level + 1][b] > 0.5))
        leaf[level][inner[one]] = True
        leaf[level + 1][a[one]] = leaf[level + 1][b[one]] = False
        keep = inner[~one]
        np.add.at(importance, cut[level][0][keep], cut[level][1][keep])
    which = [np.flatnonzero(x) for x in leaf]
    boxes = [np.concatenate([x[i] for x, i in zip(side, which, strict=True)]).astype(np.int16) for side in (low, high)]
    return boxes[0], boxes[1], np.concatenate([x[i] for x, i in zip(share, which, strict=True)]), importance / (importance.sum() or 1.0)


def _places(codes: np.ndarray, dims: list[int]) -> np.ndarray:
    """Where the counts of cells and classes are among those of the corners."""
    return np.ravel_multi_index((codes & 1, *[i + 1 for i in np.unravel_index(codes >> 1, dims)]), (2, *[d + 1 for d in dims]))


def _cumulated(places: np.ndarray, bag: np.ndarray, dims: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of both classes in all cells below a corner, flat, and the strides of the corners."""
    upto = np.zeros((2, *[d + 1 for d in dims]), np.int32 if bag.sum() < 1 << 31 else np.int64)
    upto.reshape(-1)[places] = bag
    for axis in range(1, len(dims) + 1):
        np.cumsum(upto, axis=axis, out=upto)
    return upto.reshape(2, -1), np.asarray([prod(d + 1 for d in dims[i + 1 :]) for i in range(len(dims))])


def _inside(upto: np.ndarray, strides: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Counts of both classes in each box."""
    out = np.zeros((2, len(lo)), np.int64)
    for corner in product((0, 1), repeat=len(strides)):
        out += (-1) ** (len(corner) - sum(corner)) * upto[:, np.where(corner, hi, lo) @ strides].astype(np.int64)
    return out


def _gains(upto: np.ndarray, strides: np.ndarray, lo: np.ndarray, hi: np.ndarray, stats: np.ndarray, own: np.ndarray, w: np.ndarray, f: int, d: int) -> np.ndarray:
    """The gain of splitting each box before bin t of feature f, for t = 0 .. d; -1 where one side would be empty."""
    others = [j for j in range(len(strides)) if j != f]
    t = np.arange(d + 1)
    left = np.zeros((2, len(lo), d + 1), np.int64)
    for corner in product((0, 1), repeat=len(others)):
        base = sum((np.where(c, hi[:, j], lo[:, j]) * strides[j] for j, c in zip(others, corner, strict=True)), np.zeros(len(lo), int))
        left += (-1) ** (len(others) - sum(corner)) * upto[:, base[:, None] + t * strides[f]].astype(np.int64)
    left -= np.take_along_axis(left, np.broadcast_to(lo[None, :, f, None], (2, len(lo), 1)), axis=2)
    right = stats[:, :, None] - left
    good = (t > lo[:, f, None]) & (t < hi[:, f, None]) & (left.sum(axis=0) > 0) & (right.sum(axis=0) > 0)
    left, right = left * good, right * good
    # weight times Gini impurity is the weight less the squares of the classes over it
    lost = lambda x: (s := x.sum(axis=0)) - (x**2).sum(axis=0) / np.maximum(s, 1e-300)
    total = own.sum(axis=0)
    gain = (lost(own)[:, None] - lost(left * w[:, None, None]) - lost(right * w[:, None, None])) / np.maximum(total, 1e-300)[:, None]
    return np.where(good & (gain > 1e-15), gain, -1.0)


def paint(low: np.ndarray, high: np.ndarray, share: np.ndarray, dims: list[int]) -> np.ndarray:
    """The sum of the shares of the boxes around each cell."""
    out = np.zeros([d + 1 for d in dims], np.int64)
    vote = np.round(share * VOTE).astype(np.int64)
    for corner in product((0, 1), repeat=len(dims)):
        at = np.where(corner, high, low).astype(int)
        np.add.at(out, tuple(at.T), (-1) ** sum(corner) * vote)
    for axis in range(len(dims)):
        np.cumsum(out, axis=axis, out=out)
    return out[tuple(slice(d) for d in dims)] / VOTE
