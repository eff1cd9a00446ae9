"""Perceptrons with sigmoid layers and a softmax, several at once on subsets of the same rows.

Spark's own learner multiplies in plain Java and reads the rows of each model
anew.  Here the models of all folds take their steps together: one job gives the
loss and gradient of all of them at their next points, in matrix products
over blocks of rows.  The steps are those of L-BFGS with a strong Wolfe search.
On many rows 200 such steps cost too much and don't arrive; there each job is a
pass of small steps (Adam) over all rows, until passes gain nothing more.
"""

from __future__ import annotations

from collections.abc import Generator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwave.session import release

#: Rows multiplied at once, and rows handed over at once.
BLOCK, LOT = 2048, 16_384
#: Steps that L-BFGS remembers, losses that have to be alike at its end, and trials of a line search.
MEMORY, HISTORY, TRIALS = 10, 20, 10

#: Rows of a model from which it learns in passes; rows of a small step, its rate, the decay of its means.
MANY, BATCH, RATE, DECAY = 1 << 19, 512, 0.01, (0.9, 0.999)
#: Passes in a row that lower the mean loss by less than GAIN before the end.
PATIENCE, GAIN = 10, 1e-4

#: Jobs after which what they left behind is released.
TIDY = 25

Step = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def fit_networks(learner: MultilayerPerceptronClassifier, rows: DataFrame, features: Sequence[str], ranges: list[tuple[np.ndarray, np.ndarray]], blocks: RDD | None = None) -> list[np.ndarray]:
    """The weights of model i, which learns the rows with bit i of ``_drawn``, features scaled by ``ranges[i]`` (low, high); ``blocks`` are those of ``rows``, if they are kept already."""
    layers = list(learner.getLayers())
    start = learner.getInitialWeights() if learner.isSet("initialWeights") else None
    first = first_weights(layers, learner.getSeed()) if start is None else np.asarray(start.toArray(), float)
    kept = blocks_of(rows, list(features)) if blocks is None else blocks
    try:
        if max(_sizes(kept, len(ranges), layers[0] + 1)) >= MANY:
            return _by_passes(rows, kept, learner, first, ranges)
        steps = [minimise(first, learner.getMaxIter(), learner.getTol()) for _ in ranges]
        wanted = {i: next(s) for i, s in enumerate(steps)}
        done: dict[int, np.ndarray] = {}
        jobs = 0
        while wanted:
            jobs += 1
            if jobs % TIDY == 0:
                release(rows.sparkSession)
            found = _evaluate(kept, layers, wanted, ranges)
            for i in list(wanted):
                try:
                    wanted[i] = steps[i].send(found[i])
                except StopIteration as end:
                    done[i] = end.value
                    del wanted[i]
    finally:
        if blocks is None:
            kept.unpersist()
    return [done[i] for i in range(len(ranges))]


def _sizes(blocks: RDD, models: int, width: int) -> list[int]:
    """How many rows each model learns."""
    found = blocks.map(lambda r: (r[0], len(r[1]) // (8 * width))).collect()
    return [sum(n for drawn, n in found if drawn >> i & 1) for i in range(models)]


def _by_passes(rows: DataFrame, blocks: RDD, learner: MultilayerPerceptronClassifier, first: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``fit_networks`` in passes over all rows; as many as the learner's iterations at most."""
    states = {i: (first, np.zeros(len(first)), np.zeros(len(first)), 0) for i in range(len(ranges))}
    wanted, best, idle = dict(states), dict.fromkeys(states, np.inf), dict.fromkeys(states, 0)
    for number in range(learner.getMaxIter()):
        if not wanted:
            break
        if number % TIDY == TIDY - 1:
            release(rows.sparkSession)
        for i, (loss, state) in _pass(blocks, list(learner.getLayers()), wanted, ranges, (abs(learner.getSeed()), number)).items():
            states[i] = wanted[i] = state
            idle[i] = 0 if loss < best[i] - GAIN else idle[i] + 1
            best[i] = min(best[i], loss)
            if idle[i] >= PATIENCE:
                del wanted[i]
    return [states[i][0] for i in range(len(ranges))]


def _pass(blocks: RDD, layers: list[int], wanted: dict[int, tuple], ranges: list[tuple[np.ndarray, np.ndarray]], seed: tuple[int, int]) -> dict[int, tuple[float, tuple]]:
    """(mean loss during the pass, state after it) of each wanted model.

    A state is (weights, mean gradient, mean squared gradient, steps).  Each
    partition steps through all its rows from the same state; then the states
    are averaged by rows.
    """
    width = layers[0] + 1

    def run(split, lots):
        own = {i: [w.copy(), m.copy(), v.copy(), t, 0.0, 0] for i, (w, m, v, t) in wanted.items()}
        for at, (drawn, lot) in enumerate(lots):
            a = np.frombuffer(lot).reshape(-1, width)
            a = a[np.random.default_rng([*seed, split, at]).permutation(len(a))]
            y, parts = a[:, -1], max(1, round(len(a) / BATCH))
            ends = [len(a) * k // parts for k in range(parts + 1)]
            for i, state in own.items():
                if drawn >> i & 1:
                    x = _scaled(a[:, :-1], ranges[i]).astype(np.float32)
                    w, m, v = state[:3]
                    for low, high in zip(ends, ends[1:]):
                        loss, grad = loss_gradient(w, layers, x[low:high], y[low:high])
                        grad /= max(high - low, BATCH // 2)  # the last rows of a partition may be few
                        state[3] += 1
                        m += (1 - DECAY[0]) * (grad - m)
                        v += (1 - DECAY[1]) * (grad * grad - v)
                        w -= RATE / (1 - DECAY[0] ** state[3]) * m / (np.sqrt(v / (1 - DECAY[1] ** state[3])) + 1e-8)
                        state[4] += loss
                    state[5] += len(a)
        yield own

    found = blocks.mapPartitionsWithIndex(run).collect()
    out = {}
    for i in wanted:
        n = max(1, sum(f[i][5] for f in found))
        out[i] = (sum(f[i][4] for f in found) / n, (*[sum(f[i][j] * (f[i][5] / n) for f in found) for j in range(3)], max(f[i][3] for f in found)))
    return out


def fit_lines(blocks: RDD, weights: list[dict[float, float]], strength: list[float], most: int, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """(coefficients of the scaled features, constant) of model i's logistic regression, rows and models as in ``fit_networks``.

    It is the minimum of the mean loss, by class weight, plus ``strength[i]`` / 2
    of the coefficients' squares; found by Newton's steps, halved where one doesn't help.
    """
    k = len(ranges[0][0])
    points, values = {i: np.zeros(k + 1) for i in range(len(ranges))}, dict.fromkeys(range(len(ranges)), np.inf)
    out: dict[int, np.ndarray] = {i: np.append(np.zeros(k), np.inf if 1.0 in w else -np.inf) for i, w in enumerate(weights) if len(w) < 2}  # one class only
    wanted = {i: p for i, p in points.items() if i not in out}
    moves: dict[int, np.ndarray] = {}
    for _ in range(most):
        if not wanted:
            break
        for i, (value, grad, curve) in _curved(blocks, k, wanted, weights, strength, ranges).items():
            if value > values[i] and np.abs(moves[i]).max() > 1e-9:
                moves[i] = moves[i] / 2
                wanted[i] = points[i] + moves[i]
                continue
            points[i], values[i] = wanted[i], value
            moves[i] = -np.linalg.lstsq(curve, grad, rcond=None)[0]
            if np.abs(moves[i]).max() <= 1e-9 * max(1.0, np.abs(points[i]).max()):
                del wanted[i]
            else:
                wanted[i] = points[i] + moves[i]
    return [out[i] if i in out else points[i] for i in range(len(ranges))]


def _curved(blocks: RDD, k: int, wanted: dict[int, np.ndarray], weights: list[dict[float, float]], strength: list[float], ranges: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Value, gradient and curvature of each wanted regression."""

    def run(lots):
        sums = {i: [0.0, np.zeros(k + 1), np.zeros((k + 1, k + 1)), 0.0] for i in wanted}
        for drawn, lot in lots:
            a = np.frombuffer(lot).reshape(-1, k + 1)
            for i, p in wanted.items():
                if drawn >> i & 1:
                    y = a[:, -1]
                    x = np.column_stack([_scaled(a[:, :-1], ranges[i]), np.ones(len(a))])
                    w = np.where(y == 1, weights[i][1.0], weights[i][0.0])
                    z = x @ p
                    q = (1 + np.tanh(z / 2)) / 2
                    s = sums[i]
                    s[0] += w @ (np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))))
                    s[1] += (w * (q - y)) @ x
                    s[2] += (x * (w * q * (1 - q))[:, None]).T @ x
                    s[3] += w.sum()
        yield sums

    found = blocks.mapPartitions(run).collect()
    out = {}
    for i, p in wanted.items():
        value, grad, curve, n = (sum(f[i][j] for f in found) for j in range(4))
        ridge = strength[i] * np.append(np.ones(k), 0.0)
        out[i] = (value / n + (ridge * p) @ p / 2, grad / n + ridge * p, curve / n + np.diag(ridge))
    return out


def probability(weights: np.ndarray, learner: MultilayerPerceptronClassifier, ends: tuple[np.ndarray, np.ndarray], features: Sequence[str]) -> Column:
    """The probability of class 1."""
    layers = list(learner.getLayers())

    def run(rows: pd.DataFrame) -> pd.Series:
        x = _scaled(rows.to_numpy(float), ends)
        return pd.Series((1 + np.tanh(_forward(_split(weights, layers), x) / 2)) / 2)

    return F.pandas_udf(run, "double")(F.struct(*features))


def first_weights(layers: list[int], seed: int) -> np.ndarray:
    """Uniform within 2.4 over the root of each layer's inputs."""
    rng = np.random.RandomState(seed)
    return np.concatenate([rng.uniform(-2.4, 2.4, (a + 1) * b) / np.sqrt(a) for a, b in zip(layers, layers[1:])])


def _split(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix of inputs x outputs, constants) of each layer, in Spark's order."""
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + (a + 1) * b]))
        at += (a + 1) * b
    return out


def _scaled(x: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """By the range, not clipped; a constant column becomes 0."""
    low, wide = ends[0], ends[1] - ends[0]
    return (x - low) * np.where(wide > 0, 1 / np.where(wide > 0, wide, 1), 0)


def _forward(parts: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The margins of class 1 over class 0."""
    for w, b in parts[:-1]:
        x = (1 + np.tanh((x @ w + b) / 2)) / 2
    w, b = parts[-1]
    return x @ (w[:, 1] - w[:, 0]) + (b[1] - b[0])


def loss_gradient(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed cross-entropy and its gradient, blocks in the precision of ``x``, their sums in double.

    A sigmoid is (1 + tanh(z / 2)) / 2: halves and constants go into the next
    layer's weights, the first layer's constants into a column of ones.
    """
    kind, total, grad = x.dtype, 0.0, np.zeros(len(weights))
    parts, into = _split(weights, layers), _split(grad, layers)
    ahead = [np.concatenate([parts[0][0], parts[0][1][None, :]]) / 2]  # inputs of tanh, from the layer before
    shift = [None]
    for w, b in parts[1:-1]:
        ahead.append(w / 4)
        shift.append(((b + w.sum(axis=0) / 2) / 2).astype(kind))
    ahead = [w.astype(kind) for w in ahead]
    last = parts[-1][0][:, 1] - parts[-1][0][:, 0]
    bias = kind.type(parts[-1][1][1] - parts[-1][1][0] + last.sum() / 2)
    last = (last / 2).astype(kind)
    back = [np.ascontiguousarray(w.T).astype(kind) for w, _ in parts[1:-1]]
    rows = min(BLOCK, len(x))
    tanh, delta, first, ones = _room(tuple(layers), 1 << max(0, rows - 1).bit_length(), kind)
    for i in range(0, len(x), rows or 1):
        t = y[i : i + rows].astype(kind)
        n = len(t)
        first[:n, :-1] = x[i : i + rows]
        each = [first[:n]]
        for w, b, h in zip(ahead, shift, tanh, strict=True):
            h = h[:n]
            np.matmul(each[-1], w, out=h)
            if b is not None:
                h += b
            np.tanh(h, out=h)
            each.append(h)
        m = each[-1] @ last
        m += bias
        e = np.exp(-np.abs(m))
        total += float((np.maximum(m, 0) - t * m + np.log1p(e)).sum(dtype=float))
        d = np.where(m >= 0, 1, e) / (1 + e) - t
        own = float(d.sum(dtype=float))
        into[-1][0][:, 1] += (d @ each[-1] + own) / 2
        into[-1][1][1] += own
        for layer in range(len(tanh) - 1, -1, -1):
            h, g = each[layer + 1], delta[layer][:n]
            if layer == len(tanh) - 1:
                np.multiply(d[:, None], last / 2, out=g)  # last is halved once already
            else:
                np.matmul(delta[layer + 1][:n], back[layer] / 4, out=g)
            np.multiply(h, h, out=h)
            np.subtract(1, h, out=h)
            g *= h
            below = each[layer].T @ g
            if layer:
                own = ones[:n] @ g
                into[layer][0][...] += (below + own) / 2
                into[layer][1][...] += own
            else:
                into[0][0][...] += below[:-1]
                into[0][1][...] += below[-1]
    into[-1][0][:, 0], into[-1][1][0] = -into[-1][0][:, 1], -into[-1][1][1]
    return total, grad


@lru_cache(4)
def _room(layers: tuple[int, ...], rows: int, kind: np.dtype) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Arrays of ``loss_gradient`` for blocks of up to ``rows``; made anew for each small step they would cost as much as the products."""
    tanh, delta = ([np.empty((rows, n), kind) for n in layers[1:-1]] for _ in range(2))
    return tanh, delta, np.ones((rows, layers[0] + 1), kind), np.ones(rows, kind)


def blocks_of(rows: DataFrame, features: list[str]) -> RDD:
    """Lots of rows drawn alike, (drawn, features and class as bytes), on all cores; kept while the models learn."""

    def run(batches):
        parts: dict[int, list[np.ndarray]] = {}

        def lot(mask: int) -> pd.DataFrame:
            return pd.DataFrame({"drawn": [mask], "lot": [np.concatenate(parts.pop(mask)).tobytes()]})

        for b in batches:
            a, drawn = b[[*features, "y"]].to_numpy(float), b["_drawn"].to_numpy()
            for mask in np.unique(drawn).tolist():
                parts.setdefault(mask, []).append(a[drawn == mask])
                if sum(map(len, parts[mask])) >= LOT:
                    yield lot(mask)
        for mask in list(parts):
            yield lot(mask)

    spread = rows.where("_drawn <> 0").select(*features, "y", "_drawn").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "drawn long, lot binary").rdd.map(lambda r: (r[0], bytes(r[1]))).persist(StorageLevel.MEMORY_AND_DISK)


def _evaluate(blocks: RDD, layers: list[int], wanted: dict[int, np.ndarray], ranges: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, np.ndarray]]:
    """Mean loss and gradient of each wanted model; a partition, of which there is one a core, sends their sums."""
    width = layers[0] + 1

    def run(lots):
        sums = {i: [0.0, np.zeros(len(w)), 0] for i, w in wanted.items()}
        for drawn, lot in lots:
            a = np.frombuffer(lot).reshape(-1, width)
            for i, w in wanted.items():
                if drawn >> i & 1:
                    loss, grad = loss_gradient(w, layers, _scaled(a[:, :-1], ranges[i]).astype(np.float32), a[:, -1])
                    sums[i][0] += loss
                    sums[i][1] += grad
                    sums[i][2] += len(a)
        yield sums

    found = blocks.mapPartitions(run).collect()
    out = {}
    for i in wanted:
        n = max(1, sum(f[i][2] for f in found))
        out[i] = (sum(f[i][0] for f in found) / n, sum(f[i][1] for f in found) / n)
    return out


def minimise(x: np.ndarray, most: int, tolerance: float) -> Step:
    """L-BFGS: yields points, is sent (value, gradient) there, returns the last point.

    It ends after ``most`` steps, when the last HISTORY values differ by less than
    ``tolerance`` of the first one, when the gradient's norm is below
    ``tolerance`` of the value, or when no better point is found.
    """
    f, g = yield x
    first, values = f, [f]
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(most):
        if np.linalg.norm(g) <= max(tolerance * f, 1e-8):
            break
        p = -_inverse(moves, g)
        if g @ p >= 0:
            moves, p = [], -g
        found = yield from _search(x, f, g, p, 1.0 if moves else 1 / np.linalg.norm(p))
        if found is None and moves:  # once more without what it remembers
            moves, p = [], -g
            found = yield from _search(x, f, g, p, 1 / np.linalg.norm(p))
        if found is None:
            break
        new, f, gradient = found
        s, y = new - x, gradient - g
        if s @ y > 1e-12 * (y @ y):
            moves = [*moves, (s, y)][-MEMORY:]
        x, g = new, gradient
        values = [*values, f][-HISTORY:]
        if abs(f - max(values)) <= tolerance * abs(first):
            break
    return x


def _inverse(moves: list[tuple[np.ndarray, np.ndarray]], g: np.ndarray) -> np.ndarray:
    """The inverse of the curvature times ``g``, by two loops over the moves."""
    q, kept = g.copy(), []
    for s, y in reversed(moves):
        a = (s @ q) / (s @ y)
        q -= a * y
        kept.append(a)
    if moves:
        s, y = moves[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(moves, reversed(kept), strict=True):
        q += s * (a - (y @ q) / (s @ y))
    return q


def _search(x: np.ndarray, f: float, g: np.ndarray, p: np.ndarray, step: float) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float, np.ndarray] | None]:
    """A point along ``p`` that meets the strong Wolfe conditions, or the best one tried; None if none is better."""
    slope = g @ p
    low, high = (0.0, f, slope), None  # (step, value, slope)
    best = None
    for _ in range(2 * TRIALS):
        point = x + step * p
        value, gradient = yield point
        here = (step, value, gradient @ p)
        if np.isfinite(value) and value < (best[1] if best else f):
            best = (point, value, gradient)
        if not np.isfinite(value) or value > f + 1e-4 * step * slope or (low[0] > 0 and value >= low[1]):
            high = here
        elif abs(here[2]) <= -0.9 * slope:
            return point, value, gradient
        elif here[2] * ((high[0] - low[0]) if high else 1.0) >= 0 and high is not None:
            high, low = low, here
        elif here[2] >= 0:
            high, low = low, here
        else:
            low = here
        if high is None:
            step *= 2
            continue
        if abs(high[0] - low[0]) * max(abs(slope), 1e-300) < 1e-14:
            break
        step = _between(low, high)
    return best


def _between(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
    """The minimum of the cubic through two points, kept off their ends."""
    (a, fa, da), (b, fb, db) = low, high
    middle = (a + b) / 2
    if not np.isfinite([fa, da, fb, db]).all():
        return middle
    d1 = da + db - 3 * (fa - fb) / (a - b)
    square = d1 * d1 - da * db
    if square < 0:
        return middle
    d2 = np.copysign(np.sqrt(square), b - a)
    if (bottom := db - da + 2 * d2) == 0:
        return middle
    t = b - (b - a) * (db + d2 - d1) / bottom
    near, far = sorted((a, b))
    return t if near + 0.1 * (far - near) <= t <= far - 0.1 * (far - near) else middle
