"""Window features that no column expression gives: small NumPy kernels behind Arrow UDFs.

Definitions follow public literature; they haven't been checked against any
package.  Each kernel takes one window; a window that is NULL, too short or has
a missing sample gives NULLs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _entropy(p: np.ndarray) -> float:
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


#: Rows of the distance matrix that are held at once.
BLOCK_ROWS = 256


def pair_entropies(x: np.ndarray, bins: int = 500) -> tuple[float, float, float]:
    """Approximate, fuzzy and distribution entropy from the pairwise distances, by blocks of rows."""
    n, r = len(x), 0.2 * x.std()
    n2, n3 = n - 1, n - 2
    near2, near3 = np.zeros(n2), np.zeros(n3)
    w2 = w3 = 0.0
    low, high, later = np.inf, -np.inf, []
    def pairs(d: np.ndarray, near: np.ndarray, a: int, b: int) -> float:
        """Counts the near pairs of rows a to b with themselves and all later ones; the sum of the fuzzy weights, either way."""
        close, k = d <= r, b - a
        near[a:b] += close.sum(1)
        near[b:] += close[:, k:].sum(0)
        if not r > 0:
            return 0.0
        # 2 ** -(d / r)**2; those of a row with itself weigh 1
        w = np.exp2(-np.square(d * (1 / r)))
        return w[:, :k].sum() - k + 2 * w[:, k:].sum()

    for a in range(0, n2, BLOCK_ROWS):
        b = min(a + BLOCK_ROWS, n2)
        d = np.abs(x[a : b + 2, None] - x[None, a:])  # two rows and columns more than the embeddings start
        d2 = np.maximum(d[: b - a, :-1], d[1 : b - a + 1, 1:])
        c = min(b, n3)
        d3 = np.maximum(d2[: c - a, :-1], d[2 : c - a + 2, 2:])
        w2 += pairs(d2, near2, a, b)
        w3 += pairs(d3, near3, a, c)
        k = b - a
        upper = np.concatenate([d2[:, :k][np.triu_indices(k, 1)], d2[:, k:].ravel()])
        if len(upper):
            low, high = min(low, upper.min()), max(high, upper.max())
            later.append(upper)
    if r > 0:
        approximate = float(np.log(near2 / n2).mean() - np.log(near3 / n3).mean())
        fuzzy = float(-np.log((w3 / (n3 * (n3 - 1))) / (w2 / (n2 * (n2 - 1))))) if w2 > 0 and w3 > 0 else 0.0
    else:
        approximate = fuzzy = 0.0
    if not high > low:
        return approximate, fuzzy, 0.0
    counts = np.zeros(bins, np.int64)
    for d in later:
        counts += np.bincount(np.minimum(((d - low) * (bins / (high - low))).astype(np.int64), bins - 1), minlength=bins)
    return approximate, fuzzy, _entropy(counts / counts.sum()) / np.log2(bins)


def entropy_profile(x: np.ndarray) -> list[float]:
    """Sum, mean, largest, least, median, deviation, variance, kurtosis and skewness of the sample entropy profile.

    Distances are rounded to three decimals; the profile runs over every
    distinct radius of the embeddings of dimension 2 and 3.
    """
    n = len(x)

    def distances(m: int) -> np.ndarray:
        e = np.lib.stride_tricks.sliding_window_view(x, m)[: n - 2]
        d = np.abs(e[:, None] - e[None]).max(2)
        np.fill_diagonal(d, np.inf)
        return np.floor(d * 1000 + 0.5) / 1000

    d2, d3 = distances(2), distances(3)
    radii = np.unique(np.concatenate([d2[np.isfinite(d2)], d3[np.isfinite(d3)]]))
    share = lambda d: np.searchsorted(np.sort(d[np.isfinite(d)]), radii, "right") / len(d)
    p = np.log((share(d2) + 1e-12) / (share(d3) + 1e-12))
    c, v = p - p.mean(), p.var()
    shape = [(c**4).mean() / v**2 - 3, (c**3).mean() / v**1.5] if v > 0 else [float("nan")] * 2
    return [p.sum(), p.mean(), p.max(), p.min(), float(np.median(p)), np.sqrt(v), v, *shape]


def permutation_entropy(x: np.ndarray, order: int = 3) -> float:
    ranks = np.argsort(np.lib.stride_tricks.sliding_window_view(x, order), axis=1, kind="stable")
    return _entropy(np.unique(ranks @ (order ** np.arange(order)), return_counts=True)[1] / len(ranks))


def svd_entropy(x: np.ndarray, order: int = 3) -> float:
    s = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(x, order), compute_uv=False)
    return _entropy(s / s.sum()) if s.sum() > 0 else 0.0


def value_entropy(x: np.ndarray) -> float:
    return _entropy(np.unique(x, return_counts=True)[1] / len(x))


def phrases(x: np.ndarray) -> int:
    """The number of phrases (1976) of the sequence of values cut to unsigned whole numbers."""
    symbols = x.astype(np.int64).astype(np.uint32).astype("<u4").tobytes()
    count, start, n = 0, 0, len(x)
    while start < n:
        length = 1
        while start + length <= n:  # grow while the phrase occurs, also overlapping itself, before its last symbol
            at = symbols.find(symbols[4 * start : 4 * (start + length)], 0, 4 * (start + length - 1))
            while at % 4 and at >= 0:
                at = symbols.find(symbols[4 * start : 4 * (start + length)], at + 1, 4 * (start + length - 1))
            if at < 0:
                break
            length += 1
        count += 1
        start += length
    return count


def higuchi(x: np.ndarray, most: int = 10) -> float:
    n, k = len(x), np.arange(1, most + 1)
    lengths = [np.mean([np.abs(np.diff(x[m::s])).sum() * (n - 1) / (((n - 1 - m) // s) * s) / s for m in range(s) if (n - 1 - m) // s]) for s in k]
    if min(lengths) <= 0:
        return float("nan")
    return float(np.polyfit(np.log(1 / k), np.log(lengths), 1)[0])


def detrended_fluctuation(x: np.ndarray) -> float:
    walk, sizes, s = np.cumsum(x - x.mean()), [], 4.0
    while s <= len(x) / 4:
        sizes.append(int(s))
        s *= 1.2
    sizes, spread = sorted(set(sizes)), []
    for s in sizes:
        boxes = walk[: len(walk) // s * s].reshape(-1, s)
        t = np.arange(s) - (s - 1) / 2
        slope = boxes @ t / (t @ t)
        rest = boxes - boxes.mean(1, keepdims=True) - slope[:, None] * t
        spread.append(np.sqrt((rest**2).mean()))
    if len(sizes) < 2 or min(spread) <= 0:
        return float("nan")
    return float(np.polyfit(np.log(sizes), np.log(spread), 1)[0])


def simplification(y: np.ndarray, starts: np.ndarray, least: float = 0.0) -> np.ndarray:
    """Up to which tolerance line simplification by vertical distance keeps each sample of the series that begin at ``starts``.

    A stretch is cut at the sample farthest from the line between its ends,
    whatever the tolerance; so one pass over the stretches of all series, level
    by level, tells for every sample the least distance on the way down to it.
    Stretches that aren't above ``least`` are left.
    """
    kept = np.zeros(len(y))
    a, b = starts.astype(np.int64), np.append(starts[1:], len(y)).astype(np.int64) - 1
    kept[a] = kept[b] = np.inf
    limit = np.full(len(a), np.inf)
    while True:
        wide = b - a > 1
        a, b, limit = a[wide], b[wide], limit[wide]
        if not len(a):
            return kept
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        at = np.arange(inner.sum()) + np.repeat(a + 1 - first, inner)
        slope = (y[b] - y[a]) / (b - a)
        gap = np.abs(y[at] - np.repeat(y[a], inner) - np.repeat(slope, inner) * (at - np.repeat(a, inner)))
        most = np.maximum.reduceat(gap, first)
        cut = np.minimum.reduceat(np.where(gap == np.repeat(most, inner), at, len(y)), first)
        limit = np.minimum(limit, most)
        kept[cut] = limit
        more = limit > least
        a, b, limit = np.concatenate([a[more], cut[more]]), np.concatenate([cut[more], b[more]]), np.concatenate([limit[more]] * 2)


def sign_changes_of(x: np.ndarray) -> int:
    sign = x >= 0
    return int((sign[1:] != sign[:-1]).sum())


def simplified_crossings(x: np.ndarray, tolerance: float) -> int:
    """Sign changes of the samples that line simplification by vertical distance keeps."""
    return sign_changes_of(x[simplification(x, np.zeros(1, np.int64), tolerance) > tolerance])


def welch(x: np.ndarray, rate: float, segment: int) -> np.ndarray:
    """One-sided power density: periodic Hann segments that half overlap, means removed, averaged."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)
    parts = np.lib.stride_tricks.sliding_window_view(x, segment)[:: segment // 2]
    power = np.abs(np.fft.rfft((parts - parts.mean(1, keepdims=True)) * hann)) ** 2 / (rate * (hann**2).sum())
    power[:, 1 : (segment + 1) // 2] *= 2
    return power.mean(0)


def simpson(y: np.ndarray, step: float) -> float:
    """Composite Simpson; an even number of points has its last interval by the parabola through the last three."""
    n = len(y)
    if n < 3:
        return float(step * (y[:-1] + y[1:]).sum() / 2)
    odd = n if n % 2 else n - 1
    area = y[0] + y[odd - 1] + 4 * y[1 : odd - 1 : 2].sum() + 2 * y[2 : odd - 2 : 2].sum()
    last = 0.0 if n % 2 else step * (5 / 12 * y[-1] + 2 / 3 * y[-2] - 1 / 12 * y[-3])
    return float(step / 3 * area + last)


def _per_window(f: Callable[[np.ndarray], list[float]], least: int) -> Column:
    def run(windows: pd.Series) -> pd.Series:
        out = []
        for w in windows:
            x = None if w is None else np.asarray(w, float)
            good = x is not None and len(x) >= least and np.isfinite(x).all()
            out.append([float(v) if np.isfinite(v) else None for v in f(x)] if good else None)
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")


def entropies(x: Column) -> Column:
    """[approximate, fuzzy, distribution, permutation, singular value, of exact values]"""
    return _per_window(lambda w: [*pair_entropies(w), permutation_entropy(w), svd_entropy(w), value_entropy(w)], 8)(x)


def profiles(x: Column) -> Column:
    """The nine statistics of ``entropy_profile``; quadratic in the window, so only on demand."""
    return _per_window(lambda w: [float(v) for v in entropy_profile(w)], 8)(x)


def complexities(x: Column) -> Column:
    """[phrases, Higuchi, detrended fluctuation]"""
    return _per_window(lambda w: [phrases(w), higuchi(w), detrended_fluctuation(w)], 16)(x)


def crossings(x: Column, tolerances: tuple[float, ...]) -> Column:
    """Sign changes of the centred window at each tolerance; all windows of a batch are simplified together."""

    def run(windows: pd.Series) -> pd.Series:
        series = [None if w is None else np.asarray(w, float) for w in windows]
        good = [i for i, w in enumerate(series) if w is not None and len(w) > 1 and np.isfinite(w).all()]
        out: list = [None] * len(series)
        if good:
            centred = [series[i] - series[i].mean() for i in good]
            ends = np.cumsum([len(w) for w in centred])
            starts = ends - [len(w) for w in centred]
            y = np.concatenate(centred)
            kept, positive = simplification(y, starts, min(tolerances)), y >= 0
            owner = np.repeat(np.arange(len(good)), ends - starts)
            counts = []
            for t in tolerances:
                at = np.flatnonzero(kept > t)
                changes = (positive[at[1:]] != positive[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
                counts.append(np.bincount(owner[at[1:]][changes], minlength=len(good)))
            for i, row in zip(good, np.stack(counts, 1).astype(float).tolist(), strict=True):
                out[i] = row
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(x)


def power_density(x: Column, rate: float, segment: int) -> Column:
    return _per_window(lambda w: welch(w, rate, segment).tolist(), segment)(x)


def band_power(psd: Column, step: float) -> Column:
    """The Simpson integral of a spectrum or a slice of it, as an array of one."""
    return _per_window(lambda p: [simpson(p, step)], 1)(psd)
