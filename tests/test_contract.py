"""The 89 features against plain NumPy, and records of windows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.functions import contract, kernels
from quillwave.operators.records import positions
from tests.conftest import rows


def test_names():
    names = contract.names()
    assert len(names) == len(set(names)) == 89
    assert names[8] == "numberOfZeroCrossing" and names[-6:] == [f"azc_{t}" for t in (0, 16, 32, 64, 128, 256)]


def plain(x):
    m, d = x - x.mean(), np.diff(x)
    psd = kernels.welch(x, 256.0, 512)
    freq = np.arange(257) / 2
    out = {"mean": x.mean(), "variance": x.var(), "kurtosis": (m**4).mean() / x.var() ** 2 - 3, "numberOfZeroCrossing": ((x[1:] < 0) != (x[:-1] < 0)).sum(), "meanAbsoluteValue": np.abs(x).mean(), "shannonEntropy": np.log2(len(np.unique(x))),
           "positiveToNegativePeakRatio": 1.0, "sampleEntropy": 0.0, "hjorthMobility": np.sqrt(d.var() / x.var()), "renyiEntropy": -np.log2((x**2).sum()), "fd_maximum": psd.max(), "fd_bandPower": kernels.simpson(psd, 0.5),
           "spectralEntropy": -(psd / psd.sum() * np.log2(psd / psd.sum())).sum(), "approximateEntropy": kernels.pair_entropies(x)[0], "azc_0": ((m[1:] >= 0) != (m[:-1] >= 0)).sum()}
    for b, (lo, hi) in contract.BANDS.items():
        p = psd[(freq >= lo) & (freq < hi)]
        out |= {f"fd_mean_{b}": p.mean(), f"fd_median_{b}": np.median(p), f"fd_standardDeviation_{b}": p.std(), f"fd_bandPower_{b}": kernels.simpson(p, 0.5)}
    return out


def test_features_equal_numpy_and_missing_channels_are_null(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(1024).cumsum() * 4
    df = spark.createDataFrame([("a", 0, x.tolist()), ("b", 0, None)], "channel string, i int, x array<double>")
    found = {r.channel: r.asDict() for r in contract.with_features(df, "x").collect()}
    assert found["a"].keys() == {"channel", "i", *contract.names()}
    for k, v in plain(x).items():
        assert found["a"][k] == pytest.approx(v, rel=1e-9), k
    assert all(found["a"][k] is not None for k in contract.names())
    assert all(found["b"][k] is None for k in contract.names())
    wide = contract.wide(contract.with_features(df, "x"), ["i"], "channel", ["b", "a", "c"], ["mean", "fd_bandPower_alpha"])
    r = wide.first().asDict()
    assert list(r) == ["i", "b__mean", "b__fd_bandPower_alpha", "a__mean", "a__fd_bandPower_alpha", "c__mean", "c__fd_bandPower_alpha"]
    assert r["a__mean"] == pytest.approx(x.mean()) and r["b__mean"] is r["c__mean"] is None


def test_simplification_equals_the_plain_recursion():
    def plain_kept(x, tolerance):
        keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                gap = np.abs(x[a + 1 : b] - x[a] - (x[b] - x[a]) / (b - a) * np.arange(1, b - a))
                i = a + 1 + int(gap.argmax())
                if gap.max() > tolerance:
                    keep.add(i)
                    todo += [(a, i), (i, b)]
        return sorted(keep)

    rng = np.random.RandomState(9)
    series = [rng.randn(n).cumsum() * 20 for n in (2, 3, 50, 400)] + [np.zeros(30)]
    starts = np.cumsum([0, *[len(x) for x in series[:-1]]])
    kept = kernels.simplification(np.concatenate(series), starts)
    for x, a in zip(series, starts, strict=True):
        for t in (0, 5, 40):
            assert np.flatnonzero(kept[a : a + len(x)] > t).tolist() == plain_kept(x, t)


def test_positions_count_on_across_blocks(spark):
    df = spark.createDataFrame([("hot", i * 7 % 1000) for i in range(1000)] + [("a", 5), ("a", 900)], "k string, o int")
    got = positions(df, ["k"], ["o"], F.floor(F.col("o") / 64))
    assert rows(got, "k", "o", "pos") == sorted([("hot", i, i) for i in range(1000)] + [("a", 5, 0), ("a", 900, 1)])


def test_long_filters_run_in_chunks():
    from quillwave.functions import signal

    sections = np.concatenate([signal.bandpass_sections(0.5, 40, 256), signal.notch_section(60, 30, 256)])
    x = np.random.RandomState(2).randn(3000).cumsum()
    whole = signal.zero_phase(sections, x)
    for chunk in (1, 7, 5000):
        signal.CHUNK = chunk
        try:
            assert np.abs(signal.zero_phase(sections, x) - whole).max() < 1e-8
        finally:
            signal.CHUNK = 256
