from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwave.functions import arrays, kernels, signal
from quillwave.sources import edf
from tests.conftest import rows

RNG = np.random.RandomState(0)
X = RNG.randn(128)


def one(spark, column, x=X):
    df = spark.createDataFrame([([float(v) for v in x],)], "x array<double>")
    return df.select(column(F.col("x"))).first()[0]


def test_moments(spark):
    m = X - X.mean()
    want = {"mean": X.mean(), "variance": X.var(), "standardDeviation": X.std(), "median": np.median(X), "kurtosis": (m**4).mean() / X.var() ** 2 - 3, "skewness": (m**3).mean() / X.var() ** 1.5, "maximum": X.max(), "minimum": X.min()}
    df = spark.createDataFrame([(X.tolist(),)], "x array<double>").select(*[c.alias(k) for k, c in arrays.moments(F.col("x")).items()])
    assert df.first().asDict() == pytest.approx(want)


def test_constant_window(spark):
    flat = [5.0] * 16
    assert one(spark, arrays.kurtosis, flat) is None and one(spark, arrays.skewness, flat) is None
    assert one(spark, arrays.mobility, flat) is None and one(spark, arrays.katz, flat) is None
    assert kernels.pair_entropies(np.array(flat)) == (0.0, 0.0, 0.0)


def test_shapes_of_series(spark):
    d = np.diff(X)
    assert one(spark, arrays.sign_changes) == ((X[1:] < 0) != (X[:-1] < 0)).sum()
    assert one(spark, arrays.mobility) == pytest.approx(np.sqrt(d.var() / X.var()))
    assert one(spark, arrays.complexity) == pytest.approx(np.sqrt(np.diff(d).var() / d.var()) / np.sqrt(d.var() / X.var()))
    s = np.linalg.svd(np.stack([X[:-1], X[1:]], 1), compute_uv=False)
    w = s / s.sum()
    assert one(spark, arrays.fisher) == pytest.approx(-(w * np.log(w)).sum())
    assert one(spark, arrays.differences, [1.0]) == []


def test_pair_entropies_equal_brute_force():
    x, n = X[:40], 40
    r = 0.2 * x.std()
    dist = lambda m: np.abs(np.lib.stride_tricks.sliding_window_view(x, m)[:, None] - np.lib.stride_tricks.sliding_window_view(x, m)[None]).max(2)
    phi = lambda m: np.log((dist(m) <= r).mean(1)).mean()
    weight = lambda m: np.exp(-np.log(2) * (dist(m)[np.triu_indices(n - m + 1, 1)] / r) ** 2).mean()
    a, f, _ = kernels.pair_entropies(x)
    assert a == pytest.approx(phi(2) - phi(3)) and f == pytest.approx(-np.log(weight(3) / weight(2)))


def test_spectrum_of_a_sine():
    t = np.arange(1024) / 256
    p = kernels.welch(np.sin(2 * np.pi * 10 * t), 256, 512)
    assert p.argmax() == 20 and p.sum() * 0.5 == pytest.approx(0.5, rel=1e-6)
    assert kernels.simpson(np.arange(9.0) ** 2, 1.0) == pytest.approx(8**3 / 3)
    assert kernels.simpson(np.arange(8.0) ** 2, 1.0) == pytest.approx(7**3 / 3)


def test_phrases_and_crossings():
    naive = []

    def count(s):
        i, n = 0, 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and any(s[j : j + k] == s[i : i + k] for j in range(i)):
                k += 1
            n, i = n + 1, i + k
        return n

    for seed in range(5):
        s = np.random.RandomState(seed).randint(0, 3, 60)
        naive.append(count(s.tolist()))
        assert kernels.phrases(s.astype(float)) == naive[-1]
    zigzag = np.array([0.0, 10, -10, 10, -10, 0])
    assert kernels.simplified_crossings(zigzag, 1.0) == 4 and kernels.simplified_crossings(zigzag, 100.0) == 0


def test_filters():
    t = np.arange(4096) / 256
    band = signal.bandpass_sections(0.5, 40, 256)
    inside = signal.zero_phase(band, np.sin(2 * np.pi * 10 * t))
    outside = signal.zero_phase(band, np.sin(2 * np.pi * 100 * t))
    assert np.abs(inside[1000:3000] - np.sin(2 * np.pi * 10 * t)[1000:3000]).max() < 0.02
    assert np.abs(outside[1000:3000]).max() < 5e-3
    notch = signal.zero_phase(signal.notch_section(60, 30, 256), np.sin(2 * np.pi * 60 * t))
    assert np.abs(notch[1500:2500]).max() < 0.02
    assert signal.zero_phase(band, np.array([3.0])).tolist() == [3.0]


def test_windows_with_missing_samples_give_null(spark):
    df = spark.createDataFrame([([1.0, None] * 20,), (None,), ([1.0],)], "x array<double>")
    assert rows(df.select(kernels.entropies(F.col("x")).alias("e"))) == [(None,)] * 3


def test_edf_file(spark, tmp_path):
    x = np.sin(np.arange(640) / 7) * 80
    (tmp_path / "a.edf").write_bytes(edf.encode({"FP1-F7": x, "F7-T7": x[::-1]}, 64))
    (tmp_path / "b.edf").write_bytes(b"broken")
    files = edf.read(spark, str(tmp_path))
    heads = {r.path.rsplit("/", 1)[1]: r for r in edf.headers(files).collect()}
    assert heads["a.edf"].labels == ["FP1-F7", "F7-T7"] and heads["a.edf"].duration_sec == 10 and heads["a.edf"].rates == [64.0, 64.0]
    assert heads["b.edf"].error and heads["b.edf"].labels is None
    got = {r.channel: r.samples for r in edf.signals(files).where("error IS NULL").collect()}
    assert np.abs(np.array(got["FP1-F7"]) - x).max() < 0.01


def test_edf_channels_and_rates(spark, tmp_path):
    x = np.sin(np.arange(256) / 7) * 80
    (tmp_path / "a.edf").write_bytes(edf.encode({"FP1-F7": x, "T8-P8-0": x * 2, "T8-P8-1": x * 3}, 64))
    files = edf.read(spark, str(tmp_path))
    got = {r.channel: r for r in edf.signals(files, ["FP1-F7", "T8-P8", "CZ-PZ"], 64.0).collect()}
    assert np.abs(np.array(got["T8-P8"].samples) - x * 2).max() < 0.02 and got["FP1-F7"].error is None
    assert got["CZ-PZ"].samples is None and got["CZ-PZ"].error == "missing channel"
    other = edf.signals(files, ["FP1-F7"], 256.0).first()
    assert other.samples is None and "64" in other.error
