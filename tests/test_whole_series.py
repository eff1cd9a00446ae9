"""Whole series are filtered and written: rests and short series too."""

from __future__ import annotations

import numpy as np
import pytest

from quillwave.functions.signal import bandpass_sections, notch_section, zero_phase
from quillwave.plans import q_features
from tests.conftest import rows


@pytest.fixture
def made(spark, tmp_path):
    lines = [(1, i, 1, float((i * 7919) % 1000)) for i in range(600)] + [(2, i, 1, float(i % 50)) for i in range(100)]
    spark.createDataFrame(lines, "l_suppkey long, l_orderkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_filtered_before_it_is_cut(spark, made):
    found = q_features.filtered_series(spark, made).collect()
    assert sorted((r.file, r.start, r.n_samples) for r in found) == [(1, 0, 256), (1, 256, 256), (1, 512, 88), (2, 0, 100)]
    x = np.array([float((i * 7919) % 1000) / 100 for i in range(600)])
    y = zero_phase(np.concatenate([bandpass_sections(0.5, 40.0, 256.0), notch_section(60.0, 30.0, 256.0)]), x)
    after = {(r.file, r.start): r.after for r in found}
    for i in (0, 256, 512):
        assert abs(after[1, i] - y[i : i + 256].var()) < 1e-5


def test_recordings_hold_every_sample(spark, made):
    found = q_features.edf_roundtrip(spark, made)
    assert rows(found, "path", "n_samples", "duration_sec", "exact") == [("1.edf", 600, 10.0, True), ("2.edf", 100, 2.0, True)]
