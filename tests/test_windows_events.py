from __future__ import annotations

from pyspark.sql import functions as F

from quillwave.operators import events, windows
from tests.conftest import rows


def spans(spark, data):
    return spark.createDataFrame(data, "filename string, start_ms long, end_ms long")


def intervals(spark, data):
    return spark.createDataFrame(data, "filename string, idx int, start_ms long, end_ms long")


def test_grid_lengths(spark):
    df = spark.createDataFrame([("a", 1023), ("b", 1024), ("c", 2047), ("d", 2048)], "filename string, n_samples long")
    assert rows(windows.grid_starts(df), "filename", "start_sample") == [("b", 0), ("c", 0), ("d", 0), ("d", 1024)]


def test_dense_is_clamped(spark):
    f = spark.createDataFrame([("a", 25600)], "filename string, n_samples long")
    s = windows.schedule(f, intervals(spark, [("a", 0, 10_000, 20_000)]))
    dense = windows.dense_starts(f, intervals(spark, [("a", 0, 10_000, 20_000)]))
    assert [r[0] for r in rows(dense, "start_sample")] == list(range(0, 20481, 128))
    assert s.where((F.col("start_sample") % 1024 == 0) != F.col("on_uniform_grid")).count() == 0


def test_label_at_half_and_first_interval(spark):
    w = spans(spark, [("a", 0, 4000), ("b", 0, 4000), ("c", 0, 4000), ("d", 0, 4000)])
    i = intervals(spark, [("a", 0, 2000, 10_000), ("b", 0, 3000, 10_000), ("c", 1, 2000, 4000), ("c", 0, 0, 2000)])
    assert rows(windows.label_windows(w, i), "filename", "label", "event_id") == [("a", 1, "a_sz0"), ("b", 0, None), ("c", 1, "c_sz0"), ("d", 0, None)]


def test_overlap_join_equals_brute_force_over_buckets(spark):
    a = [("x", s, s + n) for s, n in [(0, 5), (3, 40), (9, 1), (25, 25), (60, 3)]]
    b = [("x", s, s + n) for s, n in [(4, 6), (10, 30), (55, 5), (0, 100)]]
    found = windows.overlap_join(spans(spark, a), spans(spark, b), "filename", bucket=7)
    expected = sorted((p[1], p[2], q[1], q[2]) for p in a for q in b if p[1] <= q[2] and q[1] <= p[2])
    assert rows(found, "start_ms", "end_ms", "r_start_ms", "r_end_ms") == expected


def test_near_zone_bounds(spark):
    w = spans(spark, [("a", 40_000, 44_000), ("a", 39_999, 44_000), ("a", 180_000, 184_000), ("a", 180_001, 184_001)])
    z = windows.near_zone(w, intervals(spark, [("a", 0, 100_000, 120_000)]))
    assert rows(z, "start_ms", "is_near") == [(39_999, False), (40_000, True), (180_000, True), (180_001, False)]


def test_windows_per_interval_counts_zero(spark):
    found = windows.windows_per_interval(spans(spark, [("a", 0, 4000)]), intervals(spark, [("a", 0, 2000, 9000), ("a", 1, 3000, 9000), ("b", 0, 0, 5)]))
    assert rows(found) == [("a", 0, 1), ("a", 1, 0), ("b", 0, 0)]


def test_merge_gap_is_inclusive(spark):
    s = spans(spark, [("a", 0, 4000), ("a", 12_000, 16_000), ("b", 0, 4000), ("b", 16_000, 20_000)])
    assert rows(events.merge_spans(s, ["filename"], 8000)) == [("a", 0, 16_000, 2), ("b", 0, 4000, 1), ("b", 16_000, 20_000, 1)]
    assert rows(events.session_spans(s, ["filename"], 8000)) == rows(events.merge_spans(s, ["filename"], 8000))


def test_split_at_longest(spark):
    s = spans(spark, [("a", 0, 300_000), ("b", 0, 304_000)])
    assert rows(events.split_long(s)) == [("a", 0, 300_000), ("b", 0, 300_000), ("b", 300_000, 304_000)]


def test_files_without_events_stay(spark):
    files = spark.createDataFrame([("a",), ("b",)], "filename string")
    assert rows(events.with_empty(files, spans(spark, [("a", 0, 5)]), ["filename"])) == [("a", 1, 5), ("b", 0, 0)]


def test_contiguous_runs(spark):
    s = spans(spark, [("a", t, t + 4000) for t in (0, 4000, 8000, 16_000, 20_500)])
    assert rows(events.contiguous_runs(s, ["filename"], 4000)) == [("a", 0, 3, 12_000), ("a", 16_000, 1, 4000), ("a", 20_500, 1, 4000)]


def test_kth_largest(spark):
    df = spark.createDataFrame([("a", v) for v in (10, 20, 30, 40, 50)], "g string, units int")
    at = lambda f: rows(events.kth_largest(df, ["g"], "units", f))
    assert at(0.5) == [("a", 5, 2, 40)]  # 2.5 rounds to even
    assert at(1e-9) == [("a", 5, 1, 50)]
    assert at(0.0) == [("a", 5, 1, 51)]
    assert at(9.0) == [("a", 5, 5, 10)]
