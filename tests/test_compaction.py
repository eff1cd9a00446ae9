from __future__ import annotations

import datetime as dt
import random

import pytest

from quillwave.operators import compaction
from quillwave.operators.compaction import committed, compact, first_fit_decreasing
from tests.conftest import rows

SCHEMA = "part_id long, path string, filename string, body string, written_at timestamp_ntz, attempt int, bin string, label int"
HEAD = "window_start_sec,label,fp1_f7__mean"


def files(spark, bodies, names=None):
    day = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, f"p{i}", (names or {}).get(i, "f.edf"), b, day + dt.timedelta(hours=i), 1, "clash", 9) for i, b in enumerate(bodies)], SCHEMA)


def test_layouts_and_broken_lines(spark):
    bodies = [
        f"{HEAD}\r\n0.0,0,1.5\r\n4.0,1,\r\n\r\n{HEAD}\r\n8,0,-1\r\n12.0,0",
        "window_start_sec;label;fp1_f7__mean\n1.6e+01;0;2\n20.0;1;\n24.",
        '{"window_start_sec": 28.0, "label": 0, "fp1_f7__mean": null}\n{"window_start_sec": 32.0, "label": 0, "fp1',
        None, "", "\n\n", HEAD, "nan,0,1\n,0,1\n36.0,,1\n40.0,0,x",
    ]
    found = committed(spark, compact(files(spark, bodies)))
    assert rows(found, "filename", "start_ms", "label", "value") == [("f.edf", t, lab, v) for t, lab, v in [(0, 0, 1.5), (4000, 1, None), (8000, 0, -1.0), (16000, 0, 2.0), (20000, 1, None), (28000, 0, None)]]


def test_last_written_version_stays(spark):
    bodies = [f"{HEAD}\n0.0,0,1\n0.0,0,1", f"{HEAD}\n0.0,1,2", f"{HEAD}\n0.0000001,1,3"]
    found = committed(spark, compact(files(spark, bodies, {0: " F.EDF", 1: "f.edf ", 2: None})))
    assert rows(found, "filename", "start_ms", "label", "value") == [("f.edf", 0, 1, 2.0)]


def test_many_bins_hold_every_record_once(spark):
    rng = random.Random(1)
    names = {i: f"r{rng.randrange(5)}.edf" if i % 3 else "hot.edf" for i in range(60)}
    bodies = ["\n".join([HEAD, *(f"{rng.randrange(200)}.0,0,{i}" for _ in range(20))]) for i in range(60)]
    expected = {(names[i], int(float(line.split(",")[0]) * 1000)) for i, b in enumerate(bodies) for line in b.split("\n")[1:]}
    found = committed(spark, compact(files(spark, bodies, names), target=600, block_items=2))
    assert len(found.select("bin").distinct().collect()) > 5
    assert rows(found, "filename", "start_ms") == sorted(expected)


def test_a_file_per_bin_and_nearly_as_few_bins_as_possible(spark):
    rng = random.Random(5)
    names = {i: f"r{i % 90}.edf" for i in range(400)}
    bodies = ["\n".join([HEAD, *(f"{rng.randrange(1000)}.0,0,{i}" for _ in range(rng.randrange(1, 25)))]) for i in range(400)]
    path = compact(files(spark, bodies, names), target=6000)
    found = committed(spark, path).selectExpr("bin", "filename", "start_ms", "versions", "_metadata.file_name AS file").collect()
    assert len({(r.bin, r.file) for r in found}) == len({r.bin for r in found}) == len({r.file for r in found})
    assert sum(r.versions for r in found) == sum(b.count("\n") for b in bodies)
    least = -(-sum(len(b) for b in bodies) // 6000)
    assert least <= len({r.bin for r in found}) <= least * 11 / 9 + 1
    assert len({r.filename: r.bin for r in found}) == 90 and len({(r.filename, r.bin) for r in found}) == 90


def test_repeated_rows_null_ids_and_clashing_checksums(spark):
    day = dt.datetime(2025, 1, 1)
    body = f"{HEAD}\n0.0,0,1\n4.0,1,2"
    data = [(1, "p", "f.edf", body, day, 1, "x", 0)] * 3 + [(None, "p", "f.edf", body, day, 1, "x", 0), (None, None, "g.edf", body, None, None, None, None), (5, "p", None, body, day, 1, "x", 0), (1, "q", "g.edf", body, day, 2, "x", 0)]
    found = committed(spark, compact(spark.createDataFrame(data, SCHEMA)))
    assert rows(found, "filename", "start_ms", "label", "versions") == [("f.edf", 0, 0, 4), ("f.edf", 4000, 1, 4), ("g.edf", 0, 0, 2), ("g.edf", 4000, 1, 2)]


def test_lost_lines_aren_t_committed(spark, monkeypatch, tmp_path):
    real = compaction._route
    monkeypatch.setattr(compaction, "_route", lambda lines, plan: real(lines, plan).where("start_ms > 0"))
    with pytest.raises(compaction.CompactionError):
        compact(files(spark, [f"{HEAD}\n0.0,0,1\n4.0,0,1"]), root=str(tmp_path))
    assert not list(tmp_path.glob("commit-*"))


def test_changed_files_aren_t_committed(spark, tmp_path):
    source = str(tmp_path / "source")
    files(spark, [f"{HEAD}\n0.0,0,1\n4.0,0,1"]).write.parquet(source)
    real = compaction.bins

    def meanwhile(*args, **kwargs):
        out = real(*args, **kwargs)
        files(spark, [f"{HEAD}\n0.0,0,1\n4.0,0,7"]).write.mode("overwrite").parquet(source)
        return out

    compaction.bins = meanwhile
    try:
        with pytest.raises(Exception, match="changed|exist"):
            compact(spark.read.parquet(source), root=str(tmp_path))
    finally:
        compaction.bins = real
    assert not list(tmp_path.glob("commit-*"))


def test_target_bytes():
    assert compaction.target_bytes(0) == compaction.LEAST_BYTES
    assert compaction.target_bytes(1 << 30) == 1 << 24
    assert compaction.target_bytes(1 << 38) == compaction.MOST_BYTES
    assert -(-10**14 // compaction.target_bytes(10**14)) <= compaction.MOST_BINS


def test_empty_table(spark):
    assert committed(spark, compact(files(spark, []).where("false"))).count() == 0


def test_changed_checksum_isn_t_committed(spark, monkeypatch):
    monkeypatch.setattr(compaction, "_rename", lambda *a: (_ for _ in ()).throw(compaction.CompactionError("no")))
    with pytest.raises(compaction.CompactionError):
        compact(files(spark, [f"{HEAD}\n0.0,0,1"]))


def test_first_fit_decreasing():
    sizes = [4, 8, 1, 4, 2, 1]
    found = first_fit_decreasing(sizes, 10)
    load = {}
    for s, b in zip(sizes, found, strict=True):
        load[b] = load.get(b, 0) + s
    assert load == {0: 10, 1: 10}
    assert first_fit_decreasing([], 10) == []
    rng = random.Random(3)
    sizes = [rng.randrange(1, 60) for _ in range(500)]
    naive, room = [], []
    for s in sorted(sizes, reverse=True):
        i = next((i for i, r in enumerate(room) if r >= s), len(room))
        room += [100] if i == len(room) else []
        room[i] -= s
        naive.append(i)
    assert max(first_fit_decreasing(sizes, 100)) == max(naive)
