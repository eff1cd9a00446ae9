from __future__ import annotations

import datetime as dt
import random

import numpy as np

from quillwave.llm import splits
from quillwave.llm.components import components
from tests.conftest import rows

DAY = dt.datetime(2025, 1, 1)


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    star = [("hub", f"leaf{i}") for i in range(50)]
    loose = [(f"r{rng.randrange(60)}", f"r{rng.randrange(60)}") for _ in range(40)]
    edges = [*chain, *star, *loose, ("self", "self"), (None, "x"), *chain[:3], ("leaf1", "hub")]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "u string, v string"))
    assert rows(got) == brute(edges)
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def recordings(spark, data):
    return spark.createDataFrame(data, "subject string, filename string, duration_sec double, content_md5 string, n_seizures int, is_monopolar boolean, component string")


def links(spark, data):
    return spark.createDataFrame(data, "link_id long, subject_id string, related_id string, status string, noted_at timestamp_ntz")


def test_relations(spark):
    h, z = "a" * 32, "b" * 32
    rec = recordings(spark, [("P1", "1", 5.0, h.upper(), 0, False, "x"), ("p2 ", "2", 5.0, h, 0, False, "x"), ("p3", "3", 0.0, h, 0, False, "x"), ("p4", "4", 5.0, "n/a", 0, False, "x"), ("p5", "5", 5.0, None, 0, None, None), ("p6", "6", 5.0, z, 0, False, "x"), (None, "7", 5.0, z, 0, False, "x")])
    lk = links(spark, [
        (1, "p4", "P5", "confirmed", DAY), (2, "p5", "p4", "Withdrawn", DAY + dt.timedelta(1)), (3, "p6", "p7", "withdrawn", DAY), (4, "p7", " p6", "CONFIRMED ", DAY + dt.timedelta(1)),
        (5, "p8", "p8", "confirmed", DAY), (6, "p9", None, "confirmed", DAY), (7, "q1", "q2", "withdrawn", DAY), (8, "q2", "q1", "confirmed", DAY),
    ])
    assert rows(splits.relations(rec, lk)) == [("p1", "p2"), ("p6", "p7"), ("q1", "q2")]
    assert rows(splits.related_subjects(rec.where("false"), lk.where("false"))) == []


def test_splits_keep_components_whole_and_meet_shares(spark):
    rng = random.Random(9)
    data = [(f"s{i}", f"{i}-{j}", 100.0 * j, None, rng.randrange(2), i % 7 == 0, "x") for i in range(150) for j in range(1 + (i % 6))]
    data += data[:10] + [("big", f"b{j}", 10.0, None, 1, False, None) for j in range(60)] + [(None, "n", 1.0, None, 0, False, None), ("s1", None, None, None, None, None, None)]
    lk = links(spark, [(i, f"s{i}", f"s{i + 1}", "confirmed", DAY) for i in range(0, 60, 3)])
    shares = spark.createDataFrame([("Train ", 700), ("validation", 150), ("test", 150)], "split string, share_permille int")
    found = splits.grouped_splits(recordings(spark, data), lk, shares)
    got = found.collect()
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, set()).add(r.split)
    assert all(len(s) == 1 for s in by_component.values())
    assert len(got) == len({(r.subject_id, r.filename) for r in got}) == len({(a, b) for a, b, *_ in data if a})
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "validation", "test")}
    assert abs(share["train"] - 0.7) < 0.05 and abs(share["test"] - 0.15) < 0.03  # one component has a tenth of the records
    blocks = splits.assign(splits.label_vectors(recordings(spark, data), splits.related_subjects(recordings(spark, data), lk)), shares, block_components=20)
    assert blocks.count() == len(by_component)


def test_place_shares_out_the_rare_label():
    vectors = np.array([[1, 4]] * 10 + [[0, 4]] * 90)
    found = splits.place(vectors, [f"c{i}" for i in range(100)], np.array([0.5, 0.3, 0.2]))
    assert np.bincount(found[:10]).tolist() == [5, 3, 2] and np.bincount(found).tolist() == [50, 30, 20]
    assert len(splits.place(np.zeros((0, 2), int), [], np.array([1.0]))) == 0


def test_shares_are_alike_at_every_size_of_block(spark):
    rng = random.Random(12)
    rare = [(f"r{i:03}", 1, 0, 0, 0, 1) for i in range(100)]
    other = [(f"c{i:04}", 0, int(rng.random() < 0.2), int(rng.random() < 0.1), rng.randrange(3), 0) for i in range(900)]
    data = rare + [(c, a, b, x, y, max(b, x, y) + rng.randrange(1, 4)) for c, a, b, x, y, _ in other]
    vectors = spark.createDataFrame(data, "component string, " + ", ".join(f"{k} long" for k in splits.LABELS))
    shares = spark.createDataFrame([("train", 800), ("validation", 100), ("test", 100)], "split string, share_permille int")
    largest = {k: max(r[i + 1] for r in data) for i, k in enumerate(splits.LABELS)}
    for block in (20, 100, 100_000):
        got = splits.assign(vectors, shares, block_components=block).collect()
        assert sorted(r.component for r in got) == sorted(r[0] for r in data)
        to = {r.component: r.split for r in got}
        for i, k in enumerate(splits.LABELS):
            total = sum(r[i + 1] for r in data)
            for s, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
                n = sum(r[i + 1] for r in data if to[r[0]] == s)
                assert abs(n - share * total) <= largest[k] or (k not in ("seizures", "records") and abs(n - share * total) <= 0.05 * total), (block, k, s, n, share * total)


def test_one_block_equals_placing_in_one_go(spark):
    rng = random.Random(3)
    data = [(f"c{i:03}", rng.randrange(2), rng.randrange(2), 0, rng.randrange(4), rng.randrange(1, 9)) for i in range(200)]
    vectors = spark.createDataFrame(data, "component string, " + ", ".join(f"{k} long" for k in splits.LABELS))
    shares = spark.createDataFrame([("a", 500), ("b", 300), ("c", 200)], "split string, share_permille int")
    found = splits.place(np.array([r[1:] for r in data]), [r[0] for r in data], np.array([0.5, 0.3, 0.2]))
    assert rows(splits.assign(vectors, shares)) == sorted((r[0], "abc"[s]) for r, s in zip(data, found.tolist(), strict=True))


def test_empty_tables(spark):
    shares = spark.createDataFrame([("a", 500), ("b", 500)], "split string, share_permille int")
    vectors = spark.createDataFrame([], "component string, " + ", ".join(f"{k} long" for k in splits.LABELS))
    assert splits.assign(vectors, shares).count() == 0


def test_parted(spark):
    plans = spark.createDataFrame([
        (1, "5fold", '{"fold_0": ["A", "b+c"], "1": ["d", "a "]}'), (1, "5fold", '{"fold_0": ["A", "b+c"], "1": ["d", "a "]}'), (2, "5fold", '{"0": ["a"], "fold 0": ["d"], "1": ["z"]}'),
        (3, "5fold", None), (4, "5fold", "no json"), (5, "loo", '{"held PT1": ["b"], "pt1 ": ["d"], "pt2": ["e"]}'),
    ], "plan_id long, scheme string, folds string")
    related = spark.createDataFrame([(x, "b") for x in ("b", "d", "x")], "node string, component string")
    assert rows(splits.parted(plans, related)) == [(1, "a", "a"), (1, "b", "d")]
    assert rows(splits.torn(plans, related)) == [(1, "a", 1, 2), (1, "b", 2, 2)]
