from __future__ import annotations

import random

from quillwave.llm.collapse import collapse_runs, merge_neighbours
from quillwave.llm.cutoffs import cutoffs, histogram, keep
from tests.conftest import rows


def brute_cutoff(scores, permille):
    for x in sorted(set(scores), reverse=True):
        if sum(s >= x for s in scores) * 1000 >= len(scores) * permille:
            return x
    return None


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(11)
    shapes = [lambda: rng.randrange(10_001), lambda: int(rng.random() ** 8 * 10_000), lambda: rng.choice([0, 10_000]), lambda: 5000, lambda: min(10_000, int(rng.expovariate(0.01)))]
    data, targets, want = [], [], []
    for i in range(40):
        scores = [rng.choice(shapes[i % 5 : i % 5 + 2] or shapes)() for _ in range(rng.choice([1, 2, 7, 60, 400]))]
        permille = rng.choice([0, 1, 20, 125, 500, 999, 1000])
        data += [(f"s{i}", s, "x") for s in scores]
        targets.append((f"s{i}", permille))
        c = brute_cutoff(scores, permille)
        want.append((f"s{i}", len(scores), c, sum(s >= c for s in scores)))  # kept counts ties
    records = spark.createDataFrame(data, "src string, score int, cutoff string")
    found = cutoffs(histogram(records, ["src"], "score"), spark.createDataFrame(targets, "src string, keep_permille int"), ["src"])
    assert rows(found, "src", "n", "cutoff", "kept") == sorted(want)


def test_hot_source_and_missing_values(spark):
    data = [("hot", i % 997, i) for i in range(5000)] + [("cold", None, 1), (None, 5, 1), ("untargeted", 7, 1)]
    records = spark.createDataFrame(data, "src string, score int, n int")
    targets = spark.createDataFrame([("hot", 100), ("cold", 100), ("absent", 5), ("untargeted", None)], "src string, keep_permille int")
    kept, found = keep(records, targets, ["src"], "score")
    c = brute_cutoff([i % 997 for i in range(5000)], 100)
    assert rows(found, "src", "cutoff") == [("hot", c)]
    assert kept.columns == records.columns and kept.count() == sum(i % 997 >= c for i in range(5000))


def test_fractional_scores_and_clashing_names(spark):
    import pytest

    data = [(f"a{i % 2}", i / 10, 1) for i in range(20)] + [("a0", float("nan"), 1), ("a1", None, 1), (None, 0.5, 1)]
    for name in ("s", "n", "k", "x", "w", "a", "b", "cutoff", "_w", "lo"):
        records = spark.createDataFrame(data, f"`{name}` string, score double, kept int")
        targets = spark.createDataFrame([("a0", 300), ("a1", 1000)], f"`{name}` string, keep_permille int")
        kept, found = keep(records, targets, [name], "score", scale=10)
        assert rows(kept) == [("a0", x, 1) for x in (1.4, 1.6, 1.8)] + [("a1", i / 10, 1) for i in range(1, 20, 2)]
        assert found.count() == 2
    with pytest.raises(Exception, match="whole number"):
        keep(records, targets, [name], "score")[0].count()


def test_huge_range_takes_few_rounds(spark, monkeypatch):
    from quillwave.llm import cutoffs as module

    rng = random.Random(7)
    data = [("a", rng.randrange(10**12)) for _ in range(3000)] + [("b", int(rng.expovariate(1e-9))) for _ in range(2000)]
    rounds, real = [], module._cut
    monkeypatch.setattr(module, "_cut", lambda *a: rounds.append(1) or real(*a))
    found = cutoffs(histogram(spark.createDataFrame(data, "src string, score long"), ["src"], "score"), spark.createDataFrame([("a", 333), ("b", 20)], "src string, keep_permille int"), ["src"])
    assert rows(found, "src", "cutoff") == [(s, brute_cutoff([x for k, x in data if k == s], p)) for s, p in (("a", 333), ("b", 20))]
    assert len(rounds) <= 8


def test_no_records(spark):
    records = spark.createDataFrame([], "src string, score int")
    kept, found = keep(records, spark.createDataFrame([("a", 5)], "src string, keep_permille int"), ["src"], "score")
    assert kept.count() == found.count() == 0


def test_merge_neighbours_takes_the_nearest_first():
    import numpy as np

    heads, tails = merge_neighbours(np.array([3, -1, 0, 0, 5, -1]))
    assert heads.tolist() == [0, 2, 6] and tails.tolist() == [1, 5, 6]
    assert [x.tolist() for x in merge_neighbours(np.array([], int))] == [[0], [0]]


def brute_means(values, apart):
    """Merges the neighbouring runs with the nearest means first, as plainly as possible; values a NULL apart never merge."""
    runs = [[i, i, v, 1] for i, v in enumerate(values)]
    while True:
        near = [(abs(a[2] / a[3] - b[2] / b[3]), i) for i, (a, b) in enumerate(zip(runs, runs[1:], strict=False)) if abs(values[a[1]] - values[b[0]]) <= apart and abs(a[2] / a[3] - b[2] / b[3]) <= apart]
        if not near:
            return [(a, b) for a, b, *_ in runs]
        _, i = min(near)
        a, b = runs[i : i + 2]
        runs[i : i + 2] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]


def test_mean_linkage_equals_brute_force_and_depends_on_the_order_of_merges(spark):
    rng = random.Random(21)
    drift = list(range(0, 200, 4))
    cases = {"drift": drift, "walk": [100]}
    for _ in range(150):
        cases["walk"].append(cases["walk"][-1] + rng.randrange(-9, 10))
    for i in range(12):
        cases[f"r{i}"] = [rng.randrange(30) for _ in range(40)]
    df = spark.createDataFrame([(k, t, x) for k, v in cases.items() for t, x in enumerate(v)], "k string, t int, x int")
    got = collapse_runs(df, ["k"], "t", "x", 10, 4, linkage="mean")
    want = sorted((k, a, b, sum(v[a : b + 1])) for k, v in cases.items() for a, b in brute_means(v, 10))
    assert rows(got, "k", "first", "last", "x_sum") == want
    assert len([w for w in want if w[0] == "drift"]) > 1  # one touching run, several levels
    assert rows(collapse_runs(df.where("k = 'drift'"), ["k"], "t", "x", 10, 4), "first", "last") == [(0, 49)]


def test_mean_linkage_in_blocks_covers_every_event_once(spark):
    rng = random.Random(22)
    df = spark.createDataFrame([("a", t, rng.choice([None, *range(40)])) for t in range(500)], "k string, t int, x int")
    for block in (7, 64):
        got = sorted(collapse_runs(df, ["k"], "t", "x", 10, 4, block, "mean").select("first", "last", "n").collect())
        assert [r.first for r in got] == [0, *[r.last + 1 for r in got[:-1]]] and got[-1].last == 499 and all(r.n == r.last - r.first + 1 for r in got)


def brute_runs(events, apart, gap):
    out = []
    for k in {e[0] for e in events if e[0] is not None}:
        run = []
        for _, t, x in sorted((e for e in events if e[0] == k and e[1] is not None), key=lambda e: (e[1], e[2] is not None, e[2] or 0)):
            if run and x is not None and run[-1][1] is not None and abs(x - run[-1][1]) <= apart and t - run[-1][0] <= gap:
                run.append((t, x))
            else:
                out += [(k, run[0][0], run[-1][0], len(run))] if run else []
                run = [(t, x)]
        out += [(k, run[0][0], run[-1][0], len(run))] if run else []
    return sorted(out)


def test_runs_equal_brute_force_across_blocks(spark):
    rng = random.Random(4)
    events = [(rng.choice(["a", "b", "hot", "hot", "hot"]), t * rng.choice([1, 1, 3]), rng.choice([None, *range(0, 40, 4)])) for t in range(600)]
    events = list({(k, t): (k, t, x) for k, t, x in events}.values()) + [(None, 1, 1), ("a", None, 1)]
    df = spark.createDataFrame([(*e, 7) for e in events], "k string, t int, x int, block int")
    for block in (1, 5, 64, 1 << 22):
        got = collapse_runs(df, ["k"], "t", "x", 10, 4, block)
        assert rows(got, "k", "first", "last", "n") == brute_runs(events, 10, 4)


def test_repeated_places_and_empty(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 0, 5), ("a", 0, 90)], "k string, t int, x int")
    assert rows(collapse_runs(df, ["k"], "t", "x", 10, 4), "first", "n", "x_last") == [(0, 1, 90), (0, 2, 5)]
    assert collapse_runs(df.where("false"), ["k"], "t", "x", 10, 4).count() == 0
