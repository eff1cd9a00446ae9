from __future__ import annotations

import random

from quillwave.operators.intervals import coverage
from tests.conftest import rows

SCHEMA = "k string, start_ms long, end_ms long, t int, delta string"


def brute(spans):
    """Periods and gaps by painting."""
    out = []
    for k in {s[0] for s in spans}:
        merged = []
        for a, b in sorted((a, b) for kk, a, b in spans if kk == k and a is not None and b is not None and a < b):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(k, "period", a, b) for a, b in merged]
        out += [(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or "", r[1:]))


def run(spark, spans, block):
    df = spark.createDataFrame([(*s, 1, "x") for s in spans], SCHEMA)
    found = rows(coverage(df, ["k"], "start_ms", "end_ms", block))
    return sorted(found, key=lambda r: (r[0] is None, r[0] or "", r[1:]))


def test_cases(spark):
    spans = [("a", 0, 10), ("a", 10, 20), ("a", 15, 18), ("a", 30, 40), ("a", 30, 40), ("b", 5, 5), ("b", 9, 3), ("c", None, 4), (None, 1, 2)]
    assert run(spark, spans, 1 << 20) == brute(spans)


def test_random_over_block_borders(spark):
    rng = random.Random(7)
    spans = [(rng.choice("xyz"), a := rng.randrange(400), a + rng.randrange(0, 12)) for _ in range(300)]
    for block in (1, 16, 1000):
        assert run(spark, spans, block) == brute(spans)


def test_empty(spark):
    assert run(spark, [], 16) == []
