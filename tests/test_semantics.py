from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillwave.operators.records import latest
from quillwave.semantics import fold_id, holds, millis, normal, prob_units, ratio
from tests.conftest import rows


def test_numbers(spark):
    df = spark.createDataFrame([(0.5,), (float("nan"),), (None,), (1.5,), (-0.1,), (0.20280000567,), (float("inf"),)], "p double")
    assert [r[0] for r in df.select(prob_units("p")).collect()] == [5000, None, None, None, None, 2028, None]
    assert [r[0] for r in df.select(millis("p")).collect()][:2] == [500, None]
    assert df.select(ratio(F.lit(1), F.lit(0)).alias("r"), holds(ratio(F.lit(1), F.lit(0)) >= 0.6).alias("h")).first() == (None, False)


def test_identifiers(spark):
    df = spark.createDataFrame([(" PT01 ",), ("",), (None,), ("\tx\n",)], "s string")
    assert [r[0] for r in df.select(normal("s")).collect()] == ["pt01", None, None, "x"]
    folds = spark.createDataFrame([("5fold", "fold3"), ("5fold", "3.0"), ("5fold", " 3"), ("5fold", "k13"), ("loo", "held out PT0042 "), ("5fold", "none")], "scheme string, fold string")
    assert [r[0] for r in folds.select(fold_id("scheme", "fold")).collect()] == ["3", "3", "3", "13", "pt0042", None]


def test_latest(spark):
    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([("a", t, 1), ("a", None, 9), ("a", t + dt.timedelta(1), None), ("b", None, 3), (None, t, 1), ("c", t, 1), ("c", t, 2)], "k string, at timestamp, v int")
    assert rows(latest(df, ["k"], ["at"], ["v"])) == [("a", None), ("b", 3), ("c", 2)]
