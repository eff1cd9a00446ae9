from __future__ import annotations

import os

import pytest

from quillwave import session


def test_copies_are_deleted_when_nothing_needs_them(spark):
    table, seen = session.materialise(spark.range(5), "numbers", n=session_count())
    path = table.scratch.removeprefix("file://")
    assert seen == {"n": 5} and os.path.isdir(path)
    session.superseded(table)
    assert not os.path.exists(path)
    kept = session.materialise(spark.range(3), "numbers")
    assert session.clear_scratch(spark) >= 1 and not os.path.exists(kept.scratch.removeprefix("file://"))
    assert session.clear_scratch(spark) == 0


def session_count():
    from pyspark.sql import functions as F

    return F.count(F.lit(1))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())


def test_empty_tables_have_metrics_too(spark):
    assert session.materialise(spark.range(0), "none", n=session_count())[1] == {"n": 0}
