"""Every registered core query against its SQL on whole tables; the others for their rows."""

from __future__ import annotations

import pytest

from quillwave.plans import registry
from tests.conftest import DATA
from tests.oracle import connect, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
QUERIES = {k: v for m in registry.MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in registry.MODULES for k, v in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, str(DATA)), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"rf_channel_rank", "model_scores", "paired_pools"}))  # these in test_learn.py
def test_has_rows(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.count() > 0, name
    assert len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).columns
