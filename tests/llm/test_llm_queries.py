from __future__ import annotations

import pytest

from quillwave.llm import queries
from tests.conftest import DATA
from tests.oracle import connect, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    same(queries.QUERIES[name](spark, str(DATA)), con, queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0
