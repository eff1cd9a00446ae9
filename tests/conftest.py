"""One local session for all tests, and helpers."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from quillwave.session import build_session

    session = build_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *order):
    """The rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, (list, dict)) else str(v)) for v in r))
