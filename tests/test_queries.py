"""Every registered query against DuckDB on the smallest tables."""

import pytest

from stockcount.plans import QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_matches_duckdb(spark, con, name):
    assert compare(spark, con, QUERIES[name], SF) == ""


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_returns_rows(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0
