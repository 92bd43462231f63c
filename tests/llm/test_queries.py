"""Queries with SQL against DuckDB on the smallest tables, and their names."""

from types import SimpleNamespace

import pytest
from llm.queries import QUERIES

from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_duckdb(spark, name):
    run, sql = QUERIES[name]
    assert compare(spark, duck(SF), SimpleNamespace(run=run, sql=sql), SF) == ""


def test_each_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))
    assert "pipeline" in QUERIES
