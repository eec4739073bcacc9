"""Registered text operators against their DuckDB oracles, and all of them run."""

import pytest

from hortus.llm import queries
from tests.conftest import SMALL
from tests.oracle_check import compare, duck

TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "embeddings")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL, TABLES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(queries.QUERIES[name](spark, SMALL), con, queries.ORACLES[name])
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
