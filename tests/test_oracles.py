"""Every registered query against its DuckDB oracle (the driver's gate, at sf 0.001)."""

import pytest

import __spark_entry__ as E
from hortus.plans import registry
from tests.conftest import SMALL
from tests.oracle_check import compare, duck

ORACLES, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, f"{name}: {msg}"


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["ordine", "codice", "nome", "unit_price", "quantita", "cumulative_price"]
    assert df.count() > 0
