"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their DuckDB oracles.

Every query runs over the whole engine tables derived from ``sf_dir``; the jobs
run over request batches that Spark derives from the same tables
(``hortus.plans.requests``), so the work grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hortus.sources.testdata import TestdataTables, load_tables

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Callable[[dict[str, DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def register_source(name: str, oracle: str | None = None):
    """Like ``register``, for queries that also derive request batches: the
    function receives the ``TestdataTables`` source instead of the tables."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(TestdataTables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _QUERIES[name] = run
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def set_oracle(name: str, sql: str) -> None:
    """Attach an oracle to an already registered query (for oracles built after it)."""
    if name not in _QUERIES:
        raise KeyError(name)
    _ORACLES[name] = sql


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)


def _load_all() -> None:
    # Importing the catalogue modules registers their queries.
    from hortus.plans import batch_jobs, job_queries, report_queries  # noqa: F401
