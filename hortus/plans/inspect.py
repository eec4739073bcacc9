"""Plan inspection helpers: what Catalyst and AQE chose, as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame) -> str:
    """The physical plan (before runtime re-planning) as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df: DataFrame) -> str:
    """The plan after running the query, with AQE's runtime choices."""
    df.collect()  # this DataFrame's own execution: a write would run, and re-plan, a copy
    return df._jdf.queryExecution().executedPlan().toString()


def has_operator(df: DataFrame, name: str) -> bool:
    return name in physical_plan(df)
