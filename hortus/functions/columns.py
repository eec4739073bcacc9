"""Column helpers shared by the reports and jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_TOTAL = T.DecimalType(18, 2)

# English month names of the monthly sales report, January first.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December")


def display_name(common: Column, latin: Column) -> Column:
    """``common (latin)``, the species label of the order reports."""
    return F.concat(common, F.lit(" ("), latin, F.lit(")"))


def flag_text(flag: Column, when_one: str, when_zero: str) -> Column:
    return F.when(flag == 1, F.lit(when_one)).otherwise(F.lit(when_zero))


def true_or_false(cond: Column) -> Column:
    """SQL three-valued logic collapsed the way the order system reads it: NULL is false."""
    return F.coalesce(cond, F.lit(False))


def search_pattern(fragment: str | None) -> str:
    """LIKE pattern for a name search; ``None`` and ``''`` both match everything.

    ``%`` and ``_`` inside the fragment keep acting as wildcards.
    """
    if fragment is None or fragment == "":
        return "%"
    return f"%{fragment.upper()}%"


def keep_keys(df: DataFrame, column: str, keys: Iterable | None) -> DataFrame:
    """Filter a report to some keys (pushed to the parquet scan); ``None`` keeps all."""
    if keys is None:
        return df
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    if isinstance(keys, (str, int)):
        keys = [keys]
    return df.filter(F.col(column).isin(list(keys)))
