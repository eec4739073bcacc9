"""Totals kept beside the tables they sum up: ordered, packed and requested, maintained by each job's changes.

R6, R7 and R10b need sums over all order lines, pack contents and supply requests.
Kept as tables of their own, these change by what a job added and took away, so
neither the reports nor the jobs go through the facts again.  Every total counts
the rows it stands for: with a row taken away it is retracted, and at no rows it goes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.sources.schemas import TOTAL_TABLES

Tables = Mapping[str, DataFrame]

#: Name -> (table, keys of the total, quantity summed or None).
TOTALS: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "ordered_totals": ("order_lines", ("ordine",), "quantita"),
    "packed_totals": ("pack_contents", ("ordine", "specie_di_pianta"), "quantita"),
    "request_totals": ("supply_requests", ("specie_richiesta", "fornitore_scelto"), "quantita"),
}


def count(rows: DataFrame, name: str, sign: int = 1) -> DataFrame:
    """The total called ``name`` over ``rows`` of its table; with ``sign`` -1 what they take away from it."""
    _, keys, quantity = TOTALS[name]
    return rows.groupBy(*keys).agg((F.sum(F.col(quantity).cast("long")) * sign).alias("somma"), (F.count(F.lit(1)) * sign).alias("righe"))


def totals(tables: Tables, name: str) -> DataFrame:
    """The kept total where the tables have it, else counted from its table."""
    return tables[name] if name in tables else count(tables[TOTALS[name][0]], name)


def recount(tables: Tables) -> dict[str, DataFrame]:
    """All totals, from the tables."""
    return {name: count(tables[table], name) for name, (table, _, _) in TOTALS.items()}


def maintained(kept: DataFrame, name: str, change: DataFrame) -> DataFrame:
    """``kept`` after ``change`` (keys, somma, righe: signed sums of what came and went).

    Only the totals of the changed keys are added up again; the others pass through the anti join."""
    keys = list(TOTALS[name][1])
    change = change.select(*keys, "somma", "righe")
    met = kept.join(change.select(*keys).distinct(), keys, "left_semi").unionByName(change)
    met = met.groupBy(*keys).agg(F.sum("somma").alias("somma"), F.sum("righe").alias("righe")).filter("righe <> 0")
    return kept.join(change.select(*keys).distinct(), keys, "left_anti").unionByName(met).select(*TOTAL_TABLES[name].fieldNames())


def after(tables: Tables, changes: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The kept totals that a job's ``changes`` (``JobResult.changes``) touch, as they are after it."""
    return {name: maintained(tables[name], name, change) for name, change in changes.items() if name in tables}
