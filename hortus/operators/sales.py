"""Monthly sales of each species over the finalized orders of one year."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions.columns import MONTH_NAMES, keep_keys
from hortus.sources.snapshots import in_years

Tables = Mapping[str, DataFrame]


def species_monthly_sales(tables: Tables, year: int, species=None) -> DataFrame:
    """Twelve rows per species, months with no sale filled with 0.

    The sales are one ``groupBy(species, month)`` over the finalized orders of
    ``year``: the year filter reaches the orders scan, and in a store kept by year
    only that year's orders and lines are read.  The 12-month calendar
    is generated inside each species row with ``explode(sequence(1, 12))``, so
    there is no cross join; the left join is on (species, month).
    """
    start = F.lit(f"{year:04d}-01-01 00:00:00").cast("timestamp_ntz")
    end = F.lit(f"{year + 1:04d}-01-01 00:00:00").cast("timestamp_ntz")
    o = in_years(tables, "orders", year, year).filter((F.col("aperto_or_finalizzato") == 0)
                                & (F.col("data") >= start) & (F.col("data") < end))
    lines = keep_keys(in_years(tables, "order_lines", year, year), "specie_di_pianta", species)
    sold = (lines.join(o.select("id", F.month("data").alias("mese")), lines.ordine == o.id, "inner")
                 .groupBy(F.col("specie_di_pianta").alias("codice"), "mese")
                 .agg(F.sum("quantita").alias("vendite")))
    calendar = keep_keys(tables["species"], "codice", species).select(
        "codice", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("mese"))
    months = F.array(*[F.lit(m) for m in MONTH_NAMES])
    j = calendar.join(sold, ["codice", "mese"], "left")
    return j.select("codice", "mese", F.element_at(months, F.col("mese")).alias("nome_mese"),
                    F.coalesce(F.col("vendite"), F.lit(0)).cast("long").alias("vendite"))
