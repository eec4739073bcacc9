"""Packing reports: R7 plants still to pack, R8 pack contents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions.columns import display_name, keep_keys
from hortus.operators.totals import totals

Tables = Mapping[str, DataFrame]

SEMANTICS = ("intended", "reference")


def packed_per_line(tables: Tables, orders=None) -> DataFrame:
    """Packed quantity per (order, species): the kept total, or else aggregated map-side before the shuffle."""
    return keep_keys(totals(tables, "packed_totals"), "ordine", orders).select("ordine", "specie_di_pianta", F.col("somma").alias("packed"))


def packing_remaining(tables: Tables, orders=None, semantics: str = "intended") -> DataFrame:
    """Per order line, the ordered quantity and how much is already packed (0 if none).

    ``semantics="reference"`` reproduces the reference query, which joins pack
    contents on the species only and then keeps ``order = x OR order IS NULL``:
    a line survives when its species was packed for this order, or was never
    packed for any order.  It is computed here without the species-only join
    (whose size is lines x contents per species): the packed-anywhere species
    set is a left-semi/anti condition.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    lines = keep_keys(tables["order_lines"], "ordine", orders)
    packed = packed_per_line(tables, orders)
    j = lines.join(packed, ["ordine", "specie_di_pianta"], "left")
    if semantics == "reference":
        anywhere = totals(tables, "packed_totals").select("specie_di_pianta").distinct()
        never = j.join(anywhere, "specie_di_pianta", "left_anti")
        j = j.filter(F.col("packed").isNotNull()).unionByName(never)
    s = tables["species"].select("codice", "nome_comune", "nome_latino")
    out = j.join(s, j.specie_di_pianta == s.codice, "inner")
    return out.select(
        "ordine", "codice", display_name(F.col("nome_comune"), F.col("nome_latino")).alias("nome"),
        "quantita", F.coalesce(F.col("packed"), F.lit(0)).cast("long").alias("already_processed"))


def pack_contents_report(tables: Tables, orders=None) -> DataFrame:
    """Contents of every pack, by pack number."""
    c = keep_keys(tables["pack_contents"], "ordine", orders)
    s = tables["species"].select("codice", "nome_latino", "nome_comune")
    j = c.join(s, c.specie_di_pianta == s.codice, "inner")
    return (j.select("ordine", "pacco", "codice", "nome_latino", "nome_comune", "quantita")
             .orderBy("ordine", "pacco", "codice"))
