"""Supply reports: R10 low stock and top suppliers, R11-R13 suppliers, R16 addresses."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hortus.functions.columns import display_name, keep_keys, search_pattern
from hortus.operators.totals import totals

Tables = Mapping[str, DataFrame]

TOP_SUPPLIERS = 5
SEMANTICS = ("intended", "reference")


def low_stock_species(tables: Tables, n: int) -> DataFrame:
    """The ``n`` species with the least stock (ties by code).

    ``orderBy(...).limit(n)`` plans a ``TakeOrderedAndProject``: each task keeps
    its own top ``n`` and only those reach the driver.
    """
    s = tables["species"]
    return (s.orderBy("giacenza", "codice").limit(n)
             .select("codice", display_name(F.col("nome_comune"), F.col("nome_latino")).alias("nome"), "giacenza"))


def requests_per_offer(tables: Tables, species: DataFrame | None = None) -> DataFrame:
    """Requests made per (species, supplier): the kept total, or else partially aggregated
    before the shuffle; with ``species`` (specie_di_pianta) only theirs, cut before the aggregation."""
    if species is not None:
        asked = species.withColumnRenamed("specie_di_pianta", "specie_richiesta")
        tables = {t: tables[t].join(asked, "specie_richiesta", "left_semi") for t in ("request_totals", "supply_requests") if t in tables}
    return totals(tables, "request_totals").select(
        F.col("specie_richiesta").alias("specie_di_pianta"), F.col("fornitore_scelto").alias("fornitore"), F.col("righe").alias("n_richieste"))


def low_stock_top_suppliers(tables: Tables, n: int | None = None, semantics: str = "intended",
                            top: int = TOP_SUPPLIERS) -> DataFrame:
    """For each species (or the ``n`` with least stock), the ``top`` suppliers
    offering it with the most requests made; suppliers without requests count 0.

    Ties are broken by supplier code.  ``row_number() <= top`` plans a
    ``WindowGroupLimit`` that cuts each group before the window sort.

    ``semantics="reference"`` keeps the reference join on the supplier only with
    ``species = x OR species IS NULL``: an offer survives when its supplier has a
    request for that species, or has no request at all.  Computed as a left-anti
    join on suppliers with requests, not as the supplier-only join.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"semantics must be one of {SEMANTICS}")
    offers = tables["availability"]
    low = None
    if n is not None:
        low = low_stock_species(tables, n).select(F.col("codice").alias("specie_di_pianta"))
        offers = offers.join(low, "specie_di_pianta", "left_semi")
    counts = requests_per_offer(tables, low)
    j = offers.join(counts, ["specie_di_pianta", "fornitore"], "left")
    if semantics == "reference":
        active = totals(tables, "request_totals").select(F.col("fornitore_scelto").alias("fornitore")).distinct()
        idle = j.filter(F.col("n_richieste").isNull()).join(active, "fornitore", "left_anti")
        j = j.filter(F.col("n_richieste").isNotNull()).unionByName(idle)
    j = j.withColumn("n_richieste", F.coalesce(F.col("n_richieste"), F.lit(0)).cast("long"))
    w = Window.partitionBy("specie_di_pianta").orderBy(F.col("n_richieste").desc(), F.col("fornitore"))
    ranked = j.withColumn("posizione", F.row_number().over(w)).filter(F.col("posizione") <= top)
    sup = tables["suppliers"].select(F.col("codice_fornitore").alias("fornitore"), F.col("nome").alias("nome_fornitore"))
    return ranked.join(sup, "fornitore", "inner").select(
        "specie_di_pianta", "posizione", "fornitore", "nome_fornitore", "n_richieste")


def supplier_search(tables: Tables, fragment: str | None = None) -> DataFrame:
    """Suppliers whose name contains ``fragment`` (any case), newest code first."""
    s = tables["suppliers"]
    pattern = search_pattern(fragment)
    if pattern != "%":
        s = s.filter(F.upper(F.col("nome")).like(pattern))
    return s.select("codice_fornitore", "codice_fiscale", "nome").orderBy(F.col("codice_fornitore").desc())


def supplier_species(tables: Tables, suppliers=None) -> DataFrame:
    """Species each supplier can supply, by common name."""
    a = keep_keys(tables["availability"], "fornitore", suppliers)
    s = tables["species"].select("codice", "nome_latino", "nome_comune")
    j = a.join(s, a.specie_di_pianta == s.codice, "inner")
    return j.select("fornitore", "codice", "nome_latino", "nome_comune").orderBy("fornitore", "nome_comune", "codice")


def pending_supply_requests(tables: Tables, species=None) -> DataFrame:
    """Pending requests per species with the supplier name, newest first."""
    r = keep_keys(tables["supply_requests"], "specie_richiesta", species).filter(F.col("pendente_si_no") == 1)
    s = tables["suppliers"].select("codice_fornitore", F.col("nome").alias("nome_fornitore"))
    j = r.join(s, r.fornitore_scelto == s.codice_fornitore, "inner")
    return (j.select("specie_richiesta", F.to_date("data").alias("data"), "codice_fornitore", "nome_fornitore",
                     "quantita", F.col("data").alias("_ts"))
             .orderBy(F.col("specie_richiesta"), F.col("_ts").desc(), F.col("codice_fornitore"))
             .drop("_ts"))


def supplier_address_list(tables: Tables, suppliers=None) -> DataFrame:
    """Addresses of each supplier, upper-cased."""
    a = keep_keys(tables["supplier_addresses"], "fornitore", suppliers)
    return a.select("fornitore", F.upper(F.col("indirizzo")).alias("indirizzo"))
