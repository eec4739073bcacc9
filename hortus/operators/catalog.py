"""Catalogue reports: R1 species search, R2 colourings, R9a species info, R18 current prices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.checks import first_failing, with_outcome
from hortus.functions.columns import flag_text, keep_keys, search_pattern

Tables = Mapping[str, DataFrame]


def current_prices(tables: Tables, species=None) -> DataFrame:
    """The open price (no end date) of each species."""
    p = keep_keys(tables["prices"], "specie_di_pianta", species)
    return p.filter(F.col("data_termine").isNull()).select("specie_di_pianta", "valore", "data_adozione")


def species_search(tables: Tables, fragment: str | None = None, flowering_only: bool = False) -> DataFrame:
    """Species whose common name contains ``fragment`` (any case), with the current price.

    ``None`` or ``''`` lists every species; ``%`` and ``_`` are wildcards.
    Flags are decoded to Indoor/Outdoor, Green/Flowery and Yes/No.
    """
    s = tables["species"]
    if flowering_only:
        s = s.filter(F.col("verde_or_fiorita") == 0)
    pattern = search_pattern(fragment)
    if pattern != "%":
        s = s.filter(F.upper(F.col("nome_comune")).like(pattern))
    p = current_prices(tables).select(F.col("specie_di_pianta").alias("codice"), "valore")
    j = s.join(p, "codice", "inner")
    return j.select(
        "codice", "nome_latino", "nome_comune",
        flag_text(F.col("interni_or_esterni"), "Indoor", "Outdoor").alias("indoor_outdoor"),
        flag_text(F.col("verde_or_fiorita"), "Green", "Flowery").alias("green_flowery"),
        flag_text(F.col("esotica_si_no"), "Yes", "No").alias("exotic"),
        F.col("valore").alias("prezzo"), F.col("giacenza"),
    ).orderBy("nome_comune", "codice")


def species_colourings(tables: Tables, species=None) -> DataFrame:
    """R2: colours of each flowering species, upper-cased."""
    c = keep_keys(tables["colourings"], "specie_fiorita", species)
    return c.select("specie_fiorita", F.upper(F.col("colore")).alias("colore"))


def species_info(tables: Tables, species=None) -> DataFrame:
    """Code, common and latin name of each species."""
    s = keep_keys(tables["species"], "codice", species)
    return s.select("codice", "nome_comune", "nome_latino")


def species_report_requests(tables: Tables, requests: DataFrame) -> DataFrame:
    """R9 as requested: species code -> the species row, or 45014 when unknown."""
    s = tables["species"].select("codice", "nome_comune", "nome_latino")
    r = requests.select("codice").join(s, "codice", "left")
    return with_outcome(r, first_failing((F.col("nome_comune").isNull(), codes.UNKNOWN_SPECIES)))
