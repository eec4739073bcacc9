"""Catalogue jobs: C2 load species, C3 remove species, C4 add colours, C5 remove colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.checks import exists_in, first_failing, first_in_batch, missing, too_long, with_outcome
from hortus.functions.sequence import max_key, number_in_order
from hortus.operators.jobs.base import JobResult, Tables, in_sequence
from hortus.sources.schemas import PRICE

SPECIES_REQUEST_COLS = ("ts", "seq", "nome_comune", "nome_latino", "interni_or_esterni", "colore",
                        "esotica_si_no", "giacenza", "prezzo")


def _flag_ok(c: str):
    return F.col(c).isin(0, 1)


@in_sequence
def load_species(tables: Tables, requests: DataFrame) -> JobResult:
    """New species with their opening price and, when a colour is given, first colour.

    No colour means a green species, a colour a flowering one.  Codes, in
    order: negative stock ``INVALID``; a flag outside {0, 1} 45022; latin name
    stored or taken earlier in the batch 45021; negative price ``INVALID``.
    New codes are ``max(codice) + 1, 2 ...`` in request order.
    """
    r = requests.select(*SPECIES_REQUEST_COLS).withColumn("prezzo", F.col("prezzo").cast(PRICE))
    r = exists_in(r, tables["species"], [("nome_latino", "nome_latino")], "_stored")
    # Order of checks: stock value, the flags trigger, the unique latin name
    # (stored, then taken earlier in the batch), then the opening price row.
    pre = first_failing(
        (missing("nome_comune", "nome_latino", "interni_or_esterni", "esotica_si_no", "giacenza") | (F.col("giacenza") < 0)
         | too_long(("nome_comune", "species", "nome_comune"), ("nome_latino", "species", "nome_latino"),
                    ("colore", "colourings", "colore")), codes.INVALID),
        (~_flag_ok("interni_or_esterni") | ~_flag_ok("esotica_si_no"), codes.BAD_FLAG),
        (F.col("_stored"), codes.SPECIES_EXISTS))
    post = first_failing((F.col("prezzo").isNull() | (F.col("prezzo") < 0), codes.INVALID))
    r = r.withColumn("_pre", pre).withColumn("_post", post)
    r = first_in_batch(r, ["nome_latino"], F.col("_pre").isNull() & F.col("_post").isNull(), "_taken")
    code = F.coalesce(F.col("_pre"), F.when(F.col("_taken"), F.lit(codes.SPECIES_EXISTS)), F.col("_post"))
    decided = with_outcome(r, code)
    ok = decided.filter(F.col("code").isNull())
    numbered = number_in_order(ok, ["ts", "seq"], max_key(tables["species"], "codice"), "codice")
    species_cols = tables["species"].columns
    new_species = numbered.select(
        "codice", "nome_latino", "nome_comune", "interni_or_esterni",
        F.when(F.col("colore").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("verde_or_fiorita"),
        "esotica_si_no", "giacenza")
    new_prices = numbered.select(F.col("codice").alias("specie_di_pianta"), F.col("ts").alias("data_adozione"),
                                 F.col("prezzo").alias("valore"), F.lit(None).cast("timestamp_ntz").alias("data_termine"))
    new_colours = numbered.filter(F.col("colore").isNotNull()).select(
        F.col("codice").alias("specie_fiorita"), "colore")
    outcomes = decided.select(*SPECIES_REQUEST_COLS, "code", "esito", "reason").join(
        numbered.select("ts", "seq", "codice"), ["ts", "seq"], "left")
    return JobResult({
        "species": tables["species"].unionByName(new_species.select(*species_cols)),
        "prices": tables["prices"].unionByName(new_prices),
        "colourings": tables["colourings"].unionByName(new_colours),
    }, outcomes)


@in_sequence
def remove_species(tables: Tables, requests: DataFrame) -> JobResult:
    """Remove species (ts, seq, codice).

    Unknown species: no effect.  A species still in order lines, pack contents
    or supply requests is refused with 45029 (even if only a supply request
    holds it).  Otherwise it goes with its prices, colours and availability.
    """
    r = requests.select("ts", "seq", "codice")
    r = exists_in(r, tables["species"], [("codice", "codice")], "_known")
    held = (tables["order_lines"].select(F.col("specie_di_pianta").alias("k"))
            .unionByName(tables["pack_contents"].select(F.col("specie_di_pianta").alias("k")))
            .unionByName(tables["supply_requests"].select(F.col("specie_richiesta").alias("k"))))
    r = exists_in(r, held, [("codice", "k")], "_held")
    r = first_in_batch(r, ["codice"], F.col("_known") & ~F.col("_held"), "_gone")
    decided = with_outcome(r, first_failing((missing("codice"), codes.INVALID),
                                            (F.col("_known") & F.col("_held"), codes.SPECIES_IN_USE)),
                           noop=~F.col("_known") | F.col("_gone"))
    removed = decided.filter(F.col("esito") == codes.ACCEPTED).select("codice").distinct()
    out = {
        "species": tables["species"].join(removed, "codice", "left_anti"),
        "prices": tables["prices"].join(removed.withColumnRenamed("codice", "specie_di_pianta"), "specie_di_pianta", "left_anti"),
        "colourings": tables["colourings"].join(removed.withColumnRenamed("codice", "specie_fiorita"), "specie_fiorita", "left_anti"),
        "availability": tables["availability"].join(removed.withColumnRenamed("codice", "specie_di_pianta"), "specie_di_pianta", "left_anti"),
    }
    return JobResult(out, decided.select("ts", "seq", "codice", "code", "esito", "reason"))


@in_sequence
def add_colourings(tables: Tables, requests: DataFrame) -> JobResult:
    """C4: add colours (ts, seq, specie_fiorita, colore).

    Green species 45019 (the trigger runs first), unknown species 45014,
    colour already present or added earlier in the batch 45030.
    """
    r = requests.select("ts", "seq", "specie_fiorita", "colore")
    s = tables["species"].select(F.col("codice").alias("specie_fiorita"), F.col("verde_or_fiorita").alias("_green"))
    r = r.join(s, "specie_fiorita", "left")
    r = exists_in(r, tables["colourings"], [("specie_fiorita", "specie_fiorita"), ("colore", "colore")], "_present")
    static = first_failing((missing("specie_fiorita", "colore") | too_long(("colore", "colourings", "colore")), codes.INVALID),
                           (F.col("_green") == 1, codes.GREEN_NO_COLOUR),
                           (F.col("_green").isNull(), codes.UNKNOWN_SPECIES),
                           (F.col("_present"), codes.COLOUR_EXISTS))
    r = r.withColumn("_static", static)
    r = first_in_batch(r, ["specie_fiorita", "colore"], F.col("_static").isNull(), "_taken")
    decided = with_outcome(r, F.coalesce(F.col("_static"), F.when(F.col("_taken"), F.lit(codes.COLOUR_EXISTS))))
    ok = decided.filter(F.col("code").isNull()).select("specie_fiorita", "colore")
    return JobResult({"colourings": tables["colourings"].unionByName(ok)},
                     decided.select("ts", "seq", "specie_fiorita", "colore", "code", "esito", "reason"))


@in_sequence
def remove_colourings(tables: Tables, requests: DataFrame) -> JobResult:
    """Remove colours (ts, seq, specie_fiorita, colore); a missing colour is a no-op."""
    r = requests.select("ts", "seq", "specie_fiorita", "colore")
    r = exists_in(r, tables["colourings"], [("specie_fiorita", "specie_fiorita"), ("colore", "colore")], "_present")
    r = first_in_batch(r, ["specie_fiorita", "colore"], F.col("_present"), "_gone")
    decided = with_outcome(r, first_failing((missing("specie_fiorita", "colore"), codes.INVALID)),
                           noop=~F.col("_present") | F.col("_gone"))
    removed = decided.filter(F.col("esito") == codes.ACCEPTED).select("specie_fiorita", "colore").distinct()
    return JobResult({"colourings": tables["colourings"].join(removed, ["specie_fiorita", "colore"], "left_anti")},
                     decided.select("ts", "seq", "specie_fiorita", "colore", "code", "esito", "reason"))
