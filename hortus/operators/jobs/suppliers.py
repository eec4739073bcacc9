"""Supplier jobs: C15 load suppliers, C16 addresses, C17 availability, C18 supply requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.checks import earliest_unique, exists_in, first_failing, first_in_batch, missing, too_long, with_outcome
from hortus.functions.sequence import max_key, number_in_order
from hortus.operators.jobs.base import JobResult, Tables, in_sequence, years_of
from hortus.operators.totals import count

SUPPLIER_REQUEST_COLS = ("ts", "seq", "codice_fiscale", "nome", "specie_di_pianta", "indirizzo")


@in_sequence
def load_suppliers(tables: Tables, requests: DataFrame) -> JobResult:
    """New suppliers with their first species and first address.

    Codes in order: fiscal code not of the expected shape 45023; fiscal code
    (upper-cased) already stored 45035; unknown species ``UNKNOWN_KEY``;
    address already used 45035.  Within the batch the earliest request wins
    both the fiscal code and the address (resolved exactly, see
    ``earliest_unique``).  New codes are ``max + 1, 2 ...`` in request order.
    """
    r = requests.select(*SUPPLIER_REQUEST_COLS)
    r = (r.withColumn("_shape_ok", F.coalesce(F.col("codice_fiscale").rlike(codes.FISCAL_CODE), F.lit(False)))
          .withColumn("codice_fiscale", F.upper(F.col("codice_fiscale"))))
    r = exists_in(r, tables["suppliers"], [("codice_fiscale", "codice_fiscale")], "_code_stored")
    r = exists_in(r, tables["species"], [("specie_di_pianta", "codice")], "_species_known")
    r = exists_in(r, tables["supplier_addresses"], [("indirizzo", "indirizzo")], "_addr_stored")
    static = first_failing((missing("nome") | too_long(
                                ("codice_fiscale", "suppliers", "codice_fiscale"), ("nome", "suppliers", "nome"),
                                ("indirizzo", "supplier_addresses", "indirizzo")), codes.INVALID),
                           (~F.col("_shape_ok"), codes.BAD_FISCAL_CODE),
                           (F.col("_code_stored"), codes.SUPPLIER_EXISTS),
                           (~F.col("_species_known"), codes.UNKNOWN_KEY),
                           (F.col("_addr_stored") | F.col("indirizzo").isNull(), codes.SUPPLIER_EXISTS))
    r = r.withColumn("_static", static)
    r = earliest_unique(r, [["codice_fiscale"], ["indirizzo"]], F.col("_static").isNull(), "_taken")
    decided = with_outcome(r, F.coalesce(F.col("_static"), F.when(F.col("_taken"), F.lit(codes.SUPPLIER_EXISTS))))
    ok = decided.filter(F.col("code").isNull())
    numbered = number_in_order(ok.select("ts", "seq", "codice_fiscale", "nome", "specie_di_pianta", "indirizzo"),
                               ["ts", "seq"], max_key(tables["suppliers"], "codice_fornitore"), "codice_fornitore")
    return JobResult({
        "suppliers": tables["suppliers"].unionByName(numbered.select("codice_fornitore", "codice_fiscale", "nome")),
        "availability": tables["availability"].unionByName(
            numbered.select("specie_di_pianta", F.col("codice_fornitore").alias("fornitore"))),
        "supplier_addresses": tables["supplier_addresses"].unionByName(
            numbered.select("indirizzo", F.col("codice_fornitore").alias("fornitore"))),
    }, decided.select(*SUPPLIER_REQUEST_COLS, "code", "esito", "reason").join(
        numbered.select("ts", "seq", "codice_fornitore"), ["ts", "seq"], "left"))


@in_sequence
def add_supplier_addresses(tables: Tables, requests: DataFrame) -> JobResult:
    """Addresses (ts, seq, fornitore, indirizzo): unknown supplier 45032 (the
    foreign key is checked first), address already used 45031."""
    r = requests.select("ts", "seq", "fornitore", "indirizzo")
    r = exists_in(r, tables["suppliers"], [("fornitore", "codice_fornitore")], "_known")
    r = exists_in(r, tables["supplier_addresses"], [("indirizzo", "indirizzo")], "_stored")
    static = first_failing((missing("fornitore") | too_long(("indirizzo", "supplier_addresses", "indirizzo")), codes.INVALID),
                           (~F.col("_known"), codes.UNKNOWN_SUPPLIER), (F.col("_stored"), codes.ADDRESS_EXISTS),
                           (F.col("indirizzo").isNull(), codes.INVALID))
    r = first_in_batch(r.withColumn("_static", static), ["indirizzo"], F.col("_static").isNull(), "_taken")
    decided = with_outcome(r, F.coalesce(F.col("_static"), F.when(F.col("_taken"), F.lit(codes.ADDRESS_EXISTS))))
    ok = decided.filter(F.col("code").isNull()).select("indirizzo", "fornitore")
    return JobResult({"supplier_addresses": tables["supplier_addresses"].unionByName(ok)},
                     decided.select("ts", "seq", "fornitore", "indirizzo", "code", "esito", "reason"))


@in_sequence
def add_availability(tables: Tables, requests: DataFrame) -> JobResult:
    """C17: species a supplier offers (ts, seq, fornitore, specie_di_pianta): unknown
    supplier or species 45025, already offered 45018."""
    r = requests.select("ts", "seq", "fornitore", "specie_di_pianta")
    r = exists_in(r, tables["suppliers"], [("fornitore", "codice_fornitore")], "_sup")
    r = exists_in(r, tables["species"], [("specie_di_pianta", "codice")], "_spe")
    r = exists_in(r, tables["availability"], [("fornitore", "fornitore"), ("specie_di_pianta", "specie_di_pianta")],
                  "_stored")
    static = first_failing((missing("fornitore", "specie_di_pianta"), codes.INVALID),
                           (~F.col("_sup") | ~F.col("_spe"), codes.UNKNOWN_SUPPLIER_OR_SPECIES),
                           (F.col("_stored"), codes.AVAILABILITY_EXISTS))
    r = first_in_batch(r.withColumn("_static", static), ["fornitore", "specie_di_pianta"],
                       F.col("_static").isNull(), "_taken")
    decided = with_outcome(r, F.coalesce(F.col("_static"), F.when(F.col("_taken"), F.lit(codes.AVAILABILITY_EXISTS))))
    ok = decided.filter(F.col("code").isNull()).select("specie_di_pianta", "fornitore")
    return JobResult({"availability": tables["availability"].unionByName(ok)},
                     decided.select("ts", "seq", "fornitore", "specie_di_pianta", "code", "esito", "reason"))


@in_sequence
def load_supply_requests(tables: Tables, requests: DataFrame) -> JobResult:
    """Supply requests (ts, seq, fornitore, specie_di_pianta, quantita), dated ``ts``.

    A pair the supplier does not offer (unknown supplier or species included)
    45024; the same (time, supplier, species) stored or earlier in the batch
    ``DUPLICATE``; a negative quantity ``INVALID``.  Accepted requests are pending.
    """
    r = requests.select("ts", "seq", "fornitore", "specie_di_pianta", "quantita")
    r = exists_in(r, tables["availability"], [("fornitore", "fornitore"), ("specie_di_pianta", "specie_di_pianta")],
                  "_offered")
    r = exists_in(r, tables["supply_requests"], [("ts", "data"), ("fornitore", "fornitore_scelto"),
                                                 ("specie_di_pianta", "specie_richiesta")], "_stored")
    static = first_failing((missing("fornitore", "specie_di_pianta", "quantita") | (F.col("quantita") < 0), codes.INVALID),
                           (~F.col("_offered"), codes.NOT_OFFERED),
                           (F.col("_stored"), codes.DUPLICATE))
    r = first_in_batch(r.withColumn("_static", static), ["ts", "fornitore", "specie_di_pianta"],
                       F.col("_static").isNull(), "_taken")
    decided = with_outcome(r, F.coalesce(F.col("_static"), F.when(F.col("_taken"), F.lit(codes.DUPLICATE))))
    ok = decided.filter(F.col("code").isNull()).select(
        F.col("ts").alias("data"), F.col("fornitore").alias("fornitore_scelto"),
        F.col("specie_di_pianta").alias("specie_richiesta"), "quantita", F.lit(1).alias("pendente_si_no"))
    return JobResult({"supply_requests": tables["supply_requests"].unionByName(ok)},
                     decided.select("ts", "seq", "fornitore", "specie_di_pianta", "quantita", "code", "esito", "reason"),
                     years={"supply_requests": years_of(ok, "data")}, changes={"request_totals": count(ok, "request_totals")})
