"""Customer and contact jobs: C6-C7 registration, C8 addresses, C9-C11 contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.checks import exists_in, first_failing, first_in_batch, missing, request_order, too_long, with_outcome
from hortus.operators.jobs.base import JobResult, Tables, in_sequence
from hortus.sources.schemas import CONTACT_TYPES

PRIVATE_CODE = codes.FISCAL_CODE
RETAIL_CODE = codes.VAT_NUMBER

CUSTOMER_REQUEST_COLS = ("ts", "seq", "codice", "nome", "residenza", "fatturazione")
RETAIL_REQUEST_COLS = (*CUSTOMER_REQUEST_COLS, "nome_ref", "cognome_ref")


def _register(tables: Tables, r: DataFrame, private: int) -> tuple[DataFrame, DataFrame]:
    """Shared checks of C6/C7: code shape against customer type, then duplicate code."""
    shape_private = F.col("codice").rlike(PRIVATE_CODE)
    shape_retail = F.col("codice").rlike(RETAIL_CODE)
    r = exists_in(r, tables["customers"], [("codice", "codice")], "_stored")
    mismatch = shape_retail if private == 1 else shape_private
    lengths = too_long(("codice", "customers", "codice"), ("nome", "customers", "nome"),
                       ("residenza", "customers", "indirizzo_residenza"),
                       ("fatturazione", "customers", "indirizzo_fatturazione"),
                       *([("nome_ref", "referents", "nome"), ("cognome_ref", "referents", "cognome")]
                         if "nome_ref" in r.columns else []))
    static = first_failing(
        (missing("codice") | lengths, codes.INVALID),
        (mismatch, codes.MISMATCH_TYPE),
        (~shape_private & ~shape_retail, codes.BAD_CUSTOMER_CODE),
        (F.col("_stored"), codes.CUSTOMER_EXISTS),
        (missing("residenza", "nome", *[c for c in ("nome_ref", "cognome_ref") if c in r.columns]), codes.INVALID))
    r = r.withColumn("_static", static)
    r = first_in_batch(r, ["codice"], F.col("_static").isNull(), "_taken")
    decided = with_outcome(r, F.coalesce(F.col("_static"), F.when(F.col("_taken"), F.lit(codes.CUSTOMER_EXISTS))))
    ok = decided.filter(F.col("code").isNull())
    new = ok.select("codice", "nome", F.col("residenza").alias("indirizzo_residenza"),
                    F.col("fatturazione").alias("indirizzo_fatturazione"),
                    F.lit(private).alias("privato_or_rivendita"), F.lit(None).cast("string").alias("contatto_preferito"))
    return decided, new


@in_sequence
def load_private_customers(tables: Tables, requests: DataFrame) -> JobResult:
    """Private customers; the code is upper-cased, must be a personal fiscal code
    (an 11-digit code is 45000, anything else 45001); already registered 45011."""
    r = requests.select(*CUSTOMER_REQUEST_COLS).withColumn("codice", F.upper(F.col("codice")))
    decided, new = _register(tables, r, 1)
    return JobResult({"customers": tables["customers"].unionByName(new)},
                     decided.select(*CUSTOMER_REQUEST_COLS, "code", "esito", "reason"))


@in_sequence
def load_retail_customers(tables: Tables, requests: DataFrame) -> JobResult:
    """Retailers with their referent; the code must have 11 digits (a fiscal code
    is 45000, anything else 45001); already registered 45011."""
    r = requests.select(*RETAIL_REQUEST_COLS)
    decided, new = _register(tables, r, 0)
    ok = decided.filter(F.col("code").isNull())
    refs = ok.select(F.col("codice").alias("rivendita"), F.col("nome_ref").alias("nome"),
                     F.col("cognome_ref").alias("cognome"), F.lit(None).cast("string").alias("contatto_preferito"))
    return JobResult({"customers": tables["customers"].unionByName(new),
                      "referents": tables["referents"].unionByName(refs)},
                     decided.select(*RETAIL_REQUEST_COLS, "code", "esito", "reason"))


@in_sequence
def update_addresses(tables: Tables, requests: DataFrame) -> JobResult:
    """Residence or billing address changes (ts, seq, cliente, tipo in
    {'residenza', 'fatturazione'}, indirizzo).

    Applied in order, so the latest request per customer and address kind wins
    (``max_by`` per key, no window).  Billing may become NULL; residence may
    not (``INVALID``).  An unknown customer is a no-op.
    """
    r = requests.select("ts", "seq", "cliente", "tipo", "indirizzo")
    r = exists_in(r, tables["customers"], [("cliente", "codice")], "_known")
    code = first_failing((missing("cliente", "tipo") | ~F.col("tipo").isin("residenza", "fatturazione")
                          | too_long(("indirizzo", "customers", "indirizzo_residenza")), codes.INVALID),
                         ((F.col("tipo") == "residenza") & F.col("indirizzo").isNull(), codes.INVALID))
    decided = with_outcome(r, code, noop=~F.col("_known"))
    ok = decided.filter(F.col("esito") == codes.ACCEPTED)
    latest = ok.groupBy("cliente").agg(
        F.max_by(F.struct(F.col("indirizzo").alias("v")), F.when(F.col("tipo") == "residenza", request_order()))
         .alias("_res"),
        F.max(F.when(F.col("tipo") == "residenza", request_order())).alias("_res_at"),
        F.max_by(F.struct(F.col("indirizzo").alias("v")), F.when(F.col("tipo") == "fatturazione", request_order()))
         .alias("_bill"),
        F.max(F.when(F.col("tipo") == "fatturazione", request_order())).alias("_bill_at"))
    c = tables["customers"]
    j = c.join(latest.withColumnRenamed("cliente", "codice"), "codice", "left")
    new = j.select(*[
        F.when(F.col("_res_at").isNotNull(), F.col("_res.v")).otherwise(F.col(x)).alias(x) if x == "indirizzo_residenza"
        else F.when(F.col("_bill_at").isNotNull(), F.col("_bill.v")).otherwise(F.col(x)).alias(x)
        if x == "indirizzo_fatturazione" else F.col(x) for x in c.columns])
    return JobResult({"customers": new}, decided.select("ts", "seq", "cliente", "tipo", "indirizzo", "code", "esito", "reason"))


_OWNERS = {
    "customer": ("customers", "codice", "customer_contacts", "cliente"),
    "referent": ("referents", "rivendita", "referent_contacts", "referente"),
}


@in_sequence
def add_contacts(tables: Tables, requests: DataFrame, kind: str = "customer") -> JobResult:
    """New contacts (ts, seq, owner, contatto, tipo) of customers or referents.

    Contacts are globally unique: stored or added earlier in the batch 45010.
    A type outside telefono / cellulare / email is ``INVALID``; an unknown
    owner ``UNKNOWN_KEY`` (the order system returns a bare key error).
    """
    owner_table, owner_key, own_table, own_col = _OWNERS[kind]
    r = requests.select("ts", "seq", "owner", "contatto", "tipo")
    r = exists_in(r, tables["contacts"], [("contatto", "valore")], "_stored")
    r = exists_in(r, tables[owner_table], [("owner", owner_key)], "_owner_known")
    static = first_failing((missing("owner", "contatto", "tipo") | ~F.col("tipo").isin(*CONTACT_TYPES)
                            | too_long(("contatto", "contacts", "valore")), codes.INVALID),
                           (F.col("_stored"), codes.CONTACT_EXISTS),
                           (~F.col("_owner_known"), codes.UNKNOWN_KEY))
    r = r.withColumn("_static", static)
    r = first_in_batch(r, ["contatto"], F.col("_static").isNull(), "_taken")
    # The duplicate contact is found on the first insert, before the owner.
    code = F.when(F.col("_static") == codes.INVALID, F.col("_static")) \
            .when(F.col("_taken"), F.lit(codes.CONTACT_EXISTS)).otherwise(F.col("_static"))
    decided = with_outcome(r, code)
    ok = decided.filter(F.col("code").isNull())
    return JobResult({
        "contacts": tables["contacts"].unionByName(ok.select(F.col("contatto").alias("valore"), "tipo")),
        own_table: tables[own_table].unionByName(ok.select("contatto", F.col("owner").alias(own_col))),
    }, decided.select("ts", "seq", "owner", "contatto", "tipo", "code", "esito", "reason"))


@in_sequence
def remove_contacts(tables: Tables, requests: DataFrame, kind: str = "customer") -> JobResult:
    """Remove contacts (ts, seq, owner, contatto).

    Not owned by that owner (or already removed earlier in the batch) 45009;
    used by an order 45012.  Otherwise the contact goes from both ownership
    tables and stops being anyone's preferred contact.
    """
    _, _, own_table, own_col = _OWNERS[kind]
    r = requests.select("ts", "seq", "owner", "contatto")
    r = exists_in(r, tables[own_table], [("owner", own_col), ("contatto", "contatto")], "_owned")
    r = exists_in(r, tables["orders"], [("contatto", "contatto")], "_used")
    r = first_in_batch(r, ["contatto"], F.col("_owned") & ~F.col("_used"), "_gone")
    code = first_failing((missing("owner", "contatto"), codes.INVALID),
                         (~F.col("_owned") | F.col("_gone"), codes.CONTACT_NOT_OWNED),
                         (F.col("_used"), codes.CONTACT_IN_USE))
    decided = with_outcome(r, code)
    gone = decided.filter(F.col("code").isNull()).select(F.col("contatto").alias("_c")).distinct()

    def unset(df: DataFrame) -> DataFrame:
        j = df.join(gone, df.contatto_preferito == gone._c, "left")
        return j.withColumn("contatto_preferito", F.when(F.col("_c").isNotNull(), F.lit(None).cast("string"))
                            .otherwise(F.col("contatto_preferito"))).drop("_c")

    return JobResult({
        "contacts": tables["contacts"].join(gone, tables["contacts"].valore == gone._c, "left_anti"),
        "customer_contacts": tables["customer_contacts"].join(gone, tables["customer_contacts"].contatto == gone._c, "left_anti"),
        "referent_contacts": tables["referent_contacts"].join(gone, tables["referent_contacts"].contatto == gone._c, "left_anti"),
        "customers": unset(tables["customers"]),
        "referents": unset(tables["referents"]),
    }, decided.select("ts", "seq", "owner", "contatto", "code", "esito", "reason"))


@in_sequence
def set_preferred_contacts(tables: Tables, requests: DataFrame, kind: str = "customer") -> JobResult:
    """C11: set the preferred contact (ts, seq, owner, contatto; NULL clears it).

    Unknown contact 45013; a contact not owned by this owner 45009 (checked
    for every change, also the first one).  Unknown owner: no-op.  The latest
    accepted request per owner wins.
    """
    owner_table, owner_key, own_table, own_col = _OWNERS[kind]
    r = requests.select("ts", "seq", "owner", "contatto")
    r = exists_in(r, tables[owner_table], [("owner", owner_key)], "_known")
    r = exists_in(r, tables["contacts"], [("contatto", "valore")], "_exists")
    r = exists_in(r, tables[own_table], [("owner", own_col), ("contatto", "contatto")], "_owned")
    code = first_failing((F.col("contatto").isNotNull() & ~F.col("_exists"), codes.CONTACT_UNKNOWN),
                         (F.col("contatto").isNotNull() & ~F.col("_owned"), codes.CONTACT_NOT_OWNED))
    decided = with_outcome(r.withColumn("_c", code), F.when(missing("owner"), F.lit(codes.INVALID)).when(F.col("_known"), F.col("_c")),
                           noop=~F.col("_known"))
    ok = decided.filter(F.col("esito") == codes.ACCEPTED)
    latest = ok.groupBy("owner").agg(F.max_by(F.struct(F.col("contatto").alias("v")), request_order()).alias("_new"))
    t = tables[owner_table]
    j = t.join(latest, t[owner_key] == latest.owner, "left")
    new = j.select(*[F.when(F.col("owner").isNotNull(), F.col("_new.v")).otherwise(F.col(x)).alias(x)
                     if x == "contatto_preferito" else F.col(x) for x in t.columns])
    return JobResult({owner_table: new}, decided.select("ts", "seq", "owner", "contatto", "code", "esito", "reason"))
