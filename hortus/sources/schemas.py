"""Explicit schemas of the engine tables and of the request batches.

Nothing is inferred: every loader casts to these types.  Keys and maximum
string lengths are kept next to the schema so the loaders can check them.
"""

from __future__ import annotations

from pyspark.sql import types as T

INT = T.IntegerType()
LONG = T.LongType()
STR = T.StringType()
TS = T.TimestampNTZType()
PRICE = T.DecimalType(7, 2)


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


TABLES: dict[str, T.StructType] = {
    "species": _schema(
        ("codice", INT, False), ("nome_latino", STR, False), ("nome_comune", STR, False),
        ("interni_or_esterni", INT, False), ("verde_or_fiorita", INT, False),
        ("esotica_si_no", INT, False), ("giacenza", INT, False)),
    "prices": _schema(
        ("specie_di_pianta", INT, False), ("data_adozione", TS, False),
        ("valore", PRICE, False), ("data_termine", TS, True)),
    "colourings": _schema(("specie_fiorita", INT, False), ("colore", STR, False)),
    "customers": _schema(
        ("codice", STR, False), ("nome", STR, False), ("indirizzo_residenza", STR, False),
        ("indirizzo_fatturazione", STR, True), ("privato_or_rivendita", INT, False),
        ("contatto_preferito", STR, True)),
    "referents": _schema(
        ("rivendita", STR, False), ("nome", STR, False), ("cognome", STR, False),
        ("contatto_preferito", STR, True)),
    "contacts": _schema(("valore", STR, False), ("tipo", STR, False)),
    "customer_contacts": _schema(("contatto", STR, False), ("cliente", STR, False)),
    "referent_contacts": _schema(("contatto", STR, False), ("referente", STR, False)),
    "orders": _schema(
        ("id", INT, False), ("cliente", STR, False), ("data", TS, False),
        ("aperto_or_finalizzato", INT, False), ("indirizzo_spedizione", STR, False),
        ("contatto", STR, False)),
    "order_lines": _schema(("ordine", INT, False), ("specie_di_pianta", INT, False), ("quantita", INT, False)),
    "packs": _schema(("ordine", INT, False), ("numero", INT, False)),
    "pack_contents": _schema(
        ("ordine", INT, False), ("pacco", INT, False), ("specie_di_pianta", INT, False),
        ("quantita", INT, False)),
    "suppliers": _schema(("codice_fornitore", INT, False), ("codice_fiscale", STR, False), ("nome", STR, False)),
    "supplier_addresses": _schema(("indirizzo", STR, False), ("fornitore", INT, False)),
    "availability": _schema(("specie_di_pianta", INT, False), ("fornitore", INT, False)),
    "supply_requests": _schema(
        ("data", TS, False), ("fornitore_scelto", INT, False), ("specie_richiesta", INT, False),
        ("quantita", INT, False), ("pendente_si_no", INT, False)),
}

# Primary keys (the unique columns a load job must keep unique).
KEYS: dict[str, tuple[str, ...]] = {
    "species": ("codice",),
    "prices": ("specie_di_pianta", "data_adozione"),
    "colourings": ("specie_fiorita", "colore"),
    "customers": ("codice",),
    "referents": ("rivendita",),
    "contacts": ("valore",),
    "customer_contacts": ("contatto",),
    "referent_contacts": ("contatto",),
    "orders": ("id",),
    "order_lines": ("ordine", "specie_di_pianta"),
    "packs": ("ordine", "numero"),
    "pack_contents": ("ordine", "pacco", "specie_di_pianta"),
    "suppliers": ("codice_fornitore",),
    "supplier_addresses": ("indirizzo",),
    "availability": ("specie_di_pianta", "fornitore"),
    "supply_requests": ("data", "fornitore_scelto", "specie_richiesta"),
}

# Totals kept beside the tables (``operators.totals``): sum of the quantities and number of the rows per key.
TOTAL_TABLES: dict[str, T.StructType] = {
    "ordered_totals": _schema(("ordine", INT, False), ("somma", LONG, False), ("righe", LONG, False)),
    "packed_totals": _schema(("ordine", INT, False), ("specie_di_pianta", INT, False), ("somma", LONG, False), ("righe", LONG, False)),
    "request_totals": _schema(("specie_richiesta", INT, False), ("fornitore_scelto", INT, False), ("somma", LONG, False),
                              ("righe", LONG, False)),
}

# Maximum lengths of the string columns in the order system.
MAX_LENGTH: dict[tuple[str, str], int] = {
    ("species", "nome_latino"): 64,
    ("species", "nome_comune"): 64,
    ("colourings", "colore"): 32,
    ("customers", "codice"): 16,
    ("customers", "nome"): 32,
    ("customers", "indirizzo_residenza"): 64,
    ("customers", "indirizzo_fatturazione"): 64,
    ("referents", "nome"): 32,
    ("referents", "cognome"): 32,
    ("contacts", "valore"): 256,
    ("orders", "indirizzo_spedizione"): 64,
    ("suppliers", "codice_fiscale"): 16,
    ("suppliers", "nome"): 32,
    ("supplier_addresses", "indirizzo"): 64,
}

# The three contact types.
CONTACT_TYPES = ("telefono", "cellulare", "email")


# Schemas of the generated test tables the engine tables are derived from
# (read with these, never inferred).
RAW_TABLES: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", INT, True), ("r_name", STR, True)),
    "nation": _schema(("n_nationkey", INT, True), ("n_name", STR, True), ("n_regionkey", INT, True)),
    "customer": _schema(("c_custkey", LONG, True), ("c_name", STR, True), ("c_nationkey", INT, True),
                        ("c_acctbal", T.DoubleType(), True), ("c_mktsegment", STR, True)),
    "supplier": _schema(("s_suppkey", LONG, True), ("s_name", STR, True), ("s_nationkey", INT, True),
                        ("s_acctbal", T.DoubleType(), True)),
    "part": _schema(("p_partkey", LONG, True), ("p_name", STR, True), ("p_brand", STR, True), ("p_type", STR, True),
                    ("p_size", INT, True), ("p_retailprice", T.DoubleType(), True)),
    "orders": _schema(("o_orderkey", LONG, True), ("o_custkey", LONG, True), ("o_orderstatus", STR, True),
                      ("o_totalprice", T.DoubleType(), True), ("o_orderdate", TS, True),
                      ("o_orderpriority", STR, True)),
    "lineitem": _schema(("l_orderkey", LONG, True), ("l_partkey", LONG, True), ("l_suppkey", LONG, True),
                        ("l_linenumber", INT, True), ("l_quantity", T.DoubleType(), True),
                        ("l_extendedprice", T.DoubleType(), True), ("l_discount", T.DoubleType(), True),
                        ("l_tax", T.DoubleType(), True), ("l_returnflag", STR, True), ("l_linestatus", STR, True),
                        ("l_shipdate", TS, True)),
}


# Request batches of the change jobs (read with these schemas, never inferred).
_TS_SEQ = (("ts", TS, False), ("seq", LONG, False))
REQUESTS: dict[str, T.StructType] = {
    "price_changes": _schema(*_TS_SEQ, ("specie_di_pianta", INT, False), ("valore", PRICE, True)),
    "new_species": _schema(*_TS_SEQ, ("nome_comune", STR, False), ("nome_latino", STR, False),
                           ("interni_or_esterni", INT, False), ("colore", STR, True), ("esotica_si_no", INT, False),
                           ("giacenza", INT, False), ("prezzo", PRICE, True)),
    "species_removals": _schema(*_TS_SEQ, ("codice", INT, False)),
    "colours": _schema(*_TS_SEQ, ("specie_fiorita", INT, False), ("colore", STR, False)),
    "private_customers": _schema(*_TS_SEQ, ("codice", STR, False), ("nome", STR, True), ("residenza", STR, True),
                                 ("fatturazione", STR, True)),
    "retail_customers": _schema(*_TS_SEQ, ("codice", STR, False), ("nome", STR, True), ("residenza", STR, True),
                                ("fatturazione", STR, True), ("nome_ref", STR, True), ("cognome_ref", STR, True)),
    "addresses": _schema(*_TS_SEQ, ("cliente", STR, False), ("tipo", STR, False), ("indirizzo", STR, True)),
    "contacts": _schema(*_TS_SEQ, ("owner", STR, False), ("contatto", STR, True), ("tipo", STR, True)),
    "new_orders": _schema(*_TS_SEQ, ("cliente", STR, False), ("indirizzo_spedizione", STR, True),
                          ("contatto", STR, True), ("specie_di_pianta", INT, False), ("quantita", INT, True)),
    "line_changes": _schema(*_TS_SEQ, ("op", STR, False), ("cliente", STR, False), ("ordine", INT, False),
                            ("specie_di_pianta", INT, False), ("quantita", INT, True)),
    "finalizations": _schema(*_TS_SEQ, ("cliente", STR, False), ("ordine", INT, False)),
    "suppliers": _schema(*_TS_SEQ, ("codice_fiscale", STR, False), ("nome", STR, True),
                         ("specie_di_pianta", INT, False), ("indirizzo", STR, True)),
    "supplier_addresses": _schema(*_TS_SEQ, ("fornitore", INT, False), ("indirizzo", STR, True)),
    "availability": _schema(*_TS_SEQ, ("fornitore", INT, False), ("specie_di_pianta", INT, False)),
    "supply_requests": _schema(*_TS_SEQ, ("fornitore", INT, False), ("specie_di_pianta", INT, False),
                               ("quantita", INT, True)),
    "packing": _schema(*_TS_SEQ, ("ordine", INT, False), ("pacco", INT, True), ("new_pack", STR, True),
                       ("specie_di_pianta", INT, False), ("quantita", INT, True)),
}
