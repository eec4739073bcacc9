"""Contact reports: R14 customer contacts, R15 referent contacts, R17 contact owners."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions.columns import keep_keys

Tables = Mapping[str, DataFrame]


def customer_contact_list(tables: Tables, customers=None) -> DataFrame:
    """Contacts owned by each customer, with their type."""
    own = keep_keys(tables["customer_contacts"], "cliente", customers)
    c = tables["contacts"]
    return own.join(c, own.contatto == c.valore, "inner").select("cliente", "contatto", "tipo")


def referent_contact_list(tables: Tables, referents=None) -> DataFrame:
    """Contacts owned by each referent, with their type."""
    own = keep_keys(tables["referent_contacts"], "referente", referents)
    c = tables["contacts"]
    return own.join(c, own.contatto == c.valore, "inner").select("referente", "contatto", "tipo")


def contact_owners(tables: Tables, contacts=None) -> DataFrame:
    """Each contact with its customer owner and/or referent owner (NULL when none)."""
    c = keep_keys(tables["contacts"], "valore", contacts).select("valore")
    cc = tables["customer_contacts"].select(F.col("contatto").alias("valore"), "cliente")
    rc = tables["referent_contacts"].select(F.col("contatto").alias("valore"), "referente")
    return c.join(cc, "valore", "left").join(rc, "valore", "left").select(
        F.col("valore").alias("contatto"), "cliente", "referente")
