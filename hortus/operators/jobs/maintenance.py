"""Scheduled jobs as batch transformations: C20 restock, C21 retention."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.operators.jobs.base import JobResult, Tables, years_of
from hortus.operators.totals import count
from hortus.sources.snapshots import in_years

RETENTION_YEARS = 2


def _ts(value: dt.datetime | str):
    return F.lit(str(value)).cast("timestamp_ntz")


def years_before(now: dt.datetime, years: int) -> dt.datetime:
    """``now - INTERVAL n YEAR``: 29 February falls back to 28 February."""
    try:
        return now.replace(year=now.year - years)
    except ValueError:
        return now.replace(year=now.year - years, day=28)


def apply_restock(tables: Tables, now: dt.datetime) -> JobResult:
    """C20: add every pending request dated up to ``now`` to the stock and mark it delivered.

    One partial aggregate per species and one join replace the per-request
    update loop.  Requests dated after ``now`` stay pending and are not added
    (the same set is summed and marked).
    """
    req = tables["supply_requests"]
    due = (F.col("pendente_si_no") == 1) & (F.col("data") <= _ts(now))
    delivered = req.filter(due)
    added = delivered.groupBy(F.col("specie_richiesta").alias("codice")).agg(F.sum("quantita").alias("_added"))
    species = tables["species"]
    new_species = species.join(added, "codice", "left").select(
        *[(F.col("giacenza") + F.coalesce(F.col("_added"), F.lit(0))).cast("int").alias("giacenza")
          if c == "giacenza" else F.col(c) for c in species.columns])
    new_requests = req.withColumn("pendente_si_no", F.when(due, F.lit(0)).otherwise(F.col("pendente_si_no")))
    outcomes = delivered.select("data", "fornitore_scelto", "specie_richiesta", "quantita").withColumn(
        "esito", F.lit(codes.ACCEPTED)).withColumn("code", F.lit(None).cast("string")).withColumn(
        "reason", F.lit(None).cast("string"))
    return JobResult({"species": new_species, "supply_requests": new_requests}, outcomes,
                     {"added": added.withColumnRenamed("_added", "aggiunta")}, {"supply_requests": years_of(delivered, "data")})


def apply_retention(tables: Tables, now: dt.datetime, years: int = RETENTION_YEARS) -> JobResult:
    """Delete orders and supply requests dated more than ``years`` before ``now``,
    and prices closed before that; open prices stay whatever their age.

    An order's lines, packs and pack contents go with it (cascade as an
    anti join on the deleted order ids).  No stock is given back.  In a store kept
    by year the later years are neither read for this nor written.
    """
    last = years_before(now, years)
    cutoff = _ts(last)
    orders = tables["orders"]
    kept_orders = orders.filter(F.col("data") >= cutoff)
    # Only the years up to the cutoff's are read for what goes, and written again.
    old = in_years(tables, "orders", None, last.year).filter(F.col("data") < cutoff)
    gone = old.select(F.col("id").alias("ordine"))
    past = {"orders": years_of(old, "data"),
            "supply_requests": years_of(in_years(tables, "supply_requests", None, last.year).filter(F.col("data") < cutoff), "data")}
    past |= {t: past["orders"] for t in ("order_lines", "packs", "pack_contents")}
    out = {
        "orders": kept_orders,
        "order_lines": tables["order_lines"].join(gone, "ordine", "left_anti"),
        "packs": tables["packs"].join(gone, "ordine", "left_anti"),
        "pack_contents": tables["pack_contents"].join(gone, "ordine", "left_anti"),
        "supply_requests": tables["supply_requests"].filter(F.col("data") >= cutoff),
        "prices": tables["prices"].filter(F.col("data_termine").isNull() | (F.col("data_termine") >= cutoff)),
    }
    outcomes = gone.withColumn("esito", F.lit(codes.ACCEPTED)).withColumn(
        "code", F.lit(None).cast("string")).withColumn("reason", F.lit(None).cast("string"))
    # What goes is taken off the totals; those of an order go with it, by as much as they are.
    lapsed = in_years(tables, "supply_requests", None, last.year).filter(F.col("data") < cutoff)
    changes = {"request_totals": count(lapsed, "request_totals", -1)}
    for name in ("ordered_totals", "packed_totals"):
        if name in tables:
            changes[name] = tables[name].join(gone, "ordine", "left_semi").withColumns({"somma": -F.col("somma"), "righe": -F.col("righe")})
    return JobResult(out, outcomes, years=past, changes=changes)
