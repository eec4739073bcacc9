"""Run one job or report over a snapshot store, as ``spark-submit`` would.

    python -m hortus.run job line_changes --store ROOT --requests PATH --outcomes PATH [--finalizations PATH]
    python -m hortus.run job restock --store ROOT --now "2024-01-01 00:00:00" --outcomes PATH
    python -m hortus.run report order_status --store ROOT --out PATH
    python -m hortus.run report order_report_requests --store ROOT --requests PATH --out PATH
    python -m hortus.run report customer_orders --store ROOT --out PATH --set open_only=true --set 'customers=["A"]'

A job reads the latest version of the store, writes the tables (and years) it
changed, commits them with the unchanged ones as the next version, and writes its per-request outcomes to
``--outcomes``; its further outputs (emptied orders, outcomes of the
finalizations) go to folders beside it, ``<outcomes>-<name>``.  A report writes
its rows to ``--out``; its keys, fragments, flags and n are given by ``--set``.  The session comes from
the environment (``spark-submit`` configuration); the checkpoint folder is the
session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json

from pyspark.sql import SparkSession

from hortus.operators import catalog, contacts, orders, packing, sales, supply
from hortus.operators.jobs import catalog as jcat
from hortus.operators.jobs import customers as jcus
from hortus.operators.jobs import maintenance as jmain
from hortus.operators.jobs import orders as jord
from hortus.operators.jobs import packs as jpack
from hortus.operators.jobs import prices as jprice
from hortus.operators.jobs import suppliers as jsup
from hortus.operators.totals import TOTALS, recount
from hortus.session import ensure_semantics
from hortus.sources.requests import read_requests
from hortus.sources.snapshots import is_yearly, read_snapshot, versions, write_snapshot

# job name -> (request kind, function(tables, requests))
JOBS = {
    "price_changes": ("price_changes", jprice.apply_price_changes),
    "new_species": ("new_species", jcat.load_species),
    "species_removals": ("species_removals", jcat.remove_species),
    "add_colours": ("colours", jcat.add_colourings),
    "remove_colours": ("colours", jcat.remove_colourings),
    "private_customers": ("private_customers", jcus.load_private_customers),
    "retail_customers": ("retail_customers", jcus.load_retail_customers),
    "addresses": ("addresses", jcus.update_addresses),
    "add_customer_contacts": ("contacts", lambda t, r: jcus.add_contacts(t, r, "customer")),
    "add_referent_contacts": ("contacts", lambda t, r: jcus.add_contacts(t, r, "referent")),
    "remove_customer_contacts": ("contacts", lambda t, r: jcus.remove_contacts(t, r, "customer")),
    "remove_referent_contacts": ("contacts", lambda t, r: jcus.remove_contacts(t, r, "referent")),
    "preferred_customer_contacts": ("contacts", lambda t, r: jcus.set_preferred_contacts(t, r, "customer")),
    "preferred_referent_contacts": ("contacts", lambda t, r: jcus.set_preferred_contacts(t, r, "referent")),
    "new_orders": ("new_orders", jord.open_orders),
    "line_changes": ("line_changes", jord.apply_order_line_changes),
    "finalize": ("finalizations", jord.finalize_orders),
    "suppliers": ("suppliers", jsup.load_suppliers),
    "supplier_addresses": ("supplier_addresses", jsup.add_supplier_addresses),
    "availability": ("availability", jsup.add_availability),
    "supply_requests": ("supply_requests", jsup.load_supply_requests),
    "packing": ("packing", jpack.allocate_packs),
}

REPORTS = {
    "species_search": catalog.species_search, "species_colourings": catalog.species_colourings,
    "species_info": catalog.species_info, "current_prices": catalog.current_prices,
    "customer_orders": orders.customer_orders, "order_report_header": orders.order_report_header,
    "order_report_lines": orders.order_report_lines, "order_report_totals": orders.order_report_totals,
    "order_species": orders.order_species, "order_status": orders.order_status,
    "packing_remaining": packing.packing_remaining, "pack_contents_report": packing.pack_contents_report,
    "low_stock_species": supply.low_stock_species,  # n is the caller's: --set n=10
    "low_stock_top_suppliers": supply.low_stock_top_suppliers, "supplier_search": supply.supplier_search,
    "supplier_species": supply.supplier_species, "pending_supply_requests": supply.pending_supply_requests,
    "supplier_address_list": supply.supplier_address_list, "customer_contact_list": contacts.customer_contact_list,
    "referent_contact_list": contacts.referent_contact_list, "contact_owners": contacts.contact_owners,
}

# Reports asked for by request files: name -> (request kind, function(tables, requests)).
ASKED = {
    "order_report_requests": ("finalizations", orders.order_report_requests),
    "species_report_requests": ("species_removals", catalog.species_report_requests),
}


RANGE_ROWS_JOBS = ("new_orders", "line_changes")


def create_store(tables, store: str) -> None:
    """Version 1 of a store: the tables and the totals kept beside them."""
    write_snapshot({**tables, **recount(tables)}, store, 1)


def run_job(spark: SparkSession, name: str, store: str, outcomes_path: str, requests: str | None = None,
            now: dt.datetime | None = None, finalizations: str | None = None,
            range_rows: int | None = None) -> int:
    """Apply one job to the latest version of ``store``; returns the new version number.

    ``range_rows`` (new orders, line changes): most requests of one species that
    one fold goes through.
    """
    tables = read_snapshot(spark, store)
    if name == "restock":
        result = jmain.apply_restock(tables, now)
    elif name == "retention":
        result = jmain.apply_retention(tables, now)
    else:
        kind, fn = JOBS[name]
        batch = read_requests(spark, requests, kind)
        extra = {"range_rows": range_rows} if range_rows is not None and name in RANGE_ROWS_JOBS else {}
        if name == "line_changes" and finalizations:
            result = fn(tables, batch, read_requests(spark, finalizations, "finalizations"), **extra)
        else:
            result = fn(tables, batch, **extra)
    version = (versions(spark, store) or [0])[-1] + 1
    changed, years = result.changed(tables), dict(result.years)
    for total, (table, _, _) in TOTALS.items():
        if total in changed and table in years and is_yearly(total):
            years[total] = years[table]
    write_snapshot(changed, store, version, years)
    result.outcomes.write.mode("errorifexists").parquet(outcomes_path)
    for output, rows in result.extra.items():
        rows.write.mode("errorifexists").parquet(f"{outcomes_path}-{output}")
    return version


def report_args(settings: list[str]) -> dict:
    """NAME=VALUE pairs as keyword arguments of a report; a value is JSON where it parses as such."""
    out = {}
    for s in settings:
        name, _, value = s.partition("=")
        try:
            out[name] = json.loads(value)
        except json.JSONDecodeError:
            out[name] = value
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="hortus.run")
    p.add_argument("what", choices=["job", "report"])
    p.add_argument("name")
    p.add_argument("--store", required=True)
    p.add_argument("--requests")
    p.add_argument("--finalizations")
    p.add_argument("--outcomes")
    p.add_argument("--out")
    p.add_argument("--now", type=dt.datetime.fromisoformat)
    p.add_argument("--year", type=int)
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    p.add_argument("--range-rows", type=int, dest="range_rows")
    a = p.parse_args(argv)
    spark = ensure_semantics(SparkSession.builder.appName(f"hortus-{a.name}").getOrCreate())
    if a.what == "job":
        run_job(spark, a.name, a.store, a.outcomes, a.requests, a.now, a.finalizations, a.range_rows)
    else:
        tables = read_snapshot(spark, a.store)
        if a.name == "species_monthly_sales":
            df = sales.species_monthly_sales(tables, a.year)
        elif a.name in ASKED:
            kind, fn = ASKED[a.name]
            df = fn(tables, read_requests(spark, a.requests, kind))
        else:
            df = REPORTS[a.name](tables, **report_args(a.set))
        df.write.mode("errorifexists").parquet(a.out)


if __name__ == "__main__":
    main()
