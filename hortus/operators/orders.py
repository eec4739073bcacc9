"""Order reports: R3 customer orders, R4 order report, R5 order species, R6 status.

Every report runs over all orders at once; the optional key arguments narrow
it, and the filter reaches the parquet scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.asof import as_of, quarter, quarterly
from hortus.functions.checks import first_failing, with_outcome
from hortus.functions.columns import LINE_TOTAL, display_name, flag_text, keep_keys, true_or_false
from hortus.operators.totals import totals

Tables = Mapping[str, DataFrame]


def customer_orders(tables: Tables, customers=None, open_only: bool = False) -> DataFrame:
    """Orders of each customer, newest first; status only in the all-orders form."""
    o = keep_keys(tables["orders"], "cliente", customers)
    if open_only:
        o = o.filter(F.col("aperto_or_finalizzato") == 1)
    cols = [F.col("cliente"), F.col("id").alias("ordine"), F.col("indirizzo_spedizione"),
            F.to_date("data").alias("data")]
    if not open_only:
        cols.append(flag_text(F.col("aperto_or_finalizzato"), "Open", "Finalized").alias("stato"))
    return (o.select(*cols, F.col("data").alias("_ts"))
            .orderBy(F.col("cliente"), F.col("_ts").desc(), F.col("ordine"))
            .drop("_ts"))


def _referent_label(tables: Tables) -> DataFrame:
    """Customer code -> referent column of the order headers."""
    c = tables["customers"].select("codice", "privato_or_rivendita")
    r = tables["referents"].select(F.col("rivendita").alias("codice"), "nome", "cognome")
    return c.join(r, "codice", "left").select(
        "codice",
        F.when(F.col("privato_or_rivendita") == 1, F.lit("Not expected"))
         .otherwise(F.concat(F.col("nome"), F.lit(" "), F.col("cognome"))).alias("referente"))


def _header(tables: Tables, orders=None) -> DataFrame:
    o = keep_keys(tables["orders"], "id", orders)
    ref = _referent_label(tables)
    return o.join(ref, o.cliente == ref.codice, "inner")


def order_report_header(tables: Tables, orders=None) -> DataFrame:
    """Order with its status and referent ('Not expected' for private customers)."""
    h = _header(tables, orders)
    return h.select(
        F.col("id").alias("ordine"), F.to_date("data").alias("data"), "indirizzo_spedizione",
        F.col("contatto"), flag_text(F.col("aperto_or_finalizzato"), "Open", "Finalized").alias("stato"),
        "referente")


def order_report_lines(tables: Tables, orders=None) -> DataFrame:
    """Each order line at the price in force on the order date.

    As-of lookup: the latest price with ``data_adozione <= order date``, whatever
    the ends of the periods say (``functions/asof``), so a gap in a price
    history or two prices open at once still give one row per line.
    A line dated before the first price of its species has no row (inner join).
    """
    lines = keep_keys(tables["order_lines"], "ordine", orders)
    o = keep_keys(tables["orders"], "id", orders).select("id", "data")
    dated = lines.join(o, lines.ordine == o.id, "inner").drop("id")
    # Names meet the prices first, both small next to the lines, so the lines go through
    # one join on species and no operator after it needs that partitioning.
    held = quarterly(tables["prices"], "specie_di_pianta", "data_adozione", "valore", quarter(o.agg(F.max("data")).scalar()))
    s = tables["species"].select("codice", "nome_comune", "nome_latino")
    held = held.join(s, held.specie_di_pianta == s.codice, "inner")
    out = as_of(dated, "data", held, "specie_di_pianta")
    return out.select(
        "ordine", "codice", display_name(F.col("nome_comune"), F.col("nome_latino")).alias("nome"),
        F.col("valore").alias("unit_price"), "quantita",
        (F.col("valore") * F.col("quantita")).cast(LINE_TOTAL).alias("cumulative_price"))


def order_report_totals(tables: Tables, orders=None, lines: DataFrame | None = None) -> DataFrame:
    """Number of plants and total spending per order, over the R4b lines."""
    lines = order_report_lines(tables, orders) if lines is None else lines
    return lines.groupBy("ordine").agg(
        F.sum("quantita").cast("long").alias("number_of_plants"),
        F.sum("cumulative_price").cast(LINE_TOTAL).alias("total_spending"))


def order_report(tables: Tables, orders=None) -> dict[str, DataFrame]:
    """R4 as three named results, like the three result sets of the reference report."""
    lines = order_report_lines(tables, orders)
    return {"header": order_report_header(tables, orders), "lines": lines,
            "totals": order_report_totals(tables, orders, lines)}


def order_species(tables: Tables, orders=None) -> DataFrame:
    """Lines of each order with the ``common (latin)`` species name."""
    lines = keep_keys(tables["order_lines"], "ordine", orders)
    s = tables["species"].select("codice", "nome_comune", "nome_latino")
    j = lines.join(s, lines.specie_di_pianta == s.codice, "inner")
    return j.select("ordine", "codice", display_name(F.col("nome_comune"), F.col("nome_latino")).alias("nome"),
                    "quantita")


def order_status(tables: Tables, orders=None) -> DataFrame:
    """R6: 'Completed' when packed total equals ordered total, else by open flag.

    Both totals are those kept beside the tables, or else pre-aggregated per order
    (partial aggregation before the shuffle), and left-joined; an order with no packs has a NULL packed total,
    which compares as not completed.
    """
    h = _header(tables, orders)
    ordered = keep_keys(totals(tables, "ordered_totals"), "ordine", orders).select("ordine", F.col("somma").alias("q_ordinata"))
    packed = keep_keys(totals(tables, "packed_totals"), "ordine", orders).groupBy("ordine").agg(
        F.sum("somma").alias("q_impacchettata"))
    j = (h.join(ordered, h.id == ordered.ordine, "left").drop("ordine")
          .join(packed, h.id == packed.ordine, "left").drop("ordine"))
    completed = true_or_false(F.col("q_impacchettata") == F.col("q_ordinata"))
    return j.select(
        F.col("id").alias("ordine"), F.to_date("data").alias("data"), "indirizzo_spedizione", "contatto",
        F.when(completed, F.lit("Completed"))
         .when(F.col("aperto_or_finalizzato") == 1, F.lit("Already open"))
         .otherwise(F.lit("Not yet completed")).alias("stato"),
        "referente")


def owner_check(tables: Tables, requests: DataFrame, order_col: str = "ordine", customer_col: str = "cliente") -> DataFrame:
    """Adds ``is_owner``: the order exists and belongs to the requesting customer.

    A missing order gives NULL in the reference and counts as false.
    """
    o = tables["orders"].select(F.col("id").alias("_oid"), F.col("cliente").alias("_owner"))
    j = requests.join(o, requests[order_col] == o._oid, "left")
    return j.withColumn("is_owner", true_or_false(F.col("_owner") == F.col(customer_col))).drop("_oid", "_owner")


def order_report_requests(tables: Tables, requests: DataFrame) -> DataFrame:
    """R4 as requested by customers: (cliente, ordine) -> outcome of the report request.

    The order system checks the owner first, where an unknown order gives NULL
    and passes, then existence: another customer's order 45005, unknown order
    45016.  Accepted requests read ``order_report`` for their orders.
    """
    o = tables["orders"].select(F.col("id").alias("ordine"), F.col("cliente").alias("_owner"))
    r = requests.select("cliente", "ordine").join(o, "ordine", "left")
    code = first_failing((F.col("_owner").isNotNull() & (F.col("_owner") != F.col("cliente")), codes.NOT_OWNER),
                         (F.col("_owner").isNull(), codes.UNKNOWN_ORDER))
    return with_outcome(r, code).select("cliente", "ordine", "code", "esito", "reason")
