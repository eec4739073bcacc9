"""Order jobs: C12 open orders, C13 order line changes (stock ledger), C14 finalize.

The stock check is order dependent: a refused line takes no stock, so later
lines see more.  A running sum would count refused lines, so the decisions
are a sequential fold per species in (time, sequence) order
(``fold_by_key``): the fold streams the requests batch by batch and keeps the
stock plus the current quantity of the lines touched.  Different species run
in parallel, and so do the ranges of a species with very many requests:
no fold is longer than a range (``_in_ranges``).

Everything that does not depend on the stock (owner, order status, existing
line, contact rules) is decided set-wise with joins before the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hortus.functions import codes
from hortus.functions.checks import first_failing, missing, request_order, too_long, with_outcome
from hortus.functions.columns import true_or_false
from hortus.functions.ordered import cluster_by_key, column_values, fold_by_key, tag_ranges
from hortus.functions.sequence import max_key, number_in_order
from hortus.operators.jobs.base import JobResult, Tables, in_sequence, unsequenced, with_refused, years_of, years_of_orders
from hortus.operators.orders import owner_check
from hortus.operators.totals import count
from hortus.session import written

OPS = ("ADD", "CHANGE", "REMOVE")
OPEN = "OPEN"
LINE_CHANGE_COLS = ("ts", "seq", "op", "cliente", "ordine", "specie_di_pianta", "quantita")
NEW_ORDER_COLS = ("ts", "seq", "cliente", "indirizzo_spedizione", "contatto", "specie_di_pianta", "quantita")
FINALIZE_COLS = ("ts", "seq", "cliente", "ordine")

_FOLD_IN = ["specie_di_pianta", "_range", "op", "ordine", "quantita", "pre_code", "is_final", "q0", "stock0"]
FOLD_RESULTS = [
    T.StructField("fold_code", T.StringType()), T.StructField("noop", T.BooleanType()),
    T.StructField("stock_delta", T.IntegerType()), T.StructField("new_qty", T.IntegerType()),
    T.StructField("stock_after", T.IntegerType()), T.StructField("need", T.IntegerType()),
]


def ledger_step(op: str, q, cur, stock, final: bool, pre):
    """One request against the ledger: returns (code, noop, stock_delta, new_quantity, need).

    Check order (as the procedure and its triggers run them): set-wise code
    first (owner 45005 ...); an insert: stock 45006, finalized 45007, line
    already present 45008, unknown species 45014; a change: absent line is a
    no-op, stock for the increase 45006, finalized 45007; a removal: absent
    line is a no-op, finalized 45007.  ``stock`` is None for an unknown species.
    ``need`` is what the stock check compares with the stock, None without one.
    """
    if pre is not None:
        return pre, False, 0, None, None
    if op in (OPEN, "ADD"):
        q = int(q)
        need = None if stock is None else q
        if stock is not None and q > stock:
            return codes.ABOVE_STOCK, False, 0, None, need
        if final:
            return codes.ORDER_FINALIZED, False, 0, None, need
        if cur is not None:
            return codes.ALREADY_IN_ORDER, False, 0, None, need
        if stock is None:
            return codes.UNKNOWN_SPECIES, False, 0, None, need
        return None, False, q, q, need
    if op == "CHANGE":
        if cur is None:
            return None, True, 0, None, None
        d = int(q) - int(cur)
        need = None if stock is None else d
        if stock is not None and d > stock:
            return codes.ABOVE_STOCK, False, 0, None, need
        if final:
            return codes.ORDER_FINALIZED, False, 0, None, need
        return None, False, d, int(q), need
    if op != "REMOVE":
        return codes.INVALID, False, 0, None, None
    if cur is None:
        return None, True, 0, None, None
    if final:
        return codes.ORDER_FINALIZED, False, 0, None, None
    return None, False, -int(cur), None, None


def stock_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The ledger over the requests of each (species, range), streamed in (time, sequence) order."""
    run, stock, lines = None, None, {}
    for pdf in batches:
        out = {f.name: [] for f in FOLD_RESULTS}
        cols = [column_values(pdf[c]) for c in _FOLD_IN]
        for sp, part, op, ordine, q, pre, final, q0, stock0 in zip(*cols):
            if (sp, part) != run:
                run, stock, lines = (sp, part), (None if stock0 is None else int(stock0)), {}
            cur = lines.get(ordine, q0) if op != OPEN else None
            code, noop, delta, new_qty, need = ledger_step(op, q, cur, stock, bool(final), pre)
            accepted = code is None and not noop
            if accepted:
                stock = stock - delta
                if op != OPEN:
                    lines[ordine] = new_qty
            out["fold_code"].append(code)
            out["noop"].append(noop)
            out["stock_delta"].append(delta if accepted else 0)
            out["new_qty"].append(new_qty if accepted else None)
            out["stock_after"].append(stock)
            out["need"].append(need)
        yield pdf.assign(**out)


def _finalized_at(tables: Tables, finalizations: DataFrame | None) -> DataFrame | None:
    """First accepted finalize request per order (from C14 requests in the same batch)."""
    if finalizations is None:
        return None
    f = finalize_checks(tables, finalizations).filter(F.col("_code").isNull())
    return f.groupBy("ordine").agg(F.min(request_order()).alias("_finalized_at"))


#: Most requests of a species that one fold goes through.
RANGE_ROWS = 1_000_000
_KEY = ["specie_di_pianta", "_range"]


def _fold(rows: DataFrame, schema: T.StructType, clustered: bool = False) -> DataFrame:
    return fold_by_key(rows.select(*[f.name for f in schema.fields if f not in FOLD_RESULTS]), _KEY, ["ts", "seq"],
                       stock_fold, schema, clustered)


def _stock_chain(ranges: pd.DataFrame) -> pd.DataFrame:
    """The incoming stock of each range of one species, in order, from its last runs.

    A run says what a range does to any incoming stock from ``lo`` to below
    ``hi``: every stock check ends as it did, so the stock moves by the same
    amount.  Outside it the run does not hold; its outgoing stock is then the guess
    for the next range, as ledgers that run out come together soon."""
    ranges = ranges.sort_values("_range")
    stock, est, holds = None, [], []
    for i, (start, used, moved, lo, hi) in enumerate(zip(*(column_values(ranges[c]) for c in ("start", "used", "moved", "lo", "hi")))):
        stock = start if i == 0 else stock
        ok = stock is None or (lo is None or stock >= lo) and (hi is None or stock < hi)
        est.append(stock)
        holds.append(ok)
        stock = None if stock is None else (stock if ok else used) - moved
    return ranges[_KEY].assign(est=est, holds=holds)


def _in_ranges(rows: DataFrame, schema: T.StructType, range_rows: int) -> DataFrame:
    """The ledger of species with many requests, each cut into ranges of its (time, sequence) order.

    All ranges are folded at once, each from an assumed incoming stock and assumed
    quantities of the lines that earlier ranges touch too.  What the runs did
    is then chained (``_stock_chain``), and lines are passed on to the next range that
    touches them.  A range whose stock falls outside what its run holds for, or
    whose lines came out otherwise than assumed, is folded again from the
    chained state; the others stand, shifted by the difference in stock.  The
    first range that does not stand is right after the next round, so the
    rounds end, and with all standing every decision is the sequential one.
    """
    n = rows.count()
    tagged = tag_ranges(rows, ["specie_di_pianta"], ["ts", "seq"], -(-n // range_rows)).withColumnRenamed("_part", "_range")
    by_line = Window.partitionBy("specie_di_pianta", "ordine")
    touched = tagged.filter(F.col("ordine").isNotNull()).groupBy(*_KEY, "ordine").agg(F.first("q0").alias("q_first"))
    passing = written(touched.withColumn("_n", F.count(F.lit(1)).over(by_line)).filter("_n > 1").drop("_n"))
    assumed = passing.withColumn("q_in", F.col("q_first"))  # of a line at the beginning of a range
    starts = written(tagged.groupBy(*_KEY).agg(F.first("stock0").alias("start")))
    stocks = starts.withColumnRenamed("start", "used")
    latest, outs, runs, todo = None, None, [], starts.select(*_KEY)
    while True:
        state = (tagged.join(todo, _KEY, "left_semi").drop("stock0").join(stocks, _KEY)
                 .join(assumed.select(*_KEY, "ordine", "q_in", F.lit(True).alias("_passed")), [*_KEY, "ordine"], "left")
                 .withColumn("q0", F.when(F.col("_passed"), F.col("q_in")).otherwise(F.col("q0"))).withColumnRenamed("used", "stock0"))
        done = written(_fold(state, schema))
        runs.append(done.withColumn("_run", F.lit(len(runs))))
        before = F.col("stock_after") + F.col("stock_delta")
        refused = true_or_false(F.col("fold_code") == codes.ABOVE_STOCK)
        # The stock may be less by the least that a passed check left over, and more by less than a refused one lacked.
        summary = done.groupBy(*_KEY).agg(
            F.first("stock0").alias("used"), F.sum("stock_delta").alias("moved"),
            (F.first("stock0") - F.min(F.when(~refused, before - F.col("need")))).alias("lo"),
            (F.first("stock0") + F.min(F.when(refused, F.col("need") - before))).alias("hi")).withColumn("_run", F.lit(len(runs) - 1))
        left = (done.filter(F.col("fold_code").isNull() & ~F.col("noop") & (F.col("op") != OPEN)).groupBy(*_KEY, "ordine")
                .agg(F.max_by(F.struct(F.col("new_qty").alias("q")), request_order()).alias("out"))
                .join(passing.select(*_KEY, "ordine"), [*_KEY, "ordine"], "left_semi"))
        if latest is not None:
            summary = latest.join(todo, _KEY, "left_anti").unionByName(summary)
            left = outs.join(todo, _KEY, "left_anti").unionByName(left)
        latest, outs = written(summary), written(left)
        chain = written(latest.join(starts, _KEY).groupBy("specie_di_pianta").applyInPandas(
            _stock_chain, "specie_di_pianta int, _range int, est long, holds boolean"))
        earlier = by_line.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        handed = (passing.join(outs, [*_KEY, "ordine"], "left")
                  .withColumn("_got", F.last("out", ignorenulls=True).over(earlier))
                  .select(*_KEY, "ordine", "q_first", F.when(F.col("_got").isNotNull(), F.col("_got.q")).otherwise(F.col("q_first")).alias("q_in")))
        handed = written(handed)
        others = (handed.join(assumed.select(*_KEY, "ordine", F.col("q_in").alias("_was")), [*_KEY, "ordine"])
                  .filter(~F.col("q_in").eqNullSafe(F.col("_was"))).select(*_KEY))
        todo = written(chain.filter(~F.col("holds")).select(*_KEY).unionByName(others).distinct())
        if todo.isEmpty():
            break
        assumed, stocks = handed, chain.select(*_KEY, F.col("est").cast("int").alias("used"))
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    shift = F.col("est") - F.col("used")
    return (every.join(latest.select(*_KEY, "_run", "used"), [*_KEY, "_run"]).join(chain.select(*_KEY, "est"), _KEY)
            .withColumn("stock_after", (F.col("stock_after") + shift).cast("int")).select(*schema.fieldNames()))


def _run_fold(tables: Tables, req: DataFrame, batch: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``req``, the requests of ``batch``, has the fold inputs except stock0; returns req + fold results.

    Every request column passes through the fold, so no join back is needed.  A
    species with more than ``range_rows`` requests in the batch is folded in ranges.
    """
    sp = tables["species"].select(F.col("codice").alias("specie_di_pianta"), F.col("giacenza").alias("stock0"))
    # A request without a species is refused before the ledger matters and never splits.
    many = (batch.filter(F.col("specie_di_pianta").isNotNull()).groupBy("specie_di_pianta").count()
            .filter(F.col("count") > range_rows).select("specie_di_pianta"))
    split_any = not many.isEmpty()
    if split_any:  # else the requests are gone through once
        req, many = written(req), written(many)
    # One shuffle by species serves both the stock join and the fold.
    r = cluster_by_key(req, ["specie_di_pianta"]).join(sp, "specie_di_pianta", "left").withColumn("_range", F.lit(0))
    schema = T.StructType([*r.schema.fields, *FOLD_RESULTS])
    if not split_any:
        # Written: the decisions feed several outputs and must not be re-run.
        return written(_fold(r, schema, clustered=True))
    few = _fold(r.join(many, "specie_di_pianta", "left_anti"), schema, clustered=True)
    split = _in_ranges(written(r.join(many, "specie_di_pianta", "left_semi").drop("_range")), schema, range_rows)
    return written(few.unionByName(split))


def _line_results(tables: Tables, decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New species stock, new order lines and emptied orders from the fold decisions."""
    accepted = decided.filter(F.col("fold_code").isNull() & ~F.col("noop"))
    taken = accepted.groupBy(F.col("specie_di_pianta").alias("codice")).agg(F.sum("stock_delta").alias("_taken"))
    species = tables["species"]
    new_species = species.join(taken, "codice", "left").select(
        *[(F.col("giacenza") - F.coalesce(F.col("_taken"), F.lit(0))).cast("int").alias("giacenza")
          if c == "giacenza" else F.col(c) for c in species.columns])
    changed = accepted.filter(F.col("op") != OPEN)
    final = changed.groupBy("ordine", "specie_di_pianta").agg(
        F.max_by(F.struct(F.col("new_qty").alias("q")), request_order()).alias("_final"))
    lines = tables["order_lines"]
    new_lines = (lines.join(final.select("ordine", "specie_di_pianta"), ["ordine", "specie_di_pianta"], "left_anti")
                 .unionByName(final.filter(F.col("_final.q").isNotNull()).select(
                     "ordine", "specie_di_pianta", F.col("_final.q").alias("quantita"))))
    removed_from = changed.filter(F.col("op") == "REMOVE").select("ordine").distinct()
    still_lined = new_lines.join(removed_from, "ordine", "left_semi").select("ordine").distinct()
    emptied = removed_from.join(still_lined, "ordine", "left_anti")
    return new_species, new_lines, emptied


@in_sequence
def apply_order_line_changes(tables: Tables, changes: DataFrame, finalizations: DataFrame | None = None,
                             range_rows: int = RANGE_ROWS) -> JobResult:
    """Add / change / remove order lines in time order against the stock.

    ``changes``: ts, seq, op (ADD, CHANGE, REMOVE), cliente, ordine,
    specie_di_pianta, quantita (NULL for REMOVE).  ``finalizations`` (C14
    requests of the same batch) make an order finalized from their time on;
    the new ``orders`` carry that status and ``extra["finalizations"]`` their
    outcomes.  A NULL in a required column is ``INVALID`` and changes nothing; of
    requests with equal (ts, seq) all but one are ``DUPLICATE``.

    Returns the new ``species`` (stock), ``order_lines`` and ``orders`` (an
    order whose last line is removed is deleted at the end of the batch), and
    per-request outcomes with the running stock (``stock_after``).
    """
    o = tables["orders"].select(F.col("id").alias("ordine"), F.col("cliente").alias("_owner"),
                                F.col("aperto_or_finalizzato").alias("_status"))
    r = changes.select(*LINE_CHANGE_COLS).join(o, "ordine", "left")
    fit, unfit = (None, None) if finalizations is None else unsequenced(finalizations.select(*FINALIZE_COLS))
    fin = _finalized_at(tables, fit)
    is_final = F.col("_status") == 0
    if fin is not None:
        r = r.join(fin, "ordine", "left")
        is_final = is_final | true_or_false(F.col("_finalized_at") < request_order())
    q0 = tables["order_lines"].select("ordine", "specie_di_pianta", F.col("quantita").alias("q0"))
    r = (r.withColumn("is_final", true_or_false(is_final))
          .withColumn("pre_code", first_failing(
              (missing("op", "cliente", "ordine", "specie_di_pianta") | ~F.col("op").isin(*OPS), codes.INVALID),
              (~true_or_false(F.col("_owner") == F.col("cliente")), codes.NOT_OWNER),
              ((F.col("op") != "REMOVE") & (F.col("quantita").isNull() | (F.col("quantita") < 0)), codes.INVALID)))
          .select(*LINE_CHANGE_COLS, "is_final", "pre_code")
          .join(q0, ["ordine", "specie_di_pianta"], "left"))
    decided = _run_fold(tables, r, changes, range_rows)
    new_species, new_lines, emptied = _line_results(tables, decided)
    orders, extra = tables["orders"], {"emptied_orders": emptied}
    if finalizations is not None:
        finalized = with_refused(_finalize(tables, fit), unfit)
        orders, extra["finalizations"] = finalized.tables["orders"], finalized.outcomes
    new_orders = orders.join(emptied.withColumnRenamed("ordine", "id"), "id", "left_anti")
    outcomes = with_outcome(decided.select(*LINE_CHANGE_COLS, "fold_code", "noop", "stock_after"),
                            F.col("fold_code"), noop=F.col("noop")).drop("fold_code", "noop")
    changed = decided.filter(F.col("fold_code").isNull() & ~F.col("noop"))
    years = {"order_lines": years_of_orders(tables["orders"], changed)}
    years["orders"] = years_of_orders(tables["orders"], emptied)
    if finalizations is not None:
        years["orders"] = years["orders"].unionByName(years_of_orders(tables["orders"], extra["finalizations"].filter("code is null")))
    # The stock that a line takes is what its order's total gains.
    rows = F.when(F.col("op") == "ADD", 1).when(F.col("op") == "REMOVE", -1).otherwise(0)
    gained = changed.groupBy("ordine").agg(F.sum("stock_delta").alias("somma"), F.sum(rows).alias("righe"))
    return JobResult({"species": new_species, "order_lines": new_lines, "orders": new_orders}, outcomes, extra, years,
                     {"ordered_totals": gained})


@in_sequence
def open_orders(tables: Tables, requests: DataFrame, range_rows: int = RANGE_ROWS) -> JobResult:
    """New orders, each with its first line, all or nothing.

    Shipping defaults to the residence; the contact defaults to the preferred
    one (45002 if none); a given contact must belong to the customer or its
    referent (45009).  The first line then goes through the stock fold (45006,
    45014), so a refused line also drops its order.  Accepted orders get ids
    ``max(id) + 1, 2 ...`` in request order.
    """
    c = tables["customers"].select(F.col("codice").alias("cliente"), F.col("indirizzo_residenza").alias("_res"),
                                   F.col("contatto_preferito").alias("_pref"))
    cc = tables["customer_contacts"].select(F.col("contatto"), F.col("cliente").alias("_cc_owner"))
    rc = tables["referent_contacts"].select(F.col("contatto"), F.col("referente").alias("_rc_owner"))
    r = (requests.select(*NEW_ORDER_COLS).join(c, "cliente", "left")
                 .join(cc, "contatto", "left").join(rc, "contatto", "left"))
    owned = (F.col("_cc_owner") == F.col("cliente")) | (F.col("_rc_owner") == F.col("cliente"))
    r = r.withColumn("pre_code", first_failing(
        (missing("cliente", "specie_di_pianta"), codes.INVALID),
        (F.col("contatto").isNull() & F.col("_pref").isNull(), codes.NO_PREFERRED_CONTACT),
        (F.col("contatto").isNotNull() & ~true_or_false(owned), codes.CONTACT_NOT_OWNED),
        (F.col("quantita").isNull() | (F.col("quantita") < 0)
         | too_long(("indirizzo_spedizione", "orders", "indirizzo_spedizione")), codes.INVALID),
    )).withColumn("_ship", F.coalesce(F.col("indirizzo_spedizione"), F.col("_res"))) \
      .withColumn("_contact", F.coalesce(F.col("contatto"), F.col("_pref")))
    fold_in = r.select(*NEW_ORDER_COLS, "_ship", "_contact", F.lit(OPEN).alias("op"),
                       F.lit(None).cast("int").alias("ordine"), "pre_code", F.lit(False).alias("is_final"),
                       F.lit(None).cast("int").alias("q0"))
    full = _run_fold(tables, fold_in, requests, range_rows)
    accepted = full.filter(F.col("fold_code").isNull())
    numbered = number_in_order(accepted.select("ts", "seq", "cliente", "_ship", "_contact", "specie_di_pianta",
                                               "quantita", "stock_delta"),
                               ["ts", "seq"], max_key(tables["orders"], "id"), "id")
    new_rows = numbered.select("id", "cliente", F.col("ts").alias("data"), F.lit(1).alias("aperto_or_finalizzato"),
                               F.col("_ship").alias("indirizzo_spedizione"), F.col("_contact").alias("contatto"))
    new_line_rows = numbered.select(F.col("id").alias("ordine"), "specie_di_pianta", "quantita")
    taken = numbered.groupBy(F.col("specie_di_pianta").alias("codice")).agg(F.sum("stock_delta").alias("_taken"))
    species = tables["species"]
    new_species = species.join(taken, "codice", "left").select(
        *[(F.col("giacenza") - F.coalesce(F.col("_taken"), F.lit(0))).cast("int").alias("giacenza")
          if c == "giacenza" else F.col(c) for c in species.columns])
    outcomes = with_outcome(
        full.select(*NEW_ORDER_COLS, "fold_code", "stock_after").join(
            numbered.select("ts", "seq", "id"), ["ts", "seq"], "left"),
        F.col("fold_code")).drop("fold_code")
    schema_cols = tables["orders"].columns
    return JobResult({"orders": tables["orders"].unionByName(new_rows.select(*schema_cols)),
                      "order_lines": tables["order_lines"].unionByName(new_line_rows),
                      "species": new_species}, outcomes, years={"orders": years_of(new_rows, "data"), "order_lines": years_of(new_rows, "data")},
                     changes={"ordered_totals": count(new_line_rows, "ordered_totals")})


def finalize_checks(tables: Tables, requests: DataFrame) -> DataFrame:
    r = owner_check(tables, requests.select(*FINALIZE_COLS))
    return r.withColumn("_code", first_failing((missing("cliente", "ordine"), codes.INVALID),
                                               (~F.col("is_owner"), codes.NOT_OWNER))).drop("is_owner")


@in_sequence
def finalize_orders(tables: Tables, requests: DataFrame) -> JobResult:
    """C14: the owner finalizes an order (status 0); anyone else gets 45005; repeats are harmless."""
    return _finalize(tables, requests)


def _finalize(tables: Tables, requests: DataFrame) -> JobResult:
    r = finalize_checks(tables, requests)
    done = r.filter(F.col("_code").isNull()).select(F.col("ordine").alias("id")).distinct().withColumn("_done", F.lit(True))
    orders = tables["orders"]
    new_orders = orders.join(done, "id", "left").select(
        *[F.when(F.col("_done"), F.lit(0)).otherwise(F.col(c)).cast("int").alias(c)
          if c == "aperto_or_finalizzato" else F.col(c) for c in orders.columns])
    outcomes = with_outcome(r.select(*FINALIZE_COLS, "_code"), F.col("_code")).drop("_code")
    return JobResult({"orders": new_orders}, outcomes, years={"orders": years_of_orders(orders, done.withColumnRenamed("id", "ordine"))})
