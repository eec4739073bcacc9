"""Request batches derived from the test tables, so every job's work grows with the data.

Each batch is defined twice, as a DataFrame and as the same rule in SQL for
the DuckDB oracle.  No row is dropped to make a batch small: every lineitem
(or part, customer, supplier) row yields a request, and the mix of request
kinds comes from the row's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.session import written
from hortus.sources.schemas import PRICE
from hortus.sources.testdata import TestdataTables

UNKNOWN_SPECIES_OFFSET = 1_000_000_000


def _marked_sql(sql: str, cols: str) -> str:
    order = ", ".join(f"{c.strip()} nulls first" for c in cols.split(","))
    return f"select *, row_number() over (partition by ts, seq order by {order}) > 1 again from ({sql}) q0"


def fit_sql(sql: str, cols: str) -> str:
    """The requests of ``sql`` with a (ts, seq) of their own: of those that share one, the least by ``cols``."""
    return f"select {cols} from ({_marked_sql(sql, cols)}) q1 where not again"


def refused_sql(sql: str, cols: str) -> str:
    """The outcomes of the others, to follow a job's own."""
    return (f" union all by name select {cols}, 'DUPLICATE' code, 'rejected' esito, "
            f"'{codes.REASONS[codes.DUPLICATE]}' reason from ({_marked_sql(sql, cols)}) q1 where again")


PRICE_CHANGE_COLS = "ts, seq, specie_di_pianta, valore"
LINE_CHANGE_COLS = "ts, seq, op, cliente, ordine, specie_di_pianta, quantita"
PACK_COLS = "ts, seq, ordine, pacco, new_pack, specie_di_pianta, quantita"


def _seq(li: DataFrame):
    return (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")


# C1 --------------------------------------------------------------------------

def price_changes(src: TestdataTables) -> DataFrame:
    """One change per lineitem row, dated ten years after the row's ship month.

    Rows of one species and month collide on the same second (the last
    sequence number wins); every third line number asks for the current price
    (a no-op); line number 7 names an unknown species.
    """
    li = src.raw("lineitem")
    p = src.raw("part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return written(j.select(
        (F.date_trunc("month", F.col("l_shipdate")) + F.expr("INTERVAL 10 YEARS")).cast("timestamp_ntz").alias("ts"),
        _seq(j).alias("seq"),
        F.when(F.col("l_linenumber") == 7, F.col("l_partkey") + UNKNOWN_SPECIES_OFFSET)
         .otherwise(F.col("l_partkey")).cast("int").alias("specie_di_pianta"),
        F.when(F.col("l_linenumber") % 3 == 0, (F.col("p_retailprice") + (F.col("p_partkey") % 4) * 5).cast(PRICE))
         .otherwise((F.col("l_quantity") * 10 + F.col("l_linenumber")).cast(PRICE)).alias("valore")))


PRICE_CHANGES_SQL = (
    "select cast(date_trunc('month', l_shipdate) + interval 10 year as timestamp) ts, "
    "cast(l_orderkey*8+l_linenumber as bigint) seq, "
    f"cast(case when l_linenumber=7 then l_partkey+{UNKNOWN_SPECIES_OFFSET} else l_partkey end as int) specie_di_pianta, "
    "case when l_linenumber%3=0 then cast(p_retailprice+(p_partkey%4)*5 as decimal(7,2)) "
    "else cast(l_quantity*10+l_linenumber as decimal(7,2)) end valore "
    "from lineitem join part on p_partkey=l_partkey")


# C13, C14 ----------------------------------------------------------------------

def order_line_changes(src: TestdataTables) -> DataFrame:
    """One line change per lineitem row, on its own order, dated at its ship date.

    Line numbers 0 mod 4 change the line's quantity (+3), 2 mod 4 remove it,
    the others add the species numbered like the row's supplier (few species
    take many adds, so stock runs out); line number 5 comes from a customer
    who does not own the order.
    """
    li = src.raw("lineitem")
    o = src.orders.select(F.col("id"), F.col("cliente").alias("_owner"))
    j = li.join(o, li.l_orderkey.cast("int") == o.id, "left")
    op = (F.when(F.col("l_linenumber") % 4 == 0, F.lit("CHANGE"))
           .when(F.col("l_linenumber") % 4 == 2, F.lit("REMOVE")).otherwise(F.lit("ADD")))
    # Written: a batch is read several times, and this one has a join of its own.
    return written(j.select(
        F.col("l_shipdate").alias("ts"), _seq(j).alias("seq"), op.alias("op"),
        F.when(F.col("l_linenumber") == 5, F.lpad(F.col("l_suppkey").cast("string"), 11, "0"))
         .otherwise(F.col("_owner")).alias("cliente"),
        F.col("l_orderkey").cast("int").alias("ordine"),
        F.when(op == "ADD", F.col("l_suppkey")).otherwise(F.col("l_partkey")).cast("int").alias("specie_di_pianta"),
        F.when(op == "REMOVE", F.lit(None)).when(op == "CHANGE", F.col("l_quantity") + 3)
         .otherwise(F.col("l_quantity")).cast("int").alias("quantita")))


ORDER_LINE_CHANGES_SQL = (
    "select l_shipdate ts, cast(l_orderkey*8+l_linenumber as bigint) seq, "
    "case when l_linenumber%4=0 then 'CHANGE' when l_linenumber%4=2 then 'REMOVE' else 'ADD' end op, "
    "case when l_linenumber=5 then lpad(cast(l_suppkey as string),11,'0') else o.cliente end cliente, "
    "cast(l_orderkey as int) ordine, "
    "cast(case when l_linenumber%4 in (1,3) then l_suppkey else l_partkey end as int) specie_di_pianta, "
    "cast(case when l_linenumber%4=2 then null when l_linenumber%4=0 then l_quantity+3 else l_quantity end as int) quantita "
    "from lineitem left join ordini o on o.id=cast(l_orderkey as int)")


def finalizations(src: TestdataTables) -> DataFrame:
    """One finalize request per order, 30 days after it was placed; urgent orders'
    requests come from another customer (refused)."""
    o = src.raw("orders")
    eng = src.orders.select("id", "cliente")
    j = o.join(eng, o.o_orderkey.cast("int") == eng.id, "inner")
    return j.select(
        (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).cast("timestamp_ntz").alias("ts"),
        (F.col("o_orderkey") * 8).cast("long").alias("seq"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("nobody")).otherwise(F.col("cliente")).alias("cliente"),
        F.col("id").alias("ordine"))


FINALIZATIONS_SQL = (
    "select cast(o_orderdate + interval 30 day as timestamp) ts, cast(o_orderkey*8 as bigint) seq, "
    "case when o_orderpriority='1-URGENT' then 'nobody' else e.cliente end cliente, e.id ordine "
    "from orders join ordini e on e.id=cast(o_orderkey as int)")


# C12 -------------------------------------------------------------------------

def new_orders(src: TestdataTables) -> DataFrame:
    """One new order per customer, for the species numbered like its nation
    (25 species share all first lines, so stock runs out).  Every fifth
    customer gives no contact (preferred one, or 45002), every seventh gives a
    contact of the next customer (45009); even keys give no shipping address."""
    c = src.customers_with_key
    key = F.col("c_custkey")
    nation = src.raw("customer").select(F.col("c_custkey").alias("_k"), "c_nationkey")
    j = c.join(nation, c.c_custkey == nation._k, "inner")
    return j.select(
        (F.lit("2002-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(secs=key.cast("int"))).alias("ts"),
        key.cast("long").alias("seq"),
        F.col("codice").alias("cliente"),
        F.when(key % 2 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Ship new "), key.cast("string"))).alias("indirizzo_spedizione"),
        F.when(key % 5 == 0, F.lit(None).cast("string"))
         .when(key % 7 == 0, F.concat(F.lit("c"), (key + 1).cast("string"), F.lit("@example.com")))
         .otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com"))).alias("contatto"),
        F.col("c_nationkey").cast("int").alias("specie_di_pianta"),
        (key % 20 + 1).cast("int").alias("quantita"))


# C19 -------------------------------------------------------------------------

def pack_requests(src: TestdataTables) -> DataFrame:
    """One pack request per lineitem row, a day after shipping: lines 1-3 go to
    new packs (handles P1 for odd, P0 for even line numbers), later lines to the
    order's existing pack 1.  Rows that are packed already find nothing left."""
    li = src.raw("lineitem")
    return li.select(
        (F.col("l_shipdate") + F.expr("INTERVAL 1 DAYS")).cast("timestamp_ntz").alias("ts"),
        _seq(li).alias("seq"),
        F.col("l_orderkey").cast("int").alias("ordine"),
        F.when(F.col("l_linenumber") > 3, F.lit(1)).cast("int").alias("pacco"),
        F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("P"), (F.col("l_linenumber") % 2).cast("string")))
         .alias("new_pack"),
        F.col("l_partkey").cast("int").alias("specie_di_pianta"),
        F.col("l_quantity").cast("int").alias("quantita"))


NEW_ORDERS_SQL = (
    "select timestamp '2002-01-01 00:00:00' + to_seconds(c.c_custkey) ts, cast(c.c_custkey as bigint) seq, "
    "c.codice cliente, case when c.c_custkey%2=0 then null else concat('Ship new ',cast(c.c_custkey as string)) end "
    "indirizzo_spedizione, case when c.c_custkey%5=0 then null when c.c_custkey%7=0 then "
    "concat('c',cast(c.c_custkey+1 as string),'@example.com') else concat('c',cast(c.c_custkey as string),'@example.com') "
    "end contatto, cast(k.c_nationkey as int) specie_di_pianta, cast(c.c_custkey%20+1 as int) quantita "
    "from customers c join customer k on k.c_custkey=c.c_custkey")


PACK_REQUESTS_SQL = (
    "select cast(l_shipdate + interval 1 day as timestamp) ts, cast(l_orderkey*8+l_linenumber as bigint) seq, "
    "cast(l_orderkey as int) ordine, cast(case when l_linenumber>3 then 1 end as int) pacco, "
    "case when l_linenumber<=3 then concat('P',cast(l_linenumber%2 as string)) end new_pack, "
    "cast(l_partkey as int) specie_di_pianta, cast(l_quantity as int) quantita from lineitem")
