"""Change jobs over request batches derived from the test tables."""

from __future__ import annotations

import datetime as dt


from hortus.functions import codes
from hortus.operators.jobs import maintenance as M
from hortus.operators.jobs import orders as OR
from hortus.operators.jobs import packs as PK
from hortus.operators.jobs import prices as PR
from hortus.plans import requests as RQ
from hortus.plans.fixture_sql import with_fixtures as W
from hortus.plans.registry import register_source, set_oracle

RESTOCK_NOW = dt.datetime(1998, 1, 1)
RETENTION_NOW = dt.datetime(2000, 1, 1)


def reason_case(col: str = "code") -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in codes.REASONS.items())
    return f"case {col} {whens} end"


# C1 --------------------------------------------------------------------------

_C1_CTES = (
    f"req as ({RQ.fit_sql(RQ.PRICE_CHANGES_SQL, RQ.PRICE_CHANGE_COLS)}), "
    "open_p as (select specie_di_pianta, data_adozione open_since, valore open_value from prices where data_termine is null), "
    "checked as (select r.*, case when o.open_since is null then '45014' when r.valore is null or r.valore < 0 then 'INVALID' "
    "when r.ts <= o.open_since then 'OUT_OF_ORDER' end code from req r left join open_p o using (specie_di_pianta)), "
    "live as (select * from (select *, max(seq) over (partition by specie_di_pianta, ts) mx from checked where code is null) z "
    "where seq = mx), "
    "chain as (select specie_di_pianta, open_since ts, cast(-1 as bigint) seq, open_value valore, true is_open from open_p "
    "where specie_di_pianta in (select specie_di_pianta from live) union all "
    "select specie_di_pianta, ts, seq, valore, false from live), "
    "lagged as (select *, is_open or not coalesce(valore = lag(valore) over (partition by specie_di_pianta order by ts, seq), false) "
    "eff from chain), "
    "kept as (select * from lagged where eff), "
    "rew as (select specie_di_pianta, ts data_adozione, valore, lead(ts) over (partition by specie_di_pianta order by ts, seq) "
    "data_termine from kept)")

C1_PRICES_SQL = W(
    "select * from prices where data_termine is not null union all "
    "select * from prices where data_termine is null and specie_di_pianta not in (select specie_di_pianta from kept) "
    "union all select * from rew", "prices", extra=_C1_CTES)

C1_OUTCOMES_SQL = W(
    "select c.ts, c.seq, c.specie_di_pianta, c.valore, c.code, "
    "case when c.code is not null then 'rejected' when coalesce(l.eff, false) then 'accepted' else 'noop' end esito, "
    f"{reason_case('c.code')} reason from checked c left join lagged l on l.specie_di_pianta=c.specie_di_pianta "
    "and l.ts=c.ts and l.seq=c.seq and not l.is_open" + RQ.refused_sql(RQ.PRICE_CHANGES_SQL, RQ.PRICE_CHANGE_COLS),
    "prices", extra=_C1_CTES)


@register_source("apply_price_changes", C1_PRICES_SQL)
def apply_price_changes(src):
    """The price list after the derived change batch."""
    return PR.apply_price_changes(src.tables(), RQ.price_changes(src)).tables["prices"]


@register_source("apply_price_changes_outcomes", C1_OUTCOMES_SQL)
def apply_price_changes_outcomes(src):
    """Accepted / no-op / rejected per change request."""
    return PR.apply_price_changes(src.tables(), RQ.price_changes(src)).outcomes


# C20 -------------------------------------------------------------------------

@register_source("apply_restock", W(
    "select s.codice, cast(s.giacenza + coalesce(r.q, 0) as int) giacenza from species s left join "
    "(select specie_richiesta, sum(quantita) q from supply_requests where pendente_si_no=1 "
    f"and data <= timestamp '{RESTOCK_NOW}' group by 1) r on r.specie_richiesta=s.codice", "species", "supply_requests"))
def apply_restock(src):
    """C20: stock per species after delivering the pending requests due by the run time."""
    return M.apply_restock(src.tables(), RESTOCK_NOW).tables["species"].select("codice", "giacenza")


@register_source("apply_restock_requests", W(
    "select data, fornitore_scelto, specie_richiesta, quantita, case when pendente_si_no=1 "
    f"and data <= timestamp '{RESTOCK_NOW}' then 0 else pendente_si_no end pendente_si_no from supply_requests",
    "supply_requests"))
def apply_restock_requests(src):
    """C20: supply requests after the run, delivered ones marked 0."""
    return M.apply_restock(src.tables(), RESTOCK_NOW).tables["supply_requests"]


# C21 -------------------------------------------------------------------------

_CUTOFF = f"timestamp '{M.years_before(RETENTION_NOW, M.RETENTION_YEARS)}'"


@register_source("apply_retention_orders", W(
    f"select * from ordini where data >= {_CUTOFF}", "ordini"))
def apply_retention_orders(src):
    """Orders kept by the retention run."""
    return M.apply_retention(src.tables(), RETENTION_NOW).tables["orders"]


@register_source("apply_retention_order_lines", W(
    f"select * from order_lines where ordine not in (select id from ordini where data < {_CUTOFF})",
    "order_lines", "ordini"))
def apply_retention_order_lines(src):
    """Order lines left after the cascade."""
    return M.apply_retention(src.tables(), RETENTION_NOW).tables["order_lines"]


@register_source("apply_retention_pack_contents", W(
    f"select * from pack_contents where ordine not in (select id from ordini where data < {_CUTOFF})",
    "pack_contents", "ordini"))
def apply_retention_pack_contents(src):
    """Pack contents left after the cascade."""
    return M.apply_retention(src.tables(), RETENTION_NOW).tables["pack_contents"]


@register_source("apply_retention_prices", W(
    f"select * from prices where data_termine is null or data_termine >= {_CUTOFF}", "prices"))
def apply_retention_prices(src):
    """Prices left (open ones always stay)."""
    return M.apply_retention(src.tables(), RETENTION_NOW).tables["prices"]


@register_source("apply_retention_supply_requests", W(
    f"select * from supply_requests where data >= {_CUTOFF}", "supply_requests"))
def apply_retention_supply_requests(src):
    """Supply requests left."""
    return M.apply_retention(src.tables(), RETENTION_NOW).tables["supply_requests"]


# C12, C13, C14 ------------------------------------------------------------------

def _line_job(src):
    return OR.apply_order_line_changes(src.tables(), RQ.order_line_changes(src), RQ.finalizations(src))


@register_source("apply_order_line_changes")
def apply_order_line_changes(src):
    """Decision and running stock per line change (rows-only; checked against the
    sequential replay in tests)."""
    return _line_job(src).outcomes


@register_source("apply_order_line_changes_stock")
def apply_order_line_changes_stock(src):
    """Stock per species after the batch."""
    return _line_job(src).tables["species"].select("codice", "giacenza")


@register_source("apply_order_line_changes_lines")
def apply_order_line_changes_lines(src):
    """Order lines after the batch."""
    return _line_job(src).tables["order_lines"]


@register_source("open_orders")
def open_orders(src):
    """Decision and new order id per new-order request (rows-only)."""
    return OR.open_orders(src.tables(), RQ.new_orders(src)).outcomes


@register_source("finalize_orders", W(
    f"select f.ts, f.seq, f.cliente, f.ordine, case when coalesce(o.cliente = f.cliente, false) then null else '45005' end code, "
    "case when coalesce(o.cliente = f.cliente, false) then 'accepted' else 'rejected' end esito, "
    "case when coalesce(o.cliente = f.cliente, false) then null else "
    f"'{codes.REASONS[codes.NOT_OWNER]}' end reason from ({RQ.FINALIZATIONS_SQL}) f left join ordini o on o.id=f.ordine",
    "ordini"))
def finalize_orders(src):
    """C14: one finalize request per order."""
    return OR.finalize_orders(src.tables(), RQ.finalizations(src)).outcomes


@register_source("finalize_orders_table", W(
    "select o.id, o.cliente, o.data, case when f.ordine is not null then 0 else o.aperto_or_finalizzato end "
    "aperto_or_finalizzato, o.indirizzo_spedizione, o.contatto from ordini o left join (select distinct ordine from "
    f"({RQ.FINALIZATIONS_SQL}) r join ordini x on x.id=r.ordine and x.cliente=r.cliente) f on f.ordine=o.id", "ordini"))
def finalize_orders_table(src):
    """C14: orders after the finalize batch."""
    return OR.finalize_orders(src.tables(), RQ.finalizations(src)).tables["orders"]


# C19 -------------------------------------------------------------------------

def _pack_job(src):
    src.keep("pack_contents")
    return PK.allocate_packs(src.tables(), RQ.pack_requests(src))


@register_source("allocate_packs")
def allocate_packs(src):
    """Decision and pack number per pack request (rows-only; checked against the
    sequential replay in tests)."""
    return _pack_job(src).outcomes


@register_source("allocate_packs_contents")
def allocate_packs_contents(src):
    """Pack contents after the batch."""
    return _pack_job(src).tables["pack_contents"]


# C22 -------------------------------------------------------------------------

@register_source("order_line_stream")
def order_line_stream(src):
    """The line events of C13 (without finalizations) replayed as a stream.

    The derived events are written as parquet files into a fresh folder under
    the session's checkpoint folder, then processed with ``availableNow``; the
    result is the sink (rows-only; tests compare it with the batch job)."""
    import os
    import uuid

    from hortus.session import checkpoint_dir
    from hortus.streaming.order_lines import EVENT_SCHEMA, run_available

    base = os.path.join(checkpoint_dir(src.spark), f"stream-{uuid.uuid4().hex}")
    events = RQ.order_line_changes(src).select(*[f.name for f in EVENT_SCHEMA.fields])
    events.repartitionByRange(4, "ts", "seq").write.parquet(os.path.join(base, "events"))
    return run_available(src.spark, src.tables(), os.path.join(base, "events"), os.path.join(base, "sink"),
                         os.path.join(base, "state"))


# C13 oracle: the ledger as a recursive walk over each species' requests -------

_FIT_LINE_CHANGES = RQ.fit_sql(RQ.ORDER_LINE_CHANGES_SQL, RQ.LINE_CHANGE_COLS)
_C13_CTES = (
    f"req as ({_FIT_LINE_CHANGES}), "
    f"fin_req as ({RQ.FINALIZATIONS_SQL}), "
    "fin as (select ordine, ts fts, seq fseq from (select f.*, row_number() over (partition by f.ordine "
    "order by f.ts, f.seq) k from fin_req f join ordini o on o.id=f.ordine and o.cliente=f.cliente) z where k=1), "
    "b0 as (select r.*, l.quantita q0, s.giacenza stock0, coalesce(o.aperto_or_finalizzato=0, false) "
    "or coalesce(fin.fts < r.ts or (fin.fts = r.ts and fin.fseq < r.seq), false) is_final, "
    "case when r.op not in ('ADD','CHANGE','REMOVE') then 'INVALID' when not coalesce(o.cliente = r.cliente, false) "
    "then '45005' when r.op <> 'REMOVE' and (r.quantita is null or r.quantita < 0) then 'INVALID' end pre "
    "from req r left join ordini o on o.id=r.ordine left join order_lines l on l.ordine=r.ordine "
    "and l.specie_di_pianta=r.specie_di_pianta left join species s on s.codice=r.specie_di_pianta "
    "left join fin on fin.ordine=r.ordine), "
    "base as (select *, row_number() over (partition by specie_di_pianta order by ts, seq) rn from b0), "
    "walk(specie_di_pianta, rn, stock, lines, code, noop) as ("
    "select specie_di_pianta, 0, any_value(stock0), []::struct(o int, q int)[], null::varchar, false "
    "from base group by specie_di_pianta "
    "union all "
    "select y.specie_di_pianta, y.rn, "
    "case when y.code is null and not y.noop then y.stock - (case y.op when 'ADD' then y.quantita "
    "when 'CHANGE' then y.quantita - y.cur else -y.cur end) else y.stock end, "
    "case when y.code is null and not y.noop then list_append(list_filter(y.lines, lambda x: x.o <> y.ordine), "
    "{'o': y.ordine, 'q': case when y.op = 'REMOVE' then -1 else y.quantita end}) else y.lines end, y.code, y.noop "
    "from (select z.*, case when z.pre is not null then z.pre "
    "when z.op = 'ADD' then case when z.stock is not null and z.quantita > z.stock then '45006' when z.is_final then '45007' "
    "when z.cur is not null then '45008' when z.stock is null then '45014' end "
    "when z.op = 'CHANGE' then case when z.cur is null then null when z.quantita - z.cur > z.stock then '45006' "
    "when z.is_final then '45007' end "
    "else case when z.cur is null then null when z.is_final then '45007' end end code, "
    "z.pre is null and z.op in ('CHANGE','REMOVE') and z.cur is null noop "
    "from (select w.stock, w.lines, b.specie_di_pianta, b.rn, b.op, b.ordine, b.quantita, b.pre, b.is_final, "
    "case when len(list_filter(w.lines, lambda x: x.o = b.ordine)) > 0 "
    "then nullif(list_filter(w.lines, lambda x: x.o = b.ordine)[1].q, -1) else b.q0 end cur "
    "from walk w join base b on b.specie_di_pianta=w.specie_di_pianta and b.rn=w.rn+1) z) y)")

C13_OUTCOMES_SQL = W(
    "select b.ts, b.seq, b.op, b.cliente, b.ordine, b.specie_di_pianta, b.quantita, w.stock stock_after, w.code, "
    "case when w.code is not null then 'rejected' when w.noop then 'noop' else 'accepted' end esito, "
    f"{reason_case('w.code')} reason from walk w join base b on b.specie_di_pianta=w.specie_di_pianta and b.rn=w.rn "
    "where w.rn > 0" + RQ.refused_sql(RQ.ORDER_LINE_CHANGES_SQL, RQ.LINE_CHANGE_COLS),
    "ordini", "order_lines", "species", extra=_C13_CTES, recursive=True)

_C13_FINAL = (
    "final as (select w.specie_di_pianta, w.stock, w.lines from walk w join (select specie_di_pianta, max(rn) m "
    "from walk group by 1) x on x.specie_di_pianta=w.specie_di_pianta and w.rn=x.m), "
    "touched as (select specie_di_pianta, e.o ordine, e.q quantita from (select specie_di_pianta, unnest(lines) e "
    "from final) u)")

C13_STOCK_SQL = W(
    "select s.codice, coalesce(f.stock, s.giacenza) giacenza from species s left join final f "
    "on f.specie_di_pianta=s.codice", "ordini", "order_lines", "species", extra=f"{_C13_CTES}, {_C13_FINAL}",
    recursive=True)

C13_LINES_SQL = W(
    "select l.ordine, l.specie_di_pianta, l.quantita from order_lines l where not exists (select 1 from touched t "
    "where t.ordine=l.ordine and t.specie_di_pianta=l.specie_di_pianta) union all "
    "select ordine, specie_di_pianta, quantita from touched where quantita <> -1",
    "ordini", "order_lines", "species", extra=f"{_C13_CTES}, {_C13_FINAL}", recursive=True)

# C12 oracle: the first lines of new orders through the same walk (stock only).
_C12_CTES = (
    f"req as ({RQ.NEW_ORDERS_SQL}), "
    "b0 as (select r.*, s.giacenza stock0, case when r.contatto is null and c.contatto_preferito is null then '45002' "
    "when r.contatto is not null and not exists (select 1 from customer_contacts k where k.contatto=r.contatto "
    "and k.cliente=r.cliente) and not exists (select 1 from referent_contacts k where k.contatto=r.contatto "
    "and k.referente=r.cliente) then '45009' when r.quantita is null or r.quantita < 0 then 'INVALID' end pre "
    "from req r left join customers c on c.codice=r.cliente left join species s on s.codice=r.specie_di_pianta), "
    "base as (select *, row_number() over (partition by specie_di_pianta order by ts, seq) rn from b0), "
    "walk(specie_di_pianta, rn, stock, code) as ("
    "select specie_di_pianta, 0, any_value(stock0), null::varchar from base group by specie_di_pianta "
    "union all select y.specie_di_pianta, y.rn, case when y.code is null then y.stock - y.quantita else y.stock end, "
    "y.code from (select w.stock, b.specie_di_pianta, b.rn, b.quantita, case when b.pre is not null then b.pre "
    "when w.stock is not null and b.quantita > w.stock then '45006' when w.stock is null then '45014' end code "
    "from walk w join base b on b.specie_di_pianta=w.specie_di_pianta and b.rn=w.rn+1) y), "
    "decided as (select b.*, w.stock stock_after, w.code from walk w join base b "
    "on b.specie_di_pianta=w.specie_di_pianta and b.rn=w.rn where w.rn > 0)")

C12_OUTCOMES_SQL = W(
    "select ts, seq, cliente, indirizzo_spedizione, contatto, specie_di_pianta, quantita, stock_after, "
    "case when code is null then cast((select max(id) from ordini) + row_number() over (partition by code is null "
    "order by ts, seq) as int) end id, code, case when code is null then 'accepted' else 'rejected' end esito, "
    f"{reason_case('code')} reason from decided", "customers", "customer_contacts", "referent_contacts", "species",
    "ordini", extra=_C12_CTES, recursive=True)

# C19 oracle: each order's pack requests walked in order with the packed amounts,
# new-pack handles, placed (pack, species) pairs and the next pack number as state.
_C19_CTES = (
    f"req as ({RQ.fit_sql(RQ.PACK_REQUESTS_SQL, RQ.PACK_COLS)}), "
    "b0 as (select r.*, o.aperto_or_finalizzato status, l.quantita ordered, pc.q packed0, "
    "p.numero is not null pack_exists, c.ordine is not null content_exists, coalesce(m.mx, 0) max_pack0 "
    "from req r left join ordini o on o.id=r.ordine "
    "left join order_lines l on l.ordine=r.ordine and l.specie_di_pianta=r.specie_di_pianta "
    "left join (select ordine, specie_di_pianta, sum(quantita) q from pack_contents group by 1,2) pc "
    "on pc.ordine=r.ordine and pc.specie_di_pianta=r.specie_di_pianta "
    "left join packs p on p.ordine=r.ordine and p.numero=r.pacco "
    "left join pack_contents c on c.ordine=r.ordine and c.pacco=r.pacco and c.specie_di_pianta=r.specie_di_pianta "
    "left join (select ordine, max(numero) mx from packs group by 1) m on m.ordine=r.ordine), "
    "base as (select *, row_number() over (partition by ordine order by ts, seq) rn from b0), "
    "walk(ordine, rn, top, packed, handles, placed, code, num) as ("
    "select ordine, 0, any_value(max_pack0), []::struct(sp int, q int)[], []::struct(h varchar, n int)[], "
    "[]::varchar[], null::varchar, null::int from base group by ordine "
    "union all select y.ordine, y.rn, case when y.creating and y.code is null then y.top + 1 else y.top end, "
    "case when y.code is null then list_append(list_filter(y.packed, lambda x: x.sp <> y.specie_di_pianta), "
    "{'sp': y.specie_di_pianta, 'q': y.batch_packed + y.quantita}) else y.packed end, "
    "case when y.creating then list_append(y.handles, {'h': y.new_pack, 'n': case when y.code is null then y.top + 1 end}) "
    "else y.handles end, "
    "case when y.code is null then list_append(y.placed, y.pkey) else y.placed end, y.code, "
    "case when y.code is null then case when y.creating then y.top + 1 else y.number0 end end "
    "from (select z.*, case when z.quantita is null or z.quantita < 0 then 'INVALID' "
    "when z.creating and z.status = 1 then '45034' when z.creating and z.status is null then '45027' "
    "when z.ordered is null then '45020' when z.quantita > z.ordered - (coalesce(z.packed0, 0) + z.batch_packed) then '45015' "
    "when not z.creating and z.number0 is null then '45026' "
    "when not z.creating and (list_contains(z.placed, z.pkey) or (z.new_pack is null and z.content_exists)) then 'DUPLICATE' "
    "end code from (select w.top, w.packed, w.handles, w.placed, b.*, "
    "b.new_pack is not null and len(list_filter(w.handles, lambda x: x.h = b.new_pack)) = 0 creating, "
    "case when b.new_pack is not null then list_filter(w.handles, lambda x: x.h = b.new_pack)[1].n "
    "when b.pack_exists then b.pacco end number0, "
    "case when b.new_pack is not null then 'n:' || b.new_pack else 'o:' || cast(b.pacco as varchar) end "
    "|| ':' || cast(b.specie_di_pianta as varchar) pkey, "
    "coalesce(list_filter(w.packed, lambda x: x.sp = b.specie_di_pianta)[1].q, 0) batch_packed "
    "from walk w join base b on b.ordine=w.ordine and b.rn=w.rn+1) z) y)")

C19_OUTCOMES_SQL = W(
    "select b.ts, b.seq, b.ordine, b.pacco, b.new_pack, b.specie_di_pianta, b.quantita, w.num pack_number, w.code, "
    "case when w.code is null then 'accepted' else 'rejected' end esito, "
    f"{reason_case('w.code')} reason from walk w join base b on b.ordine=w.ordine and b.rn=w.rn where w.rn > 0"
    + RQ.refused_sql(RQ.PACK_REQUESTS_SQL, RQ.PACK_COLS),
    "ordini", "order_lines", "pack_contents", "packs", extra=_C19_CTES, recursive=True)

C19_CONTENTS_SQL = W(
    "select ordine, pacco, specie_di_pianta, quantita from pack_contents union all "
    "select b.ordine, w.num, b.specie_di_pianta, b.quantita from walk w join base b on b.ordine=w.ordine "
    "and b.rn=w.rn where w.rn > 0 and w.code is null",
    "ordini", "order_lines", "pack_contents", "packs", extra=_C19_CTES, recursive=True)

# The stream applies the same ledger to the same events, without finalizations.
C22_SQL = W(
    "select b.ts, b.seq, b.op, b.cliente, b.ordine, b.specie_di_pianta, b.quantita, w.code, "
    "case when w.code is not null then 'rejected' when w.noop then 'noop' else 'accepted' end esito, "
    "w.stock stock_after from walk w join base b on b.specie_di_pianta=w.specie_di_pianta and b.rn=w.rn "
    "where w.rn > 0", "ordini", "order_lines", "species",
    extra=_C13_CTES.replace(_FIT_LINE_CHANGES, RQ.ORDER_LINE_CHANGES_SQL).replace(f"fin_req as ({RQ.FINALIZATIONS_SQL})",
                            f"fin_req as (select * from ({RQ.FINALIZATIONS_SQL}) q where false)"), recursive=True)

_ORACLES_LATE = {"order_line_stream": C22_SQL,
                 "allocate_packs": C19_OUTCOMES_SQL,
                 "allocate_packs_contents": C19_CONTENTS_SQL,
                 "open_orders": C12_OUTCOMES_SQL,
                 "apply_order_line_changes": C13_OUTCOMES_SQL,
                 "apply_order_line_changes_stock": C13_STOCK_SQL,
                 "apply_order_line_changes_lines": C13_LINES_SQL}

for _name, _sql in _ORACLES_LATE.items():
    set_oracle(_name, _sql)
