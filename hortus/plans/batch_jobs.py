"""Set-wise change jobs (C2-C11, C15-C18) over request batches derived from the test tables.

Each batch rule is one SQL text in the subset Spark and DuckDB share; Spark
runs it with ``spark.sql(text, **dataframes)``, the oracle runs the same text.
The oracles then state each job's rules again in SQL (window counts for "an
earlier accepted request in the batch"), independently of the Spark plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from hortus.functions import codes
from hortus.operators import catalog as RC
from hortus.operators import orders as RO
from hortus.operators.jobs import catalog as CA
from hortus.operators.jobs import customers as CU
from hortus.operators.jobs import suppliers as SU
from hortus.plans import requests as RQ
from hortus.plans.fixture_sql import with_fixtures as W
from hortus.plans.registry import register_source
from hortus.sources.testdata import TestdataTables

_ENGINE = {"customers": "customers_with_key", "ordini": "orders"}


def derive(src: TestdataTables, text: str) -> DataFrame:
    """Run a batch rule on Spark; ``{name}`` placeholders are raw or engine tables."""
    names = set(re.findall(r"\{(\w+)\}", text))
    frames = {n: (getattr(src, _ENGINE.get(n, n)) if n in _ENGINE or n in ("species", "colourings", "referents")
                  else src.raw(n)) for n in names}
    return src.spark.sql(text, **frames)


def as_sql(text: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", text)


def reason_case(col: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in codes.REASONS.items())
    return f"case {col} {whens} end"


def _earlier(key: str, cond: str = "s is null") -> str:
    """SQL: an earlier request on the same key met ``cond`` (window count)."""
    return (f"coalesce(count(case when {cond} then 1 end) over (partition by {key} order by ts, seq "
            f"rows between unbounded preceding and 1 preceding), 0) > 0")


def _outcome(code: str = "code", noop: str = "false") -> str:
    return (f"case when {code} is not null then 'rejected' when {noop} then 'noop' else 'accepted' end esito, "
            f"{reason_case(code)} reason")


# C2 --------------------------------------------------------------------------

SPECIES_REQ = (
    "select timestamp '2003-01-01 00:00:00' ts, cast(p_partkey as bigint) seq, p_name nome_comune, "
    "case when p_size%4=0 then concat(p_brand,' ',p_type,' ',cast(p_partkey as string)) "
    "else concat('Nova ',p_type,' ',cast(p_size as string)) end nome_latino, cast(p_size%2 as int) interni_or_esterni, "
    "case when p_size%3=0 then null else split_part(p_name,' ',1) end colore, "
    "cast(case when p_size=49 then 2 when p_size%5=0 then 1 else 0 end as int) esotica_si_no, "
    "cast(p_partkey%100 as int) giacenza, cast(p_retailprice as decimal(7,2)) prezzo from {part}")

_C2_CTES = (
    f"r as ({as_sql(SPECIES_REQ)}), "
    "c as (select r.*, case when giacenza<0 then 'INVALID' when interni_or_esterni not in (0,1) or esotica_si_no not in (0,1) "
    "then '45022' when exists (select 1 from species s where s.nome_latino=r.nome_latino) then '45021' end pre, "
    "case when prezzo is null or prezzo<0 then 'INVALID' end post from r), "
    "d as (select *, case when pre is null and post is null then null else 'x' end s from c), "
    f"e as (select *, coalesce(pre, case when {_earlier('nome_latino')} then '45021' end, post) code from d)")


@register_source("load_species", W(
    f"select ts, seq, nome_comune, nome_latino, interni_or_esterni, colore, esotica_si_no, giacenza, prezzo, code, "
    f"{_outcome()}, case when code is null then cast((select max(codice) from species) + row_number() over "
    "(partition by code is null order by ts, seq) as int) end codice from e", "species", extra=_C2_CTES))
def load_species(src):
    """Outcome and new code per species request."""
    return CA.load_species(src.tables(), derive(src, SPECIES_REQ)).outcomes


# C3 --------------------------------------------------------------------------

REMOVE_SPECIES_REQ = (
    "select timestamp '2003-02-01 00:00:00' ts, cast(p_partkey as bigint) seq, "
    "cast(case when p_size=1 then p_partkey+1000000000 else p_partkey end as int) codice from {part}")


@register_source("remove_species", W(
    "select ts, seq, codice, code, " + _outcome(noop="not known") + " from (select r.*, "
    "exists (select 1 from species s where s.codice=r.codice) known, "
    "case when exists (select 1 from species s where s.codice=r.codice) and (r.codice in (select specie_di_pianta from order_lines) "
    "or r.codice in (select specie_di_pianta from pack_contents) or r.codice in (select specie_richiesta from supply_requests)) "
    f"then '45029' end code from ({as_sql(REMOVE_SPECIES_REQ)}) r) z",
    "species", "order_lines", "pack_contents", "supply_requests"))
def remove_species(src):
    """Outcome per removal (held species 45029, unknown a no-op)."""
    return CA.remove_species(src.tables(), derive(src, REMOVE_SPECIES_REQ)).outcomes


@register_source("remove_species_table", W(
    f"select * from species where codice not in (select r.codice from ({as_sql(REMOVE_SPECIES_REQ)}) r) "
    "or codice in (select specie_di_pianta from order_lines) or codice in (select specie_di_pianta from pack_contents) "
    "or codice in (select specie_richiesta from supply_requests)",
    "species", "order_lines", "pack_contents", "supply_requests"))
def remove_species_table(src):
    """Species left after the removals."""
    return CA.remove_species(src.tables(), derive(src, REMOVE_SPECIES_REQ)).tables["species"]


# C4, C5 ----------------------------------------------------------------------

COLOUR_REQ = (
    "select l_shipdate ts, cast(l_orderkey*8+l_linenumber as bigint) seq, cast(l_partkey as int) specie_fiorita, "
    "case when l_linenumber%2=0 then 'white' else 'red' end colore from {lineitem}")

COLOUR_COLS = "ts, seq, specie_fiorita, colore"

_C4_CTES = (
    f"r as ({RQ.fit_sql(as_sql(COLOUR_REQ), COLOUR_COLS)}), "
    "c as (select r.*, case when s.verde_or_fiorita=1 then '45019' when s.codice is null then '45014' "
    "when exists (select 1 from colourings k where k.specie_fiorita=r.specie_fiorita and k.colore=r.colore) then '45030' end s "
    "from r left join species s on s.codice=r.specie_fiorita), "
    f"e as (select *, coalesce(s, case when {_earlier('specie_fiorita, colore')} then '45030' end) code from c)")


@register_source("add_colourings", W(
    f"select ts, seq, specie_fiorita, colore, code, {_outcome()} from e" + RQ.refused_sql(as_sql(COLOUR_REQ), COLOUR_COLS),
    "species", "colourings", extra=_C4_CTES))
def add_colourings(src):
    """C4: outcome per colour request."""
    return CA.add_colourings(src.tables(), derive(src, COLOUR_REQ)).outcomes


@register_source("remove_colourings", W(
    "select ts, seq, specie_fiorita, colore, cast(null as varchar) code, "
    + _outcome(noop="not present or " + _earlier("specie_fiorita, colore", "present")) +
    " from (select r.*, exists (select 1 from colourings k where k.specie_fiorita=r.specie_fiorita "
    f"and k.colore=r.colore) present from ({RQ.fit_sql(as_sql(COLOUR_REQ), COLOUR_COLS)}) r) z"
    + RQ.refused_sql(as_sql(COLOUR_REQ), COLOUR_COLS), "species", "colourings"))
def remove_colourings(src):
    """Removed (accepted) or absent (no-op) per colour removal."""
    return CA.remove_colourings(src.tables(), derive(src, COLOUR_REQ)).outcomes


# C6, C7 ----------------------------------------------------------------------

PRIVATE_REQ = (
    "select timestamp '2003-03-01 00:00:00' ts, cast(c_custkey as bigint) seq, "
    "case c_custkey%4 when 0 then lower(concat('ABCDEF',substring(lpad(cast(c_custkey as string),7,'0'),1,2),'A',"
    "substring(lpad(cast(c_custkey as string),7,'0'),3,2),'B',substring(lpad(cast(c_custkey as string),7,'0'),5,3),'C')) "
    "when 1 then lpad(cast(c_custkey as string),11,'0') when 2 then concat('BAD',cast(c_custkey as string)) "
    "else concat('NUOVOX',substring(lpad(cast(c_custkey%5000 as string),7,'0'),1,2),'A',"
    "substring(lpad(cast(c_custkey%5000 as string),7,'0'),3,2),'B',substring(lpad(cast(c_custkey%5000 as string),7,'0'),5,3),'C') end codice, "
    "c_name nome, concat('Res new ',cast(c_custkey as string)) residenza, "
    "case when c_custkey%2=0 then null else concat('Bill new ',cast(c_custkey as string)) end fatturazione from {customer}")

RETAIL_REQ = (
    "select timestamp '2003-03-02 00:00:00' ts, cast(c_custkey as bigint) seq, "
    "case c_custkey%3 when 0 then lpad(cast(c_custkey as string),11,'0') "
    "when 1 then concat('ABCDEF',substring(lpad(cast(c_custkey as string),7,'0'),1,2),'A',"
    "substring(lpad(cast(c_custkey as string),7,'0'),3,2),'B',substring(lpad(cast(c_custkey as string),7,'0'),5,3),'C') "
    "else lpad(cast(50000000+c_custkey%7000 as string),11,'0') end codice, "
    "c_name nome, concat('Res new ',cast(c_custkey as string)) residenza, cast(null as string) fatturazione, "
    "concat('Ref new ',cast(c_custkey as string)) nome_ref, 'Bianchi' cognome_ref from {customer}")

_PRIVATE_RX = CU.PRIVATE_CODE
_RETAIL_RX = CU.RETAIL_CODE


def _register_ctes(req: str, private: int, upper: bool) -> str:
    code = "upper(codice)" if upper else "codice"
    mismatch = f"regexp_matches(codice, '{_RETAIL_RX if private else _PRIVATE_RX}')"
    return (
        f"r0 as ({as_sql(req)}), r as (select * replace ({code} as codice) from r0), "
        f"c as (select r.*, case when {mismatch} then '45000' when not regexp_matches(codice, '{_PRIVATE_RX}') "
        f"and not regexp_matches(codice, '{_RETAIL_RX}') then '45001' when codice in (select codice from customers) "
        "then '45011' when residenza is null or nome is null then 'INVALID' end s from r), "
        f"e as (select *, coalesce(s, case when {_earlier('codice')} then '45011' end) code from c)")


@register_source("load_private_customers", W(
    f"select ts, seq, codice, nome, residenza, fatturazione, code, {_outcome()} from e", "customers",
    extra=_register_ctes(PRIVATE_REQ, 1, True)))
def load_private_customers(src):
    """Outcome per private registration."""
    return CU.load_private_customers(src.tables(), derive(src, PRIVATE_REQ)).outcomes


@register_source("load_retail_customers", W(
    f"select ts, seq, codice, nome, residenza, fatturazione, nome_ref, cognome_ref, code, {_outcome()} from e",
    "customers", extra=_register_ctes(RETAIL_REQ, 0, False)))
def load_retail_customers(src):
    """Outcome per retailer registration."""
    return CU.load_retail_customers(src.tables(), derive(src, RETAIL_REQ)).outcomes


# C8 --------------------------------------------------------------------------

ADDRESS_REQ = (
    "select o_orderdate ts, cast(o_orderkey as bigint) seq, c.codice cliente, "
    "case when o_orderkey%2=0 then 'residenza' else 'fatturazione' end tipo, "
    "case when o_orderkey%10=0 then null else concat('Addr ',cast(o_orderkey as string)) end indirizzo "
    "from {orders} join {customers} c on c.c_custkey=o_custkey")


@register_source("update_addresses", W(
    "select c.codice, c.nome, coalesce(rs.v, c.indirizzo_residenza) indirizzo_residenza, "
    "case when bl.cliente is not null then bl.v else c.indirizzo_fatturazione end indirizzo_fatturazione, "
    "c.privato_or_rivendita, c.contatto_preferito from customers c "
    "left join (select cliente, arg_max(indirizzo, struct_pack(ts := ts, seq := seq)) v from r "
    "where tipo='residenza' and indirizzo is not null group by 1) rs on rs.cliente=c.codice "
    "left join (select cliente, arg_max_null(indirizzo, struct_pack(ts := ts, seq := seq)) v from r "
    "where tipo='fatturazione' group by 1) bl on bl.cliente=c.codice",
    "customers", extra=f"r as ({as_sql(ADDRESS_REQ)})"))
def update_addresses(src):
    """Customers after the address changes (latest per customer and kind)."""
    return CU.update_addresses(src.tables(), derive(src, ADDRESS_REQ)).tables["customers"]


# C9, C10, C11 ------------------------------------------------------------------

ADD_CONTACT_REQ = (
    "select o_orderdate ts, cast(o_orderkey as bigint) seq, "
    "case when o_orderpriority='5-LOW' then concat('X',c.codice) else c.codice end owner, "
    "case o_orderkey%3 when 0 then concat('c',cast(o_custkey as string),'@example.com') "
    "when 1 then concat('n',cast(o_custkey as string),'@example.com') else concat('o',cast(o_orderkey as string),'@example.com') end contatto, "
    "case when o_orderkey%11=0 then 'fax' else 'email' end tipo from {orders} join {customers} c on c.c_custkey=o_custkey")

_C9_CTES = (
    f"r as ({as_sql(ADD_CONTACT_REQ)}), "
    "c as (select r.*, case when tipo not in ('telefono','cellulare','email') or contatto is null then 'INVALID' "
    "when contatto in (select valore from contacts) then '45010' when owner not in (select codice from customers) "
    "then 'UNKNOWN_KEY' end s from r), "
    f"e as (select *, case when s='INVALID' then s when {_earlier('contatto')} then '45010' else s end code from c)")


@register_source("add_customer_contacts", W(
    f"select ts, seq, owner, contatto, tipo, code, {_outcome()} from e", "customers", "contacts", extra=_C9_CTES))
def add_customer_contacts(src):
    """Outcome per new customer contact."""
    return CU.add_contacts(src.tables(), derive(src, ADD_CONTACT_REQ), "customer").outcomes


REMOVE_CONTACT_REQ = (
    "select timestamp '2003-04-01 00:00:00' ts, cast(c_custkey as bigint) seq, codice owner, "
    "case c_custkey%3 when 0 then concat('+39',lpad(cast(c_custkey as string),9,'0')) "
    "when 1 then concat('c',cast(c_custkey as string),'@example.com') "
    "else concat('c',cast(c_custkey+1 as string),'@example.com') end contatto from {customers}")


@register_source("remove_customer_contacts", W(
    "select ts, seq, owner, contatto, code, " + _outcome() + " from (select *, case when not owned or "
    + _earlier("contatto", "owned and not used") + " then '45009' when used then '45012' end code from "
    "(select r.*, exists (select 1 from customer_contacts k where k.cliente=r.owner and k.contatto=r.contatto) owned, "
    f"r.contatto in (select contatto from ordini) used from ({as_sql(REMOVE_CONTACT_REQ)}) r) z) y",
    "customers", "customer_contacts", "ordini"))
def remove_customer_contacts(src):
    """Outcome per customer contact removal."""
    return CU.remove_contacts(src.tables(), derive(src, REMOVE_CONTACT_REQ), "customer").outcomes


PREFERRED_REQ = (
    "select timestamp '2003-05-01 00:00:00' ts, cast(c_custkey as bigint) seq, codice owner, "
    "case c_custkey%4 when 0 then concat('+39',lpad(cast(c_custkey as string),9,'0')) "
    "when 1 then concat('c',cast(c_custkey as string),'@example.com') "
    "when 2 then concat('c',cast(c_custkey+1 as string),'@example.com') else cast(null as string) end contatto from {customers}")


@register_source("set_preferred_customer_contacts", W(
    "select ts, seq, owner, contatto, code, " + _outcome() + " from (select r.*, case when r.contatto is not null "
    "and r.contatto not in (select valore from contacts) then '45013' when r.contatto is not null and not exists "
    "(select 1 from customer_contacts k where k.cliente=r.owner and k.contatto=r.contatto) then '45009' end code "
    f"from ({as_sql(PREFERRED_REQ)}) r) z", "customers", "contacts", "customer_contacts"))
def set_preferred_customer_contacts(src):
    """C11: outcome per preferred-contact change."""
    return CU.set_preferred_contacts(src.tables(), derive(src, PREFERRED_REQ), "customer").outcomes


@register_source("set_preferred_customer_contacts_table", W(
    "select c.codice, c.nome, c.indirizzo_residenza, c.indirizzo_fatturazione, c.privato_or_rivendita, "
    "case when a.owner is not null then a.contatto else c.contatto_preferito end contatto_preferito "
    "from customers c left join (select r.owner, r.contatto from r where (r.contatto is null or "
    "exists (select 1 from customer_contacts k where k.cliente=r.owner and k.contatto=r.contatto))) a on a.owner=c.codice",
    "customers", "customer_contacts", extra=f"r as ({as_sql(PREFERRED_REQ)})"))
def set_preferred_customer_contacts_table(src):
    """C11: customers after the preferred-contact changes."""
    return CU.set_preferred_contacts(src.tables(), derive(src, PREFERRED_REQ), "customer").tables["customers"]


# C15-C18 -----------------------------------------------------------------------

SUPPLIER_REQ = (
    "select timestamp '2003-06-01 00:00:00' ts, cast(s_suppkey as bigint) seq, "
    "case s_suppkey%3 when 0 then lower(concat('SUPPLI',substring(lpad(cast(s_suppkey as string),7,'0'),1,2),'A',"
    "substring(lpad(cast(s_suppkey as string),7,'0'),3,2),'B',substring(lpad(cast(s_suppkey as string),7,'0'),5,3),'C')) "
    "when 1 then concat('BAD',cast(s_suppkey as string)) "
    "else concat('NUOVOS',substring(lpad(cast(s_suppkey%40 as string),7,'0'),1,2),'A',"
    "substring(lpad(cast(s_suppkey%40 as string),7,'0'),3,2),'B',substring(lpad(cast(s_suppkey%40 as string),7,'0'),5,3),'C') end "
    "codice_fiscale, s_name nome, cast(case when s_suppkey%5=0 then s_suppkey+1000000000 else s_suppkey end as int) "
    "specie_di_pianta, case when s_suppkey%7=0 then concat('Via ',cast(s_suppkey as string)) "
    "else concat('New ',cast(s_suppkey%30 as string)) end indirizzo from {supplier}")


_C15_CTES = (
    f"r0 as ({as_sql(SUPPLIER_REQ)}), "
    "r as (select r0.* replace (upper(codice_fiscale) as codice_fiscale), "
    f"coalesce(regexp_matches(r0.codice_fiscale, '{codes.FISCAL_CODE}'), false) shape_ok from r0), "
    "c as (select r.*, case when not shape_ok then '45023' when codice_fiscale in (select codice_fiscale from suppliers) "
    "then '45035' when specie_di_pianta not in (select codice from species) then 'UNKNOWN_KEY' "
    "when indirizzo is null or indirizzo in (select indirizzo from supplier_addresses) then '45035' end s, "
    "row_number() over (order by ts, seq) rn from r), "
    "walk(rn, codes, addrs, code) as (select 0, []::varchar[], []::varchar[], null::varchar "
    "union all select y.rn, case when y.code is null then list_append(y.codes, y.codice_fiscale) else y.codes end, "
    "case when y.code is null then list_append(y.addrs, y.indirizzo) else y.addrs end, y.code from "
    "(select c.rn, c.codice_fiscale, c.indirizzo, w.codes, w.addrs, coalesce(c.s, case when "
    "list_contains(w.codes, c.codice_fiscale) or list_contains(w.addrs, c.indirizzo) then '45035' end) code "
    "from walk w join c on c.rn=w.rn+1) y)")


@register_source("load_suppliers", W(
    "select c.ts, c.seq, c.codice_fiscale, c.nome, c.specie_di_pianta, c.indirizzo, w.code, "
    f"{_outcome('w.code')}, case when w.code is null then cast((select max(codice_fornitore) from suppliers) + "
    "row_number() over (partition by w.code is null order by c.ts, c.seq) as int) end codice_fornitore "
    "from walk w join c on c.rn=w.rn where w.rn > 0", "suppliers", "species", "supplier_addresses",
    extra=_C15_CTES, recursive=True))
def load_suppliers(src):
    """Outcome and new code per supplier request (the oracle walks the batch
    in order with the codes and addresses taken so far)."""
    return SU.load_suppliers(src.tables(), derive(src, SUPPLIER_REQ)).outcomes


ADDRESS_SUP_REQ = (
    "select timestamp '2003-07-01 00:00:00' ts, cast(s_suppkey as bigint) seq, "
    "cast(case when s_suppkey%4=0 then s_suppkey+1000000 else s_suppkey end as int) fornitore, "
    "concat('Via ',cast(s_suppkey%100 as string)) indirizzo from {supplier}")


@register_source("add_supplier_addresses", W(
    "select ts, seq, fornitore, indirizzo, code, " + _outcome() + " from (select *, coalesce(s, case when "
    + _earlier("indirizzo") + " then '45031' end) code from (select r.*, case when fornitore not in "
    "(select codice_fornitore from suppliers) then '45032' when indirizzo in (select indirizzo from supplier_addresses) "
    f"then '45031' when indirizzo is null then 'INVALID' end s from ({as_sql(ADDRESS_SUP_REQ)}) r) z) y",
    "suppliers", "supplier_addresses"))
def add_supplier_addresses(src):
    """Outcome per supplier address."""
    return SU.add_supplier_addresses(src.tables(), derive(src, ADDRESS_SUP_REQ)).outcomes


AVAIL_REQ = (
    "select l_shipdate ts, cast(l_orderkey*8+l_linenumber as bigint) seq, cast(l_suppkey as int) fornitore, "
    "cast(l_partkey+l_linenumber%2 as int) specie_di_pianta from {lineitem}")
AVAIL_COLS = "ts, seq, fornitore, specie_di_pianta"


@register_source("add_availability", W(
    "select ts, seq, fornitore, specie_di_pianta, code, " + _outcome() + " from (select *, coalesce(s, case when "
    + _earlier("fornitore, specie_di_pianta") + " then '45018' end) code from (select r.*, case when fornitore not in "
    "(select codice_fornitore from suppliers) or specie_di_pianta not in (select codice from species) then '45025' "
    "when exists (select 1 from availability v where v.fornitore=r.fornitore and v.specie_di_pianta=r.specie_di_pianta) "
    f"then '45018' end s from ({RQ.fit_sql(as_sql(AVAIL_REQ), AVAIL_COLS)}) r) z) y" + RQ.refused_sql(as_sql(AVAIL_REQ), AVAIL_COLS),
    "suppliers", "species", "availability"))
def add_availability(src):
    """C17: outcome per availability request."""
    return SU.add_availability(src.tables(), derive(src, AVAIL_REQ)).outcomes


SUPPLY_REQ = (
    "select l_shipdate ts, cast(l_orderkey*8+l_linenumber as bigint) seq, cast(l_suppkey as int) fornitore, "
    "cast(case when l_linenumber=7 then l_partkey+1 else l_partkey end as int) specie_di_pianta, "
    "cast(l_quantity as int) quantita from {lineitem}")
SUPPLY_COLS = "ts, seq, fornitore, specie_di_pianta, quantita"


@register_source("load_supply_requests", W(
    "select ts, seq, fornitore, specie_di_pianta, quantita, code, " + _outcome() + " from (select *, coalesce(s, "
    "case when " + _earlier("ts, fornitore, specie_di_pianta") + " then 'DUPLICATE' end) code from (select r.*, "
    "case when quantita is null or quantita<0 then 'INVALID' when not exists (select 1 from availability v where "
    "v.fornitore=r.fornitore and v.specie_di_pianta=r.specie_di_pianta) then '45024' when exists (select 1 from "
    "supply_requests q where q.data=r.ts and q.fornitore_scelto=r.fornitore and q.specie_richiesta=r.specie_di_pianta) "
    f"then 'DUPLICATE' end s from ({RQ.fit_sql(as_sql(SUPPLY_REQ), SUPPLY_COLS)}) r) z) y"
    + RQ.refused_sql(as_sql(SUPPLY_REQ), SUPPLY_COLS), "availability", "supply_requests"))
def load_supply_requests(src):
    """Outcome per supply request."""
    return SU.load_supply_requests(src.tables(), derive(src, SUPPLY_REQ)).outcomes


# C9-C11 for referents ------------------------------------------------------------

ADD_REF_CONTACT_REQ = (
    "select o_orderdate ts, cast(o_orderkey as bigint) seq, "
    "case when o_orderpriority='5-LOW' then concat('X',c.codice) else c.codice end owner, "
    "case o_orderkey%3 when 0 then concat('ref',cast(o_custkey as string),'@example.com') "
    "when 1 then concat('rn',cast(o_custkey as string),'@example.com') "
    "else concat('ro',cast(o_orderkey as string),'@example.com') end contatto, "
    "case when o_orderkey%11=0 then 'pager' else 'telefono' end tipo "
    "from {orders} join {customers} c on c.c_custkey=o_custkey where c.privato_or_rivendita=0")

_C9R_CTES = (
    f"r as ({as_sql(ADD_REF_CONTACT_REQ)}), "
    "c as (select r.*, case when tipo not in ('telefono','cellulare','email') or contatto is null then 'INVALID' "
    "when contatto in (select valore from contacts) then '45010' when owner not in (select rivendita from referents) "
    "then 'UNKNOWN_KEY' end s from r), "
    f"e as (select *, case when s='INVALID' then s when {_earlier('contatto')} then '45010' else s end code from c)")


@register_source("add_referent_contacts", W(
    f"select ts, seq, owner, contatto, tipo, code, {_outcome()} from e", "customers", "referents", "contacts",
    extra=_C9R_CTES))
def add_referent_contacts(src):
    """C9 for referents: one request per retailer order."""
    return CU.add_contacts(src.tables(), derive(src, ADD_REF_CONTACT_REQ), "referent").outcomes


REMOVE_REF_CONTACT_REQ = (
    "select timestamp '2003-04-02 00:00:00' ts, cast(c_custkey as bigint) seq, codice owner, "
    "case c_custkey%2 when 0 then concat('ref',cast(c_custkey as string),'@example.com') "
    "else concat('ref',cast(c_custkey+1 as string),'@example.com') end contatto "
    "from {customers} where privato_or_rivendita=0")


@register_source("remove_referent_contacts", W(
    "select ts, seq, owner, contatto, code, " + _outcome() + " from (select *, case when not owned or "
    + _earlier("contatto", "owned and not used") + " then '45009' when used then '45012' end code from "
    "(select r.*, exists (select 1 from referent_contacts k where k.referente=r.owner and k.contatto=r.contatto) owned, "
    f"r.contatto in (select contatto from ordini) used from ({as_sql(REMOVE_REF_CONTACT_REQ)}) r) z) y",
    "customers", "referent_contacts", "ordini"))
def remove_referent_contacts(src):
    """C10 for referents: removal requests, own or another retailer's referent contact."""
    return CU.remove_contacts(src.tables(), derive(src, REMOVE_REF_CONTACT_REQ), "referent").outcomes


@register_source("remove_referent_contacts_table", W(
    "select r.rivendita, r.nome, r.cognome, case when r.contatto_preferito in (select z.contatto from "
    f"({as_sql(REMOVE_REF_CONTACT_REQ)}) z join referent_contacts k on k.referente=z.owner and k.contatto=z.contatto "
    "where z.contatto not in (select contatto from ordini)) then null else r.contatto_preferito end contatto_preferito "
    "from referents r", "customers", "referents", "referent_contacts", "ordini"))
def remove_referent_contacts_table(src):
    """C10 for referents: referents after the removals (preferred contact cleared when removed)."""
    return CU.remove_contacts(src.tables(), derive(src, REMOVE_REF_CONTACT_REQ), "referent").tables["referents"]


PREFERRED_REF_REQ = (
    "select timestamp '2003-05-02 00:00:00' ts, cast(c_custkey as bigint) seq, codice owner, "
    "case c_custkey%3 when 0 then concat('ref',cast(c_custkey as string),'@example.com') "
    "when 1 then concat('c',cast(c_custkey as string),'@example.com') else concat('zz',cast(c_custkey as string)) end contatto "
    "from {customers} where privato_or_rivendita=0")


@register_source("set_preferred_referent_contacts", W(
    "select ts, seq, owner, contatto, code, " + _outcome() + " from (select r.*, case when r.contatto is not null "
    "and r.contatto not in (select valore from contacts) then '45013' when r.contatto is not null and not exists "
    "(select 1 from referent_contacts k where k.referente=r.owner and k.contatto=r.contatto) then '45009' end code "
    f"from ({as_sql(PREFERRED_REF_REQ)}) r) z", "customers", "contacts", "referent_contacts"))
def set_preferred_referent_contacts(src):
    """C11 for referents: own referent contact, the retailer's own contact (45009), unknown (45013)."""
    return CU.set_preferred_contacts(src.tables(), derive(src, PREFERRED_REF_REQ), "referent").outcomes


# R4 / R9 request checks -----------------------------------------------------------

REPORT_REQ = (
    "select case when o_orderpriority='2-HIGH' then lpad(cast(o_custkey+1 as string),11,'0') else c.codice end cliente, "
    "cast(case when o_orderpriority='3-MEDIUM' then o_orderkey+1000000000 else o_orderkey end as int) ordine "
    "from {orders} join {customers} c on c.c_custkey=o_custkey")


@register_source("order_report_requests", W(
    "select r.cliente, r.ordine, case when o.cliente is not null and o.cliente <> r.cliente then '45005' "
    "when o.cliente is null then '45016' end code, "
    "case when o.cliente is not null and o.cliente <> r.cliente then 'rejected' when o.cliente is null then 'rejected' "
    "else 'accepted' end esito, case when o.cliente is not null and o.cliente <> r.cliente then "
    f"'{codes.REASONS[codes.NOT_OWNER]}' when o.cliente is null then '{codes.REASONS[codes.UNKNOWN_ORDER]}' end reason "
    f"from ({as_sql(REPORT_REQ)}) r left join ordini o on o.id=r.ordine", "customers", "ordini"))
def order_report_requests(src):
    """R4 request checks: one report request per order (some by another customer, some for unknown orders)."""
    return RO.order_report_requests(src.tables(), derive(src, REPORT_REQ))


SPECIES_REPORT_REQ = (
    "select cast(case when p_size>45 then p_partkey+1000000000 else p_partkey end as int) codice from {part}")


@register_source("species_report_requests", W(
    "select r.codice, s.nome_comune, s.nome_latino, case when s.codice is null then '45014' end code, "
    "case when s.codice is null then 'rejected' else 'accepted' end esito, "
    f"case when s.codice is null then '{codes.REASONS[codes.UNKNOWN_SPECIES]}' end reason "
    f"from ({as_sql(SPECIES_REPORT_REQ)}) r left join species s on s.codice=r.codice", "species"))
def species_report_requests(src):
    """R9a request checks: one report request per part (unknown codes 45014)."""
    return RC.species_report_requests(src.tables(), derive(src, SPECIES_REPORT_REQ))
