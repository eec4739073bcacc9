"""Report queries over all keys, with their DuckDB oracles.

Every oracle is written independently of the Spark plan: the reference forms
of R7 and R10b use the literal reference joins, where the Spark side uses
an equivalent rewrite that avoids the species-only / supplier-only join.
"""

from __future__ import annotations

from hortus.functions.columns import MONTH_NAMES
from hortus.operators import catalog as C
from hortus.operators import contacts as K
from hortus.operators import orders as O
from hortus.operators import packing as P
from hortus.operators import sales as S
from hortus.operators import supply as U
from hortus.plans.fixture_sql import with_fixtures as W
from hortus.plans.registry import register

SALES_YEAR = 2000
LOW_STOCK_N = 10
SEARCH_FRAGMENT = "re"
SUPPLIER_FRAGMENT = "5"

_SPECIES_ROW = (
    "s.codice, s.nome_latino, s.nome_comune, "
    "case when s.interni_or_esterni=1 then 'Indoor' else 'Outdoor' end indoor_outdoor, "
    "case when s.verde_or_fiorita=1 then 'Green' else 'Flowery' end green_flowery, "
    "case when s.esotica_si_no=1 then 'Yes' else 'No' end exotic, p.valore prezzo, s.giacenza "
    "from species s join prices p on p.specie_di_pianta=s.codice and p.data_termine is null")


@register("species_search", W(f"select {_SPECIES_ROW}", "species", "prices"))
def species_search(t):
    """R1 with no fragment: every species with its current price."""
    return C.species_search(t)


@register("species_search_flowering", W(
    f"select {_SPECIES_ROW} where upper(s.nome_comune) like '%{SEARCH_FRAGMENT.upper()}%' and s.verde_or_fiorita=0",
    "species", "prices"))
def species_search_flowering(t):
    """R1 with a lower-case fragment (matched in any case), flowering species only."""
    return C.species_search(t, SEARCH_FRAGMENT, flowering_only=True)


@register("species_colourings", W("select specie_fiorita, upper(colore) colore from colourings", "colourings"))
def species_colourings(t):
    """R2."""
    return C.species_colourings(t)


@register("customer_orders", W(
    "select cliente, id ordine, indirizzo_spedizione, cast(data as date) data, "
    "case when aperto_or_finalizzato=1 then 'Open' else 'Finalized' end stato from ordini", "ordini"))
def customer_orders(t):
    """R3, all orders of every customer."""
    return O.customer_orders(t)


@register("customer_orders_open", W(
    "select cliente, id ordine, indirizzo_spedizione, cast(data as date) data from ordini where aperto_or_finalizzato=1",
    "ordini"))
def customer_orders_open(t):
    """R3, open orders only."""
    return O.customer_orders(t, open_only=True)


_REFERENT = ("case when c.privato_or_rivendita=1 then 'Not expected' else r.nome || ' ' || r.cognome end referente")
_HEADER_FROM = ("from ordini o join customers c on o.cliente=c.codice left join referents r on r.rivendita=c.codice")


@register("order_report_header", W(
    "select o.id ordine, cast(o.data as date) data, o.indirizzo_spedizione, o.contatto, "
    f"case when o.aperto_or_finalizzato=1 then 'Open' else 'Finalized' end stato, {_REFERENT} {_HEADER_FROM}",
    "ordini", "customers", "referents"))
def order_report_header(t):
    """R4a."""
    return O.order_report_header(t)


LINES_SQL = (
    "select x.ordine, x.codice, s.nome_comune || ' (' || s.nome_latino || ')' nome, x.valore unit_price, x.quantita, "
    "cast(x.valore*x.quantita as decimal(18,2)) cumulative_price from (select a.ordine, s.codice, a.quantita, p.valore, "
    "row_number() over (partition by a.ordine, s.codice order by p.data_adozione desc) rn from order_lines a "
    "join ordini o on o.id=a.ordine join species s on s.codice=a.specie_di_pianta "
    "join prices p on p.specie_di_pianta=s.codice and p.data_adozione<=o.data) x "
    "join species s on s.codice=x.codice where x.rn=1")


@register("order_report_lines", W(LINES_SQL, "order_lines", "ordini", "species", "prices"))
def order_report_lines(t):
    """Order lines priced as of the order date (as-of join)."""
    return O.order_report_lines(t)


@register("order_report_totals", W(
    f"select ordine, cast(sum(quantita) as bigint) number_of_plants, "
    f"cast(sum(cumulative_price) as decimal(18,2)) total_spending from ({LINES_SQL}) l group by ordine",
    "order_lines", "ordini", "species", "prices"))
def order_report_totals(t):
    """R4c."""
    return O.order_report_totals(t)


@register("order_species", W(
    "select a.ordine, s.codice, s.nome_comune || ' (' || s.nome_latino || ')' nome, a.quantita "
    "from order_lines a join species s on s.codice=a.specie_di_pianta", "order_lines", "species"))
def order_species(t):
    """R5."""
    return O.order_species(t)


@register("order_status", W(
    "select o.id ordine, cast(o.data as date) data, o.indirizzo_spedizione, o.contatto, "
    "case when coalesce(k.q = l.q, false) then 'Completed' when o.aperto_or_finalizzato=1 then 'Already open' "
    f"else 'Not yet completed' end stato, {_REFERENT} {_HEADER_FROM} "
    "left join (select ordine, sum(quantita) q from order_lines group by 1) l on l.ordine=o.id "
    "left join (select ordine, sum(quantita) q from pack_contents group by 1) k on k.ordine=o.id",
    "ordini", "customers", "referents", "order_lines", "pack_contents"))
def order_status(t):
    """R6."""
    return O.order_status(t)


@register("packing_remaining", W(
    "select a.ordine, s.codice, s.nome_comune || ' (' || s.nome_latino || ')' nome, a.quantita, "
    "cast(coalesce(sum(c.quantita),0) as bigint) already_processed from order_lines a "
    "join species s on s.codice=a.specie_di_pianta "
    "left join pack_contents c on a.ordine=c.ordine and a.specie_di_pianta=c.specie_di_pianta group by 1,2,3,4",
    "order_lines", "species", "pack_contents"))
def packing_remaining(t):
    """R7, intended form: packed quantity per (order, species)."""
    return P.packing_remaining(t)


@register("packing_remaining_reference", W(
    "select a.ordine, s.codice, s.nome_comune || ' (' || s.nome_latino || ')' nome, a.quantita, "
    "cast(coalesce(sum(c.quantita),0) as bigint) already_processed from species s "
    "left join pack_contents c on c.specie_di_pianta=s.codice join order_lines a on a.specie_di_pianta=s.codice "
    "where c.ordine=a.ordine or c.ordine is null group by 1,2,3,4",
    "order_lines", "species", "pack_contents"))
def packing_remaining_reference(t):
    """R7, reference form (species-only join, SURVEY Q2)."""
    return P.packing_remaining(t, semantics="reference")


@register("pack_contents_report", W(
    "select c.ordine, c.pacco, s.codice, s.nome_latino, s.nome_comune, c.quantita "
    "from pack_contents c join species s on s.codice=c.specie_di_pianta", "pack_contents", "species"))
def pack_contents_report(t):
    """R8."""
    return P.pack_contents_report(t)


@register("species_info", W("select codice, nome_comune, nome_latino from species", "species"))
def species_info(t):
    """R9a."""
    return C.species_info(t)


_MONTHS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MONTH_NAMES, start=1))


@register("species_monthly_sales", W(
    "select s.codice, m.m mese, m.nm nome_mese, cast(coalesce(sum(x.quantita),0) as bigint) vendite "
    f"from species s cross join (values {_MONTHS}) m(m, nm) left join (select specie_di_pianta, quantita, "
    "month(data) mm from order_lines join ordini on ordine=id where aperto_or_finalizzato=0 "
    f"and year(data)={SALES_YEAR}) x on x.specie_di_pianta=s.codice and x.mm=m.m group by 1,2,3",
    "species", "order_lines", "ordini"))
def species_monthly_sales(t):
    """R9b for one year, 12 rows per species."""
    return S.species_monthly_sales(t, SALES_YEAR)


@register("low_stock_species", W(
    f"select codice, nome_comune || ' (' || nome_latino || ')' nome, giacenza from species "
    f"order by giacenza, codice limit {LOW_STOCK_N}", "species"))
def low_stock_species(t):
    """Top-k species by least stock (the limit is the report)."""
    return U.low_stock_species(t, LOW_STOCK_N)


_TOP_SUPPLIERS_BODY = (
    "select x.specie_di_pianta, x.posizione, x.fornitore, f.nome nome_fornitore, x.n n_richieste from "
    "(select specie_di_pianta, fornitore, n, row_number() over (partition by specie_di_pianta order by n desc, fornitore) "
    "posizione from ({counts}) c) x join suppliers f on f.codice_fornitore=x.fornitore where x.posizione<=5")

_COUNTS_INTENDED = (
    "select v.specie_di_pianta, v.fornitore, count(r.data) n from availability v left join supply_requests r "
    "on r.fornitore_scelto=v.fornitore and r.specie_richiesta=v.specie_di_pianta group by 1,2")
_COUNTS_REFERENCE = (
    "select v.specie_di_pianta, v.fornitore, count(r.fornitore_scelto) n from availability v left join supply_requests r "
    "on r.fornitore_scelto=v.fornitore where r.specie_richiesta=v.specie_di_pianta or r.specie_richiesta is null group by 1,2")


@register("low_stock_top_suppliers", W(
    _TOP_SUPPLIERS_BODY.format(counts=_COUNTS_INTENDED), "availability", "supply_requests", "suppliers"))
def low_stock_top_suppliers(t):
    """R10b for every species: the 5 suppliers with most requests made."""
    return U.low_stock_top_suppliers(t)


@register("low_stock_top_suppliers_reference", W(
    _TOP_SUPPLIERS_BODY.format(counts=_COUNTS_REFERENCE), "availability", "supply_requests", "suppliers"))
def low_stock_top_suppliers_reference(t):
    """R10b, reference form (supplier-only join, SURVEY Q3)."""
    return U.low_stock_top_suppliers(t, semantics="reference")


@register("low_stock_top_suppliers_lowest", W(
    _TOP_SUPPLIERS_BODY.format(counts=_COUNTS_INTENDED)
    + f" and x.specie_di_pianta in (select codice from species order by giacenza, codice limit {LOW_STOCK_N})",
    "availability", "supply_requests", "suppliers", "species"))
def low_stock_top_suppliers_lowest(t):
    """R10b restricted to the R10a species, as the reference report runs it."""
    return U.low_stock_top_suppliers(t, n=LOW_STOCK_N)


@register("supplier_search", W("select codice_fornitore, codice_fiscale, nome from suppliers", "suppliers"))
def supplier_search(t):
    """R11 with no fragment."""
    return U.supplier_search(t)


@register("supplier_search_fragment", W(
    f"select codice_fornitore, codice_fiscale, nome from suppliers where upper(nome) like '%{SUPPLIER_FRAGMENT}%'",
    "suppliers"))
def supplier_search_fragment(t):
    """R11 with a fragment."""
    return U.supplier_search(t, SUPPLIER_FRAGMENT)


@register("supplier_species", W(
    "select v.fornitore, s.codice, s.nome_latino, s.nome_comune from availability v "
    "join species s on s.codice=v.specie_di_pianta", "availability", "species"))
def supplier_species(t):
    """R12."""
    return U.supplier_species(t)


@register("pending_supply_requests", W(
    "select r.specie_richiesta, cast(r.data as date) data, f.codice_fornitore, f.nome nome_fornitore, r.quantita "
    "from supply_requests r join suppliers f on f.codice_fornitore=r.fornitore_scelto where r.pendente_si_no=1",
    "supply_requests", "suppliers"))
def pending_supply_requests(t):
    """R13."""
    return U.pending_supply_requests(t)


@register("customer_contact_list", W(
    "select o.cliente, o.contatto, c.tipo from customer_contacts o join contacts c on c.valore=o.contatto",
    "customer_contacts", "contacts"))
def customer_contact_list(t):
    """R14."""
    return K.customer_contact_list(t)


@register("referent_contact_list", W(
    "select o.referente, o.contatto, c.tipo from referent_contacts o join contacts c on c.valore=o.contatto",
    "referent_contacts", "contacts"))
def referent_contact_list(t):
    """R15."""
    return K.referent_contact_list(t)


@register("supplier_address_list", W(
    "select fornitore, upper(indirizzo) indirizzo from supplier_addresses", "supplier_addresses"))
def supplier_address_list(t):
    """R16."""
    return U.supplier_address_list(t)


@register("contact_owners", W(
    "select c.valore contatto, cc.cliente, rc.referente from contacts c "
    "left join customer_contacts cc on cc.contatto=c.valore left join referent_contacts rc on rc.contatto=c.valore",
    "contacts", "customer_contacts", "referent_contacts"))
def contact_owners(t):
    """R17."""
    return K.contact_owners(t)


@register("current_prices", W(
    "select specie_di_pianta, valore, data_adozione from prices where data_termine is null", "prices"))
def current_prices(t):
    """R18."""
    return C.current_prices(t)
