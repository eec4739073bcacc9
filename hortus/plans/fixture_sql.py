"""The FIXTURES.md derivations as SQL, for the DuckDB oracles.

The oracle only sees the raw test tables, so each oracle query starts with the
engine tables it needs as CTEs.  The engine's ``orders`` is ``ordini`` here
because ``orders`` is the raw table.  ``prices.data_adozione`` is cast to a
timestamp, the engine type.
"""

from __future__ import annotations

FIXTURE_SQL: dict[str, str] = {
    "species": (
        "select cast(p_partkey as int) codice, concat(p_brand,' ',p_type,' ',cast(p_partkey as string)) nome_latino, "
        "p_name nome_comune, cast(p_size%2 as int) interni_or_esterni, case when p_size%3=0 then 1 else 0 end verde_or_fiorita, "
        "case when p_size%5=0 then 1 else 0 end esotica_si_no, cast((p_partkey*37)%400 as int) giacenza from part"),
    "prices": (
        "select specie_di_pianta, cast(data_adozione as timestamp) data_adozione, valore, "
        "cast(lead(data_adozione) over (partition by specie_di_pianta order by data_adozione) as timestamp) data_termine "
        "from (select cast(p_partkey as int) specie_di_pianta, v.d data_adozione, cast(p_retailprice+v.k*5 as decimal(7,2)) valore "
        "from part cross join (values (0,date '1994-01-01'),(1,date '1996-01-01'),(2,date '1998-07-01'),(3,date '2000-01-01')) v(k,d) "
        "where v.k<=p_partkey%4) x"),
    "customers": (
        "select case when c_mktsegment in ('HOUSEHOLD','FURNITURE') then concat('ABCDEF',substring(lpad(cast(c_custkey as string),7,'0'),1,2),"
        "'A',substring(lpad(cast(c_custkey as string),7,'0'),3,2),'B',substring(lpad(cast(c_custkey as string),7,'0'),5,3),'C') "
        "else lpad(cast(c_custkey as string),11,'0') end codice, c_name nome, concat('Res ',cast(c_custkey as string)) indirizzo_residenza, "
        "case when c_custkey%2=0 then concat('Bill ',cast(c_custkey as string)) end indirizzo_fatturazione, "
        "case when c_mktsegment in ('HOUSEHOLD','FURNITURE') then 1 else 0 end privato_or_rivendita, "
        "case when c_custkey%3<>0 then concat('c',cast(c_custkey as string),'@example.com') end contatto_preferito, c_custkey from customer"),
    "referents": (
        "select codice rivendita, concat('Ref',cast(c_custkey as string)) nome, 'Rossi' cognome, "
        "case when c_custkey%4=3 then concat('ref',cast(c_custkey as string),'@example.com') end contatto_preferito "
        "from customers where privato_or_rivendita=0"),
    "customer_contacts": (
        "select concat('c',cast(c_custkey as string),'@example.com') contatto, codice cliente, 'email' tipo from customers "
        "union all select concat('+39',lpad(cast(c_custkey as string),9,'0')), codice, 'cellulare' from customers where c_custkey%2=0"),
    "referent_contacts": (
        "select concat('ref',cast(c_custkey as string),'@example.com') contatto, codice referente, 'email' tipo "
        "from customers where privato_or_rivendita=0 and c_custkey%4<>1"),
    "contacts": (
        "select contatto valore, tipo from customer_contacts union all select contatto, tipo from referent_contacts"),
    "ordini": (
        "select cast(o_orderkey as int) id, codice cliente, o_orderdate data, case when o_orderstatus='O' then 1 else 0 end "
        "aperto_or_finalizzato, concat('Ship ',cast(o_custkey as string)) indirizzo_spedizione, "
        "concat('c',cast(c_custkey as string),'@example.com') contatto from orders join customers on o_custkey=c_custkey"),
    "order_lines": (
        "select cast(l_orderkey as int) ordine, cast(l_partkey as int) specie_di_pianta, cast(sum(l_quantity) as int) quantita "
        "from lineitem group by 1,2"),
    "pack_contents": (
        "select cast(l_orderkey as int) ordine, l_linenumber pacco, cast(l_partkey as int) specie_di_pianta, "
        "cast(sum(l_quantity) as int) quantita from lineitem join ordini on l_orderkey=id "
        "where aperto_or_finalizzato=0 and l_returnflag<>'N' group by 1,2,3"),
    "packs": "select distinct ordine, pacco numero from pack_contents",
    "suppliers": (
        "select cast(s_suppkey as int) codice_fornitore, concat('SUPPLI',substring(lpad(cast(s_suppkey as string),7,'0'),1,2),'A',"
        "substring(lpad(cast(s_suppkey as string),7,'0'),3,2),'B',substring(lpad(cast(s_suppkey as string),7,'0'),5,3),'C') "
        "codice_fiscale, s_name nome from supplier"),
    "supplier_addresses": (
        "select concat('Via ',cast(codice_fornitore as string)) indirizzo, codice_fornitore fornitore from suppliers "
        "union all select concat('Depot ',cast(codice_fornitore as string)), codice_fornitore from suppliers where codice_fornitore%2=0"),
    "availability": (
        "select distinct cast(l_partkey as int) specie_di_pianta, cast(l_suppkey as int) fornitore from lineitem"),
    "supply_requests": (
        "select l_shipdate data, cast(l_suppkey as int) fornitore_scelto, cast(l_partkey as int) specie_richiesta, "
        "cast(sum(l_quantity) as int) quantita, case when max(l_linestatus)='O' then 1 else 0 end pendente_si_no "
        "from lineitem group by 1,2,3"),
    "colourings": (
        "select codice specie_fiorita, split_part(nome_comune,' ',1) colore from species where verde_or_fiorita=0 "
        "union all select codice, 'white' from species where verde_or_fiorita=0 and codice%2=0"),
}

DEPENDS: dict[str, tuple[str, ...]] = {
    "referents": ("customers",),
    "customer_contacts": ("customers",),
    "referent_contacts": ("customers",),
    "contacts": ("customer_contacts", "referent_contacts"),
    "ordini": ("customers",),
    "pack_contents": ("ordini",),
    "packs": ("pack_contents",),
    "supplier_addresses": ("suppliers",),
    "colourings": ("species",),
}


def with_fixtures(body: str, *tables: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` the named engine tables (and what they depend on), then the
    ``extra`` CTEs, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in DEPENDS.get(name, ()):
            visit(dep)
        ordered.append(name)

    for t in tables:
        visit(t)
    ctes = ",\n".join(f"{name} as ({FIXTURE_SQL[name]})" for name in ordered)
    if extra:
        ctes = f"{ctes},\n{extra}"
    return f"with {'recursive ' if recursive else ''}{ctes}\n{body}"
