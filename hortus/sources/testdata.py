"""Engine tables derived from the generated test tables.

The mapping follows FIXTURES.md statement by statement.  Every table is a
lazy plan over the raw parquet files, built on first use, so a query only
scans the raw columns it needs and Catalyst prunes the rest.
"""

from __future__ import annotations

from collections.abc import Mapping
import re

from pyspark.sql import DataFrame, SparkSession

from hortus.session import ensure_semantics, written
from hortus.sources.schemas import TABLES
from hortus.sources.schemas import RAW_TABLES as RAW_SCHEMAS

RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Start dates of the four price periods of the fixtures.
PRICE_PERIOD_STARTS = ("1994-01-01", "1996-01-01", "1998-07-01", "2000-01-01")
RETAIL_SEGMENTS_PRIVATE = ("HOUSEHOLD", "FURNITURE")


def _code(prefix: str, key: str) -> str:
    """SQL: ``prefix`` + 2 digits + A + 2 digits + B + 3 digits + C from a 7-digit key."""
    d = f"lpad(cast({key} as string),7,'0')"
    return (f"concat('{prefix}',substring({d},1,2),'A',substring({d},3,2),'B',substring({d},5,3),'C')")


_STARTS = ", ".join(f"timestamp_ntz '{d} 00:00:00'" for d in PRICE_PERIOD_STARTS)
_PRIVATE = "c_mktsegment in ({})".format(", ".join(f"'{x}'" for x in RETAIL_SEGMENTS_PRIVATE))

# The FIXTURES.md derivations as Spark SQL over the raw tables ({name} are
# DataFrame arguments).  One SQL text per table keeps the driver-side cost of
# building a query to one call per table.  Keys are cast before they are grouped by:
# a cast after it would hide the grouping's partitioning from a join on the keys.
DERIVATIONS: dict[str, str] = {
    "species": (
        "select p_partkey codice, concat(p_brand,' ',p_type,' ',cast(p_partkey as string)) nome_latino, "
        "p_name nome_comune, p_size%2 interni_or_esterni, case when p_size%3=0 then 1 else 0 end verde_or_fiorita, "
        "case when p_size%5=0 then 1 else 0 end esotica_si_no, (p_partkey*37)%400 giacenza from {part}"),
    # 1 to 4 periods per part, generated inside the row: no window, no shuffle.
    "prices": (
        "select p_partkey specie_di_pianta, start data_adozione, cast(p_retailprice+k*5 as decimal(7,2)) valore, "
        "case when k+1<n then element_at(starts, k+2) end data_termine from (select p_partkey, p_retailprice, n, starts, "
        "posexplode(slice(starts, 1, n)) as (k, start) from (select p_partkey, p_retailprice, "
        f"cast(p_partkey%4+1 as int) n, array({_STARTS}) starts from {{part}}))"),
    "customers_with_key": (
        f"select case when {_PRIVATE} then {_code('ABCDEF', 'c_custkey')} "
        "else lpad(cast(c_custkey as string),11,'0') end codice, c_name nome, "
        "concat('Res ',cast(c_custkey as string)) indirizzo_residenza, "
        "case when c_custkey%2=0 then concat('Bill ',cast(c_custkey as string)) end indirizzo_fatturazione, "
        f"case when {_PRIVATE} then 1 else 0 end privato_or_rivendita, "
        "case when c_custkey%3<>0 then concat('c',cast(c_custkey as string),'@example.com') end contatto_preferito, "
        "c_custkey from {customer}"),
    "customers": "select * from {customers_with_key}",
    "referents": (
        "select codice rivendita, concat('Ref',cast(c_custkey as string)) nome, 'Rossi' cognome, "
        "case when c_custkey%4=3 then concat('ref',cast(c_custkey as string),'@example.com') end contatto_preferito "
        "from {customers_with_key} where privato_or_rivendita=0"),
    "customer_contacts_typed": (
        "select concat('c',cast(c_custkey as string),'@example.com') contatto, codice cliente, 'email' tipo "
        "from {customers_with_key} union all select concat('+39',lpad(cast(c_custkey as string),9,'0')), codice, "
        "'cellulare' from {customers_with_key} where c_custkey%2=0"),
    "customer_contacts": "select * from {customer_contacts_typed}",
    "referent_contacts_typed": (
        "select concat('ref',cast(c_custkey as string),'@example.com') contatto, codice referente, 'email' tipo "
        "from {customers_with_key} where privato_or_rivendita=0 and c_custkey%4<>1"),
    "referent_contacts": "select * from {referent_contacts_typed}",
    "contacts": (
        "select contatto valore, tipo from {customer_contacts_typed} "
        "union all select contatto, tipo from {referent_contacts_typed}"),
    "orders": (
        "select o_orderkey id, c.codice cliente, o_orderdate data, case when o_orderstatus='O' then 1 else 0 end "
        "aperto_or_finalizzato, concat('Ship ',cast(o_custkey as string)) indirizzo_spedizione, "
        "concat('c',cast(c.c_custkey as string),'@example.com') contatto "
        "from {orders_raw} join {customers_with_key} c on o_custkey=c.c_custkey"),
    "order_lines": (
        "select cast(l_orderkey as int) ordine, cast(l_partkey as int) specie_di_pianta, sum(l_quantity) quantita "
        "from {lineitem} group by cast(l_orderkey as int), cast(l_partkey as int)"),
    "pack_contents": (
        "select cast(l_orderkey as int) ordine, cast(l_linenumber as int) pacco, cast(l_partkey as int) specie_di_pianta, "
        "sum(l_quantity) quantita from {lineitem} left semi join (select id from {orders} where aperto_or_finalizzato=0) f "
        "on cast(l_orderkey as int)=f.id where l_returnflag<>'N' "
        "group by cast(l_orderkey as int), cast(l_linenumber as int), cast(l_partkey as int)"),
    "packs": "select distinct ordine, pacco numero from {pack_contents}",
    "suppliers": (
        f"select s_suppkey codice_fornitore, {_code('SUPPLI', 's_suppkey')} codice_fiscale, s_name nome "
        "from {supplier}"),
    "supplier_addresses": (
        "select concat('Via ',cast(codice_fornitore as string)) indirizzo, codice_fornitore fornitore from {suppliers} "
        "union all select concat('Depot ',cast(codice_fornitore as string)), codice_fornitore from {suppliers} "
        "where codice_fornitore%2=0"),
    "availability": "select distinct cast(l_partkey as int) specie_di_pianta, cast(l_suppkey as int) fornitore from {lineitem}",
    "supply_requests": (
        "select l_shipdate data, cast(l_suppkey as int) fornitore_scelto, cast(l_partkey as int) specie_richiesta, "
        "sum(l_quantity) quantita, case when max(l_linestatus)='O' then 1 else 0 end pendente_si_no from {lineitem} "
        "group by l_shipdate, cast(l_suppkey as int), cast(l_partkey as int)"),
    "colourings": (
        "select codice specie_fiorita, split_part(nome_comune,' ',1) colore from {species} where verde_or_fiorita=0 "
        "union all select codice, 'white' from {species} where verde_or_fiorita=0 and codice%2=0"),
}

_HELPERS = ("customers_with_key", "customer_contacts_typed", "referent_contacts_typed")


class TestdataTables:
    """Lazily derived engine tables over ``sf_dir``; ``tables()`` returns all."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ensure_semantics(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A generated table, read once with its explicit schema (no inference job)."""
        if name not in self._raw:
            reader = self.spark.read
            if name in RAW_SCHEMAS:
                reader = reader.schema(RAW_SCHEMAS[name])
            self._raw[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def _frame(self, name: str) -> DataFrame:
        if name == "orders_raw":
            return self.raw("orders")
        if name in DERIVATIONS:
            return self.table(name)
        return self.raw(name)

    def table(self, name: str) -> DataFrame:
        """An engine table (or helper), derived once, typed to its schema."""
        if name not in self._built:
            text = DERIVATIONS[name]
            frames = {n: self._frame(n) for n in set(re.findall(r"\{(\w+)\}", text))}
            df = self.spark.sql(text, **frames)
            if name in TABLES:
                df = df.selectExpr(*[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}"
                                     for f in TABLES[name].fields])
            self._built[name] = df
        return self._built[name]

    def keep(self, name: str) -> None:
        """Derives a table that is read many times once, and writes it."""
        self._built[name] = written(self.table(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DERIVATIONS:
            raise AttributeError(name)
        return self.table(name)

    def tables(self) -> "LazyTables":
        """All engine tables; each is built on first use, so a query only plans
        the tables it reads."""
        return LazyTables(self)


class LazyTables(Mapping):
    """Read-only mapping of table name -> DataFrame, derived on first access."""

    def __init__(self, src: TestdataTables):
        self._src = src

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self._src.table(name)

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def load_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """All engine tables derived from the test tables at ``sf_dir``."""
    return TestdataTables(spark, sf_dir).tables()
