"""Table snapshots on Parquet: a job reads one version and commits the next.

    <root>/data/<table>/batch=<id>/[anno=<year>/]part-*.parquet   written once, never changed
    <root>/versions/<n>.json                                      which folders make up version n

A version is a small manifest.  A job writes new folders for the tables it changed,
and of a table kept by year for the changed years only; all else is taken over
from the version before by its paths.  Committing is creating the next manifest, which
fails if someone else has created it.  What a failed job left behind is in no
manifest: it blocks nothing, and the job can simply run again.

Orders and supply requests are kept by the year of their date, and order lines, packs
and pack contents by that of their order, so the yearly sales report and
retention read the years they need (``in_years``).  Within a table (and year)
rows are range partitioned and sorted by key, so a look-up by key meets few row groups,
and the other columns that reports look up have Parquet Bloom filters.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hortus.sources.schemas import KEYS, MAX_LENGTH, TABLES, TOTAL_TABLES

#: Tables kept by year: by a date of their own, or by that of their order.
BY_DATE = {"orders": "data", "supply_requests": "data"}
BY_ORDER = ("order_lines", "packs", "pack_contents", "ordered_totals", "packed_totals")
#: The tables, and the totals kept beside them (a store may be without those).
STORED = {**TABLES, **TOTAL_TABLES}
SORTED_BY = {**KEYS, "ordered_totals": ("ordine",), "packed_totals": ("ordine", "specie_di_pianta"),
             "request_totals": ("specie_richiesta", "fornitore_scelto")}
YEAR = "anno"
#: Further columns that reports and jobs look up by value, with a Bloom filter in every file.
LOOKED_UP = {
    "species": ("nome_latino",), "orders": ("cliente", "contatto"), "order_lines": ("specie_di_pianta",),
    "pack_contents": ("specie_di_pianta",), "customer_contacts": ("cliente",), "referent_contacts": ("referente",),
    "suppliers": ("codice_fiscale",), "supplier_addresses": ("fornitore",), "availability": ("fornitore",),
    "supply_requests": ("specie_richiesta",),
}


class StoredTables(dict):
    """The tables of one version; those kept by year can be read by year."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        super().__init__()
        self.spark, self.root, self.manifest = spark, root, manifest
        for name in manifest:
            self[name] = self._by_year(name).select(*STORED[name].fieldNames())

    def _by_year(self, name: str) -> DataFrame:
        paths = self.manifest[name]
        schema = T.StructType([*STORED[name].fields, T.StructField("batch", T.StringType()),
                               *([T.StructField(YEAR, T.IntegerType())] if is_yearly(name) else [])])
        if not paths:
            return self.spark.createDataFrame([], schema)
        folder = f"{self.root}/data/{name}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/{p}" for p in sorted(paths)])

    def in_years(self, name: str, first: int | None, last: int | None) -> DataFrame:
        """The rows of a table kept by year from ``first`` to ``last`` (None: no bound); the filter prunes folders."""
        df = self._by_year(name)
        if first is not None:
            df = df.filter(F.col(YEAR) >= first)
        if last is not None:
            df = df.filter(F.col(YEAR) <= last)
        return df.select(*STORED[name].fieldNames())


def in_years(tables: Mapping[str, DataFrame], name: str, first: int | None, last: int | None) -> DataFrame:
    """``tables[name]``, without other years than ``first`` to ``last`` where the tables are stored by year.

    Of other tables all rows are returned, so callers still filter by date."""
    return tables.in_years(name, first, last) if isinstance(tables, StoredTables) else tables[name]


def is_yearly(name: str) -> bool:
    return name in BY_DATE or name in BY_ORDER


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed versions under ``root``, oldest first."""
    fs, p = _hadoop(spark, f"{root.rstrip('/')}/versions")
    if not fs.exists(p):
        return []
    names = (st.getPath().getName() for st in fs.listStatus(p))
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def check_lengths(name: str, df: DataFrame) -> DataFrame:
    """Rows whose strings exceed the order system's column widths (empty when clean)."""
    conds = [F.length(F.col(c)) > n for (t, c), n in MAX_LENGTH.items() if t == name]
    if not conds:
        return df.limit(0)
    bad = conds[0]
    for c in conds[1:]:
        bad = bad | c
    return df.filter(bad)


def _manifest(spark: SparkSession, root: str, version: int) -> dict[str, list[str]]:
    text = spark.read.text(f"{root}/versions/{version}.json", wholetext=True).first()[0]
    return json.loads(text)["tables"]


def _commit(spark: SparkSession, root: str, version: int, tables: dict[str, list[str]]) -> None:
    """Creates the manifest: written aside, then renamed, which fails if the version exists."""
    jvm = spark._jvm
    fs, aside = _hadoop(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(json.dumps({"version": version, "tables": tables}, indent=1).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{root}/versions/{version}.json"), no_options)


def _subfolders(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()] if fs.exists(p) else []


def _write(df: DataFrame, name: str, root: str, orders: DataFrame, years: list[int] | None) -> list[str]:
    """Writes a table, or some years of it, as a new batch; returns its folders."""
    batch = f"batch={uuid.uuid4().hex}"
    df = df.select(*[F.col(f.name).cast(f.dataType) for f in STORED[name].fields])
    if name in BY_DATE:
        df = df.withColumn(YEAR, F.year(BY_DATE[name]))
    elif name in BY_ORDER:
        dated = orders.select(F.col("id").alias("ordine"), F.year("data").alias(YEAR))
        df = df.join(dated, "ordine", "left").select(*STORED[name].fieldNames(), YEAR)
    if years is not None:
        df = df.filter(F.col(YEAR).isin(years))
    keys = [*([YEAR] if is_yearly(name) else []), *SORTED_BY[name]]
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists")
    for c in (*SORTED_BY[name][:1], *LOOKED_UP.get(name, ())):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if is_yearly(name):
        writer = writer.partitionBy(YEAR)
    folder = f"{root}/data/{name}/{batch}"
    writer.parquet(folder)
    return [f"{batch}/{sub}" for sub in _subfolders(df.sparkSession, folder)] if is_yearly(name) else [batch]


def _year_of(path: str) -> int | None:
    value = path.rpartition(f"{YEAR}=")[2]
    return int(value) if value.isdigit() else None


def write_snapshot(tables: Mapping[str, DataFrame], root: str, version: int,
                   years: Mapping[str, DataFrame] | None = None) -> str:
    """Commits ``version``: the given tables written, the others those of the latest version before it.

    ``years`` names, for tables kept by year, the years that differ from that
    version (a column ``anno``, a row for each year or more; the calendar bounds
    what comes to the driver).  Without it all years of a given table are written."""
    root, spark = root.rstrip("/"), next(iter(tables.values())).sparkSession
    done = [v for v in versions(spark, root) if v < version]
    before = _manifest(spark, root, done[-1]) if done else {}
    if version in versions(spark, root):
        raise FileExistsError(f"version {version} of {root} exists")
    if missing := [t for t in TABLES if t not in tables and t not in before]:
        raise ValueError(f"no rows given for {', '.join(missing)}, and no earlier version has them")
    orders = tables["orders"] if "orders" in tables else StoredTables(spark, root, before)["orders"]
    now = dict(before)
    for name in STORED:
        if name not in tables or (isinstance(tables, StoredTables) and tables.manifest.get(name) == before.get(name)):
            continue
        changed = None
        if years and name in years and name in before:
            changed = [r[0] for r in years[name].select(YEAR).distinct().filter(F.col(YEAR).isNotNull()).collect()]
            if not changed:
                continue
        kept = [] if changed is None else [p for p in before[name] if _year_of(p) not in changed]
        now[name] = kept + _write(tables[name], name, root, orders, changed)
    _commit(spark, root, version, now)
    return f"{root}/versions/{version}.json"


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> StoredTables:
    """The tables of one version (default: the latest one), with explicit schemas."""
    root = root.rstrip("/")
    if version is None:
        done = versions(spark, root)
        if not done:
            raise FileNotFoundError(f"no version under {root}")
        version = done[-1]
    return StoredTables(spark, root, _manifest(spark, root, version))
