"""The store: versions by manifest, yearly folders, only changed tables and years written, look-ups by key."""

import datetime as dt
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hortus.operators import orders as RO
from hortus.operators import packing as RP
from hortus.operators import sales as RS
from hortus.operators import supply as RU
from hortus.operators.jobs import maintenance as M
from hortus.operators.jobs import orders as OR
from hortus.operators.totals import recount
from hortus.plans import requests as RQ
from hortus.plans.inspect import physical_plan
from hortus.run import create_store, main, run_job
from hortus.sources.requests import write_requests
from hortus.sources.schemas import TABLES
from hortus.sources.snapshots import BY_ORDER, read_snapshot, versions, write_snapshot
from tests.test_edge_cases import LINE_SCHEMA, req, ts


@pytest.fixture(scope="module")
def first_version(tables, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("first") / "store")
    create_store(tables, root)
    return root


@pytest.fixture
def store(first_version, tmp_path):
    root = str(tmp_path / "store")
    shutil.copytree(first_version, root)
    return root


def folders(root):
    """Every folder with data files, by table."""
    out = {}
    for at, _, files in os.walk(f"{root}/data"):
        if any(f.endswith(".parquet") for f in files):
            out.setdefault(os.path.relpath(at, f"{root}/data").split("/")[0], set()).add(at)
    return out


def rows(df):
    return sorted(map(repr, df.collect()))


def test_round_trip_and_pushdown(spark, tables, store):
    t1 = read_snapshot(spark, store)
    assert versions(spark, store) == [1]
    for name in TABLES:
        assert t1[name].count() == tables[name].count() and t1[name].columns == TABLES[name].fieldNames()
    code = tables["orders"].first()["cliente"]
    assert f"EqualTo(cliente,{code})" in physical_plan(RO.customer_orders(t1, customers=code))
    # a job writes the next version; the one being read stays untouched
    before = rows(t1["supply_requests"])
    res = M.apply_restock(t1, dt.datetime(1998, 1, 1))
    write_snapshot(res.tables, store, 2, res.years)
    assert versions(spark, store) == [1, 2]
    assert rows(read_snapshot(spark, store, 1)["supply_requests"]) == before
    t2 = read_snapshot(spark, store)
    want = M.apply_restock(tables, dt.datetime(1998, 1, 1)).merged(tables)
    for name in TABLES:
        assert rows(t2[name]) == rows(want[name].select(*TABLES[name].fieldNames())), name


def test_one_added_colour_writes_one_table(spark, store, tmp_path):
    flowering = read_snapshot(spark, store)["species"].filter("verde_or_fiorita = 0").first()["codice"]
    write_requests(req(spark, [(ts(1), 1, flowering, "ultramarine")], "ts timestamp_ntz, seq long, specie_fiorita int, colore string"),
                   str(tmp_path / "req"), "colours")
    before = folders(store)
    assert run_job(spark, "add_colours", store, str(tmp_path / "out"), str(tmp_path / "req")) == 2
    after = folders(store)
    assert {t for t in after if after[t] != before[t]} == {"colourings"}
    assert read_snapshot(spark, store)["colourings"].filter("colore = 'ultramarine'").count() == 1


def test_year_filter_prunes_folders(spark, tables, store):
    t = read_snapshot(spark, store)
    plan = physical_plan(RS.species_monthly_sales(t, 2000))
    assert plan.count("PartitionFilters: [isnotnull(anno") == 2, plan  # orders and lines
    assert rows(RS.species_monthly_sales(t, 2000)) == rows(RS.species_monthly_sales(tables, 2000))
    # the lines lie in the year of their order
    years = {p.split("anno=")[1]: p for p in folders(store)["order_lines"]}
    assert len(years) > 3
    of = {r["id"]: str(r["data"].year) for r in tables["orders"].collect()}
    for year, path in years.items():
        assert {of[r["ordine"]] for r in spark.read.parquet(path).collect()} == {year}


def test_retention_leaves_later_years_alone(spark, tables, store, tmp_path):
    now = dt.datetime(2000, 6, 1)
    before = read_snapshot(spark, store).manifest
    run_job(spark, "retention", store, str(tmp_path / "out"), now=now)
    t = read_snapshot(spark, store)
    for name in ("orders", "supply_requests", *BY_ORDER):
        later = {p for p in before[name] if int(p.split("anno=")[1]) > 1998}
        assert later and later <= set(t.manifest[name]), name
        assert not any(int(p.split("anno=")[1]) < 1998 for p in t.manifest[name]), name
    want = M.apply_retention(tables, now).merged(tables)
    for name in TABLES:
        assert rows(t[name]) == rows(want[name].select(*TABLES[name].fieldNames())), name


def test_line_changes_write_the_years_they_touch(spark, store, tmp_path):
    t = read_snapshot(spark, store)
    o = t["orders"].filter("aperto_or_finalizzato = 1").orderBy("id").first()
    line = t["order_lines"].filter(f"ordine = {o['id']}").first()
    write_requests(req(spark, [(ts(10**5), 1, "CHANGE", o["cliente"], o["id"], line["specie_di_pianta"], 1)], LINE_SCHEMA),
                   str(tmp_path / "req"), "line_changes")
    run_job(spark, "line_changes", store, str(tmp_path / "out"), str(tmp_path / "req"))
    now = read_snapshot(spark, store)
    new = {name: set(now.manifest[name]) - set(t.manifest[name]) for name in TABLES}
    assert {n for n, p in new.items() if p} == {"species", "order_lines"}
    assert len(set(now.manifest["ordered_totals"]) - set(t.manifest["ordered_totals"])) == 1
    assert [p.split("anno=")[1] for p in new["order_lines"]] == [str(o["data"].year)]
    assert now["order_lines"].count() == t["order_lines"].count()
    assert now["order_lines"].filter(f"ordine = {o['id']} and specie_di_pianta = {line['specie_di_pianta']}").first()["quantita"] == 1


def test_jobs_in_a_row_equal_jobs_on_the_tables(spark, src, tables, store, tmp_path):
    write_requests(RQ.order_line_changes(src), str(tmp_path / "lines"), "line_changes")
    write_requests(RQ.finalizations(src), str(tmp_path / "fin"), "finalizations")
    write_requests(RQ.pack_requests(src), str(tmp_path / "packs"), "packing")
    write_requests(RQ.new_orders(src), str(tmp_path / "new"), "new_orders")
    run_job(spark, "line_changes", store, str(tmp_path / "o1"), str(tmp_path / "lines"), finalizations=str(tmp_path / "fin"))
    run_job(spark, "packing", store, str(tmp_path / "o2"), str(tmp_path / "packs"))
    run_job(spark, "new_orders", store, str(tmp_path / "o3"), str(tmp_path / "new"))
    run_job(spark, "restock", store, str(tmp_path / "o4"), now=dt.datetime(2002, 1, 1))
    from hortus.operators.jobs import packs as PK
    t = OR.apply_order_line_changes(tables, RQ.order_line_changes(src), RQ.finalizations(src)).merged(tables)
    t = PK.allocate_packs(t, RQ.pack_requests(src)).merged(t)
    t = OR.open_orders(t, RQ.new_orders(src)).merged(t)
    t = M.apply_restock(t, dt.datetime(2002, 1, 1)).merged(t)
    got = read_snapshot(spark, store)
    assert versions(spark, store) == [1, 2, 3, 4, 5]
    for name in TABLES:
        assert rows(got[name]) == rows(t[name].select(*TABLES[name].fieldNames())), name
    counted_totals(got)


def counted_totals(t):
    """The kept totals are those of a recount, and the reports are the same with and without them."""
    for name, df in recount(t).items():
        assert rows(t[name].select(*sorted(t[name].columns))) == rows(df.select(*sorted(df.columns))), name
    plain = {name: t[name] for name in TABLES}
    assert rows(RO.order_status(t)) == rows(RO.order_status(plain))
    for semantics in ("intended", "reference"):
        assert rows(RP.packing_remaining(t, semantics=semantics)) == rows(RP.packing_remaining(plain, semantics=semantics))
        assert rows(RU.low_stock_top_suppliers(t, semantics=semantics)) == rows(RU.low_stock_top_suppliers(plain, semantics=semantics))
    assert rows(RU.low_stock_top_suppliers(t, n=4)) == rows(RU.low_stock_top_suppliers(plain, n=4))


def test_totals_follow_every_job(spark, src, store, tmp_path):
    """Requests made, packs filled, orders retired: after each job the kept totals equal a recount."""
    write_requests(RQ.pack_requests(src), str(tmp_path / "packs"), "packing")
    offers = read_snapshot(spark, store)["availability"].select(
        F.lit(dt.datetime(2003, 1, 1)).cast("timestamp_ntz").alias("ts"),
        (F.col("specie_di_pianta").cast("long") * 10**6 + F.col("fornitore")).alias("seq"), "fornitore", "specie_di_pianta", F.lit(3).alias("quantita"))
    write_requests(offers, str(tmp_path / "asked"), "supply_requests")
    run_job(spark, "packing", store, str(tmp_path / "o1"), str(tmp_path / "packs"))
    run_job(spark, "supply_requests", store, str(tmp_path / "o2"), str(tmp_path / "asked"))
    counted_totals(read_snapshot(spark, store))
    run_job(spark, "retention", store, str(tmp_path / "o3"), now=dt.datetime(2000, 1, 1))
    t = read_snapshot(spark, store)
    counted_totals(t)
    # The reports read the totals, not the facts.
    read = {f.split("/data/")[1].split("/")[0] for f in RO.order_status(t).inputFiles()}
    assert {"packed_totals", "ordered_totals"} <= read and not read & {"pack_contents", "order_lines"}


def test_a_store_without_totals(spark, tables, tmp_path):
    root = str(tmp_path / "bare")
    write_snapshot(tables, root, 1)
    t = read_snapshot(spark, root)
    assert set(t) == set(TABLES)
    assert rows(RO.order_status(t)) == rows(RO.order_status(tables))


def test_a_failed_job_blocks_nothing(spark, store, tmp_path):
    """Folders of a job that died before its commit are in no version, and the job runs again."""
    t = read_snapshot(spark, store)
    os.makedirs(f"{store}/data/species/batch=dead")
    with open(f"{store}/data/species/batch=dead/part-0.parquet", "w") as f:
        f.write("half a file")
    assert versions(spark, store) == [1]
    res = M.apply_restock(t, dt.datetime(1998, 1, 1))
    write_snapshot(res.tables, store, 2, res.years)
    assert read_snapshot(spark, store)["species"].count() == t["species"].count()
    with pytest.raises(FileExistsError):
        write_snapshot(res.tables, store, 2, res.years)


def test_two_writers_of_one_version(spark, store, monkeypatch):
    """The second commit of a version fails, whatever it saw before."""
    from py4j.protocol import Py4JJavaError

    from hortus.sources import snapshots
    t = read_snapshot(spark, store)
    write_snapshot({"colourings": t["colourings"].limit(1)}, store, 2)
    with pytest.raises(Py4JJavaError, match="FileAlreadyExists"):
        snapshots._commit(spark, store, 2, t.manifest)
    assert read_snapshot(spark, store)["colourings"].count() == 1


def test_a_lookup_by_key_meets_few_row_groups(spark, tmp_path):
    """Files hold ranges of the key, so the statistics of all but a file or two exclude a key;
    for a column that every file spans, the Bloom filters say so."""
    n = 40000
    base = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    base["orders"] = spark.range(n).selectExpr(
        "cast(id as int) id", "lpad(cast(id * 7919 % 40000 as string), 11, '0') cliente", "timestamp_ntz'2000-03-01 00:00:00' data",
        "1 aperto_or_finalizzato", "'x' indirizzo_spedizione", "'c' contatto")
    root, old = str(tmp_path / "store"), spark.conf.get("spark.sql.adaptive.enabled")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # 8 files, not one
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        write_snapshot(base, root, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    (folder,) = folders(root)["orders"]
    files = [f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")]
    assert len(files) >= 6
    held = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(0).statistics
            held += s.min <= 12345 <= s.max
    assert held == 1

    def scanned(df):
        """Rows that the scan handed on, after row groups were left out."""
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "AdaptiveSparkPlan" in plan.nodeName() else plan
        leaf = plan
        while leaf.children().nonEmpty():
            leaf = leaf.children().head()
        return leaf.metrics().apply("numOutputRows").value()

    orders = read_snapshot(spark, root)["orders"]
    assert scanned(orders.filter("id = 12345")) <= n / 4
    present = orders.filter("cliente = '00000012345'")
    assert present.count() == 1 and scanned(present) <= n / 2  # min and max of every file span it
    assert scanned(orders.filter("cliente = '00000012345x'")) == 0


def test_reports_asked_by_request_files(spark, tables, store, tmp_path):
    o = tables["orders"].orderBy("id").first()
    write_requests(req(spark, [(ts(1), 1, o["cliente"], o["id"]), (ts(2), 2, "nobody", o["id"]), (ts(3), 3, "nobody", -5)],
                       "ts timestamp_ntz, seq long, cliente string, ordine int"), str(tmp_path / "req"), "finalizations")
    main(["report", "order_report_requests", "--store", store, "--requests", str(tmp_path / "req"), "--out", str(tmp_path / "out")])
    got = {(r["cliente"], r["ordine"]): r["code"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(o["cliente"], o["id"]): None, ("nobody", o["id"]): "45005", ("nobody", -5): "45016"}
    write_requests(req(spark, [(ts(1), 1, -1)], "ts timestamp_ntz, seq long, codice int"), str(tmp_path / "req2"), "species_removals")
    main(["report", "species_report_requests", "--store", store, "--requests", str(tmp_path / "req2"), "--out", str(tmp_path / "out2")])
    assert [r["code"] for r in spark.read.parquet(str(tmp_path / "out2")).collect()] == ["45014"]
