"""A day of work over snapshots: read the latest version, run jobs, write the next
version, report from it (the engine as it would run on a cluster)."""

import datetime as dt

from hortus.operators import orders as RO
from hortus.operators.jobs import maintenance as M
from hortus.operators.jobs import orders as OR
from hortus.plans import requests as RQ
from hortus.sources.snapshots import read_snapshot, versions, write_snapshot


def test_jobs_chain_over_snapshots(spark, src, tables, tmp_path):
    root = str(tmp_path / "store")
    write_snapshot(tables, root, 1)
    t1 = read_snapshot(spark, root)
    lines = OR.apply_order_line_changes(t1, RQ.order_line_changes(src), RQ.finalizations(src))
    t2 = lines.merged(t1)
    restock = M.apply_restock(t2, dt.datetime(2002, 1, 1))
    t3 = restock.merged(t2)
    write_snapshot(t3, root, 2)
    assert versions(spark, root) == [1, 2]
    t = read_snapshot(spark, root)
    # the new version holds the batch's effects
    assert t["order_lines"].count() == lines.tables["order_lines"].count()
    assert t["supply_requests"].filter("pendente_si_no = 1 and data <= timestamp'2002-01-01 00:00:00'").count() == 0
    # reports run on it; every line still has a price in force on its order date
    priced = RO.order_report_lines(t).count()
    assert priced == t["order_lines"].join(t["orders"].withColumnRenamed("id", "ordine"), "ordine").count()
    # version 1 is untouched
    assert read_snapshot(spark, root, 1)["order_lines"].count() == tables["order_lines"].count()


def test_runner_applies_a_request_file(spark, src, tables, tmp_path):
    from hortus.run import run_job
    from hortus.sources.requests import write_requests

    root = str(tmp_path / "store")
    write_snapshot(tables, root, 1)
    write_requests(RQ.order_line_changes(src), str(tmp_path / "req"), "line_changes")
    v = run_job(spark, "line_changes", root, str(tmp_path / "outcomes"), requests=str(tmp_path / "req"), range_rows=300)
    assert v == 2
    out = spark.read.parquet(str(tmp_path / "outcomes"))
    assert out.count() == RQ.order_line_changes(src).count()
    want = OR.apply_order_line_changes(tables, RQ.order_line_changes(src)).tables["species"]
    got = read_snapshot(spark, root)["species"]
    assert {r["codice"]: r["giacenza"] for r in got.collect()} == {r["codice"]: r["giacenza"] for r in want.collect()}


def test_runner_report(spark, tables, tmp_path):
    from hortus.run import main
    root = str(tmp_path / "store")
    write_snapshot(tables, root, 1)
    main(["report", "order_status", "--store", root, "--out", str(tmp_path / "status")])
    assert spark.read.parquet(str(tmp_path / "status")).count() == tables["orders"].count()
    main(["report", "species_monthly_sales", "--store", root, "--year", "2000", "--out", str(tmp_path / "sales")])
    assert spark.read.parquet(str(tmp_path / "sales")).count() == 12 * tables["species"].count()
