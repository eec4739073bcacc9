"""R4b's as-of price on histories with gaps, overlaps and hot species."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hortus.functions.asof import as_of, quarter, quarterly
from hortus.operators import orders as RO
from hortus.plans.inspect import final_plan
from tests.test_edge_cases import build, sp


def day(n):
    return dt.datetime(2018, 1, 1) + dt.timedelta(days=n)


def dated_orders(days):
    return [(i, "A", day(d), 1, "addr", "A@x") for i, d in enumerate(days)]


def lines(res):
    return sorted((r["ordine"], r["unit_price"], r["quantita"]) for r in res.collect())


def test_gap_and_two_open_prices_give_one_row(spark):
    """Before the first price: no row.  In a gap between two periods: the last price before it.
    With two prices open at once, or an open one that was never closed: the latest that has started."""
    prices = [(1, day(10), Decimal("1.00"), day(20)), (1, day(400), Decimal("2.00"), day(420)),
              (2, day(10), Decimal("3.00"), None), (2, day(30), Decimal("4.00"), None),
              (3, day(10), Decimal("5.00"), None), (3, day(500), Decimal("6.00"), day(510))]
    days = [5, 10, 25, 300, 399, 400, 401, 900]
    t = build(spark, species=[sp(k, 0) for k in (1, 2, 3, 4)], prices=prices, orders=dated_orders(days),
              order_lines=[(i, k, 1 + k) for i in range(len(days)) for k in (1, 2, 3, 4)])
    want = []
    for i, d in enumerate(days):
        for k in (1, 2, 3):
            started = [p for p in prices if p[0] == k and p[1] <= day(d)]
            if started:
                want.append((i, max(started, key=lambda p: p[1])[2], 1 + k))
    assert lines(RO.order_report_lines(t)) == sorted(want)
    totals = {r["ordine"]: (r["number_of_plants"], r["total_spending"]) for r in RO.order_report_totals(t).collect()}
    assert totals[2] == (2 + 3 + 4, 2 * Decimal("1.00") + 3 * Decimal("3.00") + 4 * Decimal("5.00"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_histories(spark, seed):
    rnd = random.Random(seed)
    starts = {(rnd.randint(1, 4), rnd.randint(0, 1500) * 24 + rnd.randint(0, 23)) for _ in range(120)}
    values = [(k, day(0) + dt.timedelta(hours=h), Decimal(i), None) for i, (k, h) in enumerate(sorted(starts))]
    rows = [(i, rnd.choice([1, 1, 1, 2, 3, 4, 5, None]), rnd.choice([None, *[day(0) + dt.timedelta(hours=rnd.randint(0, 40000))] * 9]))
            for i in range(400)] + [(1000 + i, v[0], v[1]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, k int, at timestamp_ntz")
    v = spark.createDataFrame(values + [(1, None, Decimal(1), None)], "k int, since timestamp_ntz, price decimal(7,2), until timestamp_ntz")
    got = {r["id"]: r["price"] for r in as_of(df, "at", quarterly(v, "k", "since", "price", quarter(df.agg(F.max("at")).scalar())), "k").collect()}
    want = {}
    for i, k, at in rows:
        started = [x for x in values if x[0] == k and at is not None and x[1] <= at]
        if started:
            want[i] = max(started, key=lambda x: x[1])[2]
    assert got == want


def test_equal_starts_give_one_row(spark):
    v = spark.createDataFrame([(1, day(1), Decimal(2)), (1, day(1), Decimal(3)), (1, day(1), Decimal(3))],
                              "k int, since timestamp_ntz, price decimal(7,2)")
    df = spark.createDataFrame([(7, 1, day(1)), (8, 1, day(900))], "id int, k int, at timestamp_ntz")
    got = as_of(df, "at", quarterly(v, "k", "since", "price", quarter(F.lit(day(900)))), "k").collect()
    assert sorted((r["id"], r["price"]) for r in got) == [(7, Decimal(3)), (8, Decimal(3))]


def test_empty_tables(spark):
    t = build(spark, species=[sp(1, 0)])
    assert RO.order_report_lines(t).count() == 0
    assert RO.order_report_lines(build(spark, species=[sp(1, 0)], orders=dated_orders([1]), order_lines=[(0, 1, 2)])).count() == 0


def test_hot_species_is_split_in_the_final_plan(spark):
    """Three quarters of the lines ask for one species in one month: with broadcasts off, AQE's
    final plan splits that species' side of the join, and every line has its one price."""
    n = 60000
    t = build(spark, species=[sp(k, 0) for k in range(40)], prices=[(k, day(0), Decimal(k + 1), None) for k in range(40)])
    t["orders"] = spark.range(n).select(F.col("id").cast("int"), F.lit("A").alias("cliente"), F.expr("timestamp_ntz'2018-02-10 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id % 400000)").alias("data"),
                                        F.lit(1).alias("aperto_or_finalizzato"), F.lit("x").alias("indirizzo_spedizione"), F.lit("y").alias("contatto"))
    t["order_lines"] = spark.range(n).select(F.col("id").cast("int").alias("ordine"), F.when(F.col("id") % 4 > 0, 0).otherwise(F.col("id") % 40)
                                             .cast("int").alias("specie_di_pianta"), (F.col("id") % 9 + 1).cast("int").alias("quantita"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = RO.order_report_lines(t)
        plan = final_plan(df)
        assert df.count() == n
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "isFinalPlan=true" in plan and "SortMergeJoin(skew=true)" in plan
