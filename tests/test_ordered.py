"""Ordered-scan helpers against plain windows, with one key holding most rows."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from hortus.functions.ordered import neighbour, rank_in_key
from hortus.functions.sequence import number_in_order


def _skewed(spark, n=5000):
    rows = [(0 if i % 10 < 7 else i % 37, dt.datetime(2020, 1, 1) + dt.timedelta(seconds=i // 3), i, i * 7 % 101)
            for i in range(n)]
    return spark.createDataFrame(rows, "k int, ts timestamp_ntz, seq long, v int")


def test_neighbours_match_window_on_a_hot_key(spark):
    df = _skewed(spark).withColumn("b", F.date_trunc("hour", "ts")).withColumn("v", F.when(F.col("v") % 7 != 0, F.col("v")))
    w = Window.partitionBy("k").orderBy("ts", "seq")
    want = {r["seq"]: (r["p"], r["n"]) for r in
            df.select("seq", F.lag("v").over(w).alias("p"), F.lead("ts").over(w).alias("n")).collect()}
    prev = neighbour(df, "k", "b", ["ts", "seq"], ["v"], "previous")
    nxt = neighbour(df, "k", "b", ["ts", "seq"], ["ts"], "next")
    got_p = {r["seq"]: r["prev_v"] for r in prev.collect()}
    got_n = {r["seq"]: r["next_ts"] for r in nxt.collect()}
    assert {s: (got_p[s], got_n[s]) for s in want} == want


def test_rank_in_key_counts_along_a_hot_key(spark):
    df = _skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    want = {r["seq"]: r["n"] for r in df.select("seq", F.row_number().over(w).alias("n")).collect()}
    assert {r["seq"]: r["n"] for r in rank_in_key(df, "k", ["ts", "seq"], "n").collect()} == want


def test_hot_key_spans_several_partitions(spark):
    from hortus.functions.ordered import tag_ranges
    parts = tag_ranges(_skewed(spark), ["k"], ["ts", "seq"]).filter("k = 0").select("_part").distinct().count()
    assert parts > 1


def test_number_in_order_is_dense_and_ordered(spark):
    df = _skewed(spark, 3000)
    got = number_in_order(df, ["ts", "seq"], 100, "id").orderBy("ts", "seq").select("id").collect()
    assert [r["id"] for r in got] == list(range(101, 3101))
