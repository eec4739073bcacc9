"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.session import written


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """((id, component) for the ids of ``edges`` (a, b), component = smallest id; rounds taken).

    In turn every id is linked to the smallest id among its neighbours and itself
    (large star: its greater neighbours; small star: its smaller ones), until
    every link leads to the smallest id.  The distance to it about halves each
    round, so a chain of n links takes O(log n) rounds.  Minima are combined before
    the shuffle and joined back, so an id with very many links is split."""
    def up_down(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct()

    links, state, rounds = written(up_down(edges)), None, 0
    while True:
        rounds += 1
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
        links = written(up_down(small.unionAll(least.select("hi", "m"))))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    found = links.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return found.unionAll(found.select("component", "component").distinct()), rounds
