"""As-of lookup: the latest value of a key at or before a time, without perfect periods.

Nothing is assumed of the values but their start times: gaps, overlaps and two
values open at once all give the latest one that has started.  Time is cut
into quarters.  Inside a quarter a value holds until the next one of its key;
the last value of a quarter is carried into the quarters after it, up to
and into the next one with a value of its own.  So the lookup is an equi join on
(key, quarter) in which each row meets one quarter's values, not the key's
whole history, and exactly one of them holds.  There is no window over the
rows that look up: small values are broadcast, and otherwise AQE may split
a key that holds a third of the rows on its side of the join.  The windows run over
the values only: inside one (key, quarter), and over the quarters of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quarter(t: Column) -> Column:
    """The quarters since year 0, as a whole number."""
    return (F.year(t) * 4 + F.quarter(t)).cast("int")


def quarterly(values: DataFrame, key: str, start: str, take: str, until: Column) -> DataFrame:
    """(key, _quarter, _from, _to, take): the value in force in each part of each quarter.

    ``_from`` NULL means from the quarter's beginning, ``_to`` NULL to its end.  Of two
    values with one start the greater holds.  The last value of a key is carried
    up to the quarter ``until``.  A value without a start never holds."""
    v = values.select(F.col(key), F.col(start).alias("_from"), F.col(take)).filter(F.col("_from").isNotNull())
    v = v.withColumn("_quarter", quarter(F.col("_from")))
    # Of equal starts all but the last get an empty part.
    inside = v.withColumn("_to", F.lead("_from").over(Window.partitionBy(key, "_quarter").orderBy("_from", take)))
    ends = v.groupBy(key, "_quarter").agg(F.min("_from").alias("_first"), F.max(F.struct("_from", take)).alias("_last"))
    following = F.lead(F.struct(F.col("_quarter").alias("q"), F.col("_first").alias("t"))).over(
        Window.partitionBy(key).orderBy("_quarter"))
    ends = ends.withColumn("_next", following).withColumn("_stop", F.coalesce(F.col("_next.q"), until))
    carried = (ends.filter(F.col("_stop") > F.col("_quarter"))
               .withColumn("_into", F.explode(F.sequence(F.col("_quarter") + 1, F.col("_stop")))))
    carried = carried.select(
        key, F.col("_into").alias("_quarter"), F.lit(None).cast("timestamp_ntz").alias("_from"),
        F.when(F.col("_into") == F.col("_next.q"), F.col("_next.t")).alias("_to"), F.col(f"_last.{take}").alias(take))
    return inside.select(*carried.columns).unionByName(carried)


def as_of(rows: DataFrame, at: str, held: DataFrame, key: str) -> DataFrame:
    """``rows`` with the value of their ``key`` that is in force at ``at``, from ``quarterly``
    (to which columns of the key may have been joined).

    A row before the first value of its key, or without key or time, is left out
    (an inner join)."""
    held = held.withColumnRenamed(key, "_key")
    t = F.col(at)
    holds = ((F.col(key) == F.col("_key")) & (quarter(t) == F.col("_quarter"))
             & (F.col("_from").isNull() | (F.col("_from") <= t)) & (F.col("_to").isNull() | (t < F.col("_to"))))
    return rows.join(held, holds, "inner").drop("_key", "_quarter", "_from", "_to")
