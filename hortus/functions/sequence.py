"""New surrogate keys: ``max(existing) + position`` of accepted requests, in request order.

A window with no partition would run in one task.  Instead the rows are range
partitioned by the request order; each partition numbers its rows locally
(``monotonically_increasing_id`` minus the partition base), the per-partition
counts (one row per partition, a proven small size) give the offsets, and a
broadcast join adds them.  The sorted rows are written first, so the
numbering is computed once and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hortus.session import written


def number_in_order(df: DataFrame, order_cols: Sequence[str], base: Column | int, out: str) -> DataFrame:
    """Adds ``out`` = ``base`` + 1, 2, 3 ... following ``order_cols``."""
    local = (df.orderBy(*order_cols)
               .withColumn("_part", F.spark_partition_id())
               .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    local = written(local)
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_offset", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = offsets.select("_part", F.coalesce(F.col("_offset"), F.lit(0)).alias("_offset"))
    base_col = base if isinstance(base, Column) else F.lit(base)
    return (local.join(F.broadcast(offsets), "_part")  # one row per partition
                 .withColumn(out, (base_col + F.col("_offset") + F.col("_local") + 1).cast("int"))
                 .drop("_part", "_local", "_offset"))


def max_key(table: DataFrame, col: str) -> int:
    """Largest existing key (0 for an empty table): one aggregate row to the driver."""
    row = table.agg(F.max(col).alias("m")).first()
    return int(row["m"] or 0)
