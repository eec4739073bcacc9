"""Ordered scans over (key, time) that do not pin a hot key to one task.

``neighbour`` is ``lag``/``lead`` over ``partition by key order by time``, dealt
by (key, period) with the edges of the periods stitched from an aggregate.
``rank_in_key`` counts rows along time within a key over range partitions.

``fold_by_key`` is the sequential fold for rules that are inherently ordered
(a stock ledger): rows of a key are streamed in time order through one
function call, batch by batch, never collected as a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hortus.session import written


def tag_ranges(df: DataFrame, key: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """Range partitioned on (key, order), each row tagged with its partition ``_part``,
    written.

    After this, the global (key, order) order is (``_part``, key, order): a key
    with a third of the rows spans several consecutive ``_part`` values.  The
    written table fixes the tags (they never change on recomputation) and cuts
    the lineage.  The range partitioner samples its input in a pass of its own, so
    ``df`` should be cheap to read twice.
    """
    cols = [F.col(c) for c in [*key, *order]]
    # The count is given, as AQE would merge the ranges of a small table and a hot key with them.
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *cols).withColumn("_part", F.spark_partition_id()))


def neighbour(df: DataFrame, key: str, bucket: str, order: Sequence[str], values: Sequence[str],
              direction: str = "previous", prefix: str | None = None) -> DataFrame:
    """Adds ``{prefix}{v}`` for each value column: its value on the previous (or next)
    row of the same ``key`` in ``order``; NULL at the edge of the key.

    ``bucket`` is any cut of the order (a period of time, say) that every key is
    dealt by: the window runs over (key, bucket), so a key with a third of the
    rows spans as many tasks as it has buckets.  The first (last) row of a bucket
    takes its neighbour from the nearest bucket of the key before (after) it, out of
    an aggregate with a row for each bucket.  No sampling, no counting, one path for all keys.
    """
    if direction not in ("previous", "next"):
        raise ValueError("direction is 'previous' or 'next'")
    back = direction == "previous"
    prefix = prefix or ("prev_" if back else "next_")
    step, pick = (F.lag, F.max_by) if back else (F.lead, F.min_by)
    place = F.struct(*[F.col(c) for c in order])
    edges = df.groupBy(key, bucket).agg(pick(F.struct(*[F.col(v).alias(v) for v in values]), place).alias("_edge"))
    edges = edges.select(key, bucket, step("_edge").over(Window.partitionBy(key).orderBy(bucket)).alias("_in"))
    w = Window.partitionBy(key, bucket).orderBy(*order)
    # A row of its own bucket comes first; a struct, as a neighbour's value may be NULL.
    inside = df.withColumn("_at", step(F.struct(*[F.col(v).alias(v) for v in values])).over(w))
    near = F.coalesce(F.col("_at"), F.col("_in"))
    return (inside.join(edges, [key, bucket], "left")
            .select(*df.columns, *[near[v].alias(prefix + v) for v in values]))


def rank_in_key(df: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """Adds ``out``: 1, 2, 3 ... along ``order`` within each key.

    Rows are counted inside range partitions; what a key has in the partitions
    before comes from a summary with a row for each partition and key."""
    tagged = tag_ranges(df, [key], order)
    local = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_part", key).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (tagged.withColumn(out, local).join(offsets, ["_part", key])
            .withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_part", "_before"))


def cluster_by_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Hash partition by key.  Joins on the key placed after this keep every key
    inside one partition (a broadcast join keeps this side's partitioning, a
    sort-merge join needs it), so they add no second shuffle of ``df``."""
    # No explicit count: AQE may merge small hash partitions (whole buckets, so a
    # key never splits), which keeps tiny batches from starting hundreds of tasks.
    return df.repartition(*[F.col(c) for c in key])


def column_values(s: pd.Series) -> list:
    """A column as Python values with None for missing ones, converted once per
    batch (not per value).  Float columns here are integer columns that carried
    nulls through pandas, so they go back to int."""
    mask = s.isna().to_numpy()
    if s.dtype.kind == "f":
        vals = s.to_numpy()
        return [None if m else int(v) for v, m in zip(vals.tolist(), mask.tolist())]
    vals = s.tolist()
    if mask.any():
        return [None if m else v for v, m in zip(vals, mask.tolist())]
    return vals


def fold_by_key(df: DataFrame, key: Sequence[str], order: Sequence[str],
                fold: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                schema: T.StructType | str, clustered: bool = False) -> DataFrame:
    """Streams each key's rows in ``order`` through ``fold`` (state carried by the fold).

    Rows are hash partitioned by key (unless ``clustered``: already done by
    ``cluster_by_key`` upstream) and sorted by (key, order) inside the
    partition, so every key is one contiguous, ordered run.  The fold sees
    Arrow batches of bounded size and keeps only the state of the key it is on.
    """
    cols = [F.col(c) for c in [*key, *order]]
    s = df if clustered else cluster_by_key(df, key)
    return s.sortWithinPartitions(*cols).mapInPandas(fold, schema)
