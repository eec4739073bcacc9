"""Exact duplicates, with the heavy digests split off before the shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.llm.common import materialise

#: Characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _cut(counts: dict[str, int], k: int) -> dict[str, int]:
    """One Misra-Gries reduction: at most ``k`` counters stay."""
    if len(counts) <= k:
        return counts
    floor = sorted(counts.values(), reverse=True)[k]
    return {d: c - floor for d, c in counts.items() if c > floor}


def heavy_digests(digests: DataFrame, column: str, k: int) -> DataFrame:
    """At most ``k`` digests, among them every one with more than 1/(k+1) of the rows.

    A Misra-Gries summary per partition, merged by adding counters and taking
    off the (k+1)-th largest sum.  Only counters are shuffled."""
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for batch in batches:
            for d, c in batch[column].value_counts().items():
                counts[d] = counts.get(d, 0) + int(c)
            counts = _cut(counts, k)
        if counts:
            yield pd.DataFrame({column: list(counts), "c": list(counts.values())})

    merged = digests.select(column).mapInPandas(summarise, f"{column} string, c long").groupBy(column).agg(F.sum("c").alias("c"))
    top = merged.orderBy(F.desc("c")).limit(k + 1).collect()  # k + 1 rows at most
    floor = top[k]["c"] if len(top) > k else 0
    return digests.sparkSession.createDataFrame([(r[column],) for r in top if r["c"] > floor], f"{column} string")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when they agree without white space (a null text counts as
    empty).  The longest original (code points) stays, then the smallest id; a
    null id comes last.  ``id_col`` is the key: repeated rows of one id each
    count in group_size and share one decision.  An empty table gives no rows;
    other columns are not looked at.

    Heavy digests (Misra-Gries, ``k`` counters) are counted exactly, and their
    winners, at most ``k`` rows, are broadcast, so their rows are decided on
    the map side; the remaining digests are aggregated and joined by shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).alias("len"),
        F.sha2(F.translate(text, BLANKS, "").cast("binary"), 256).alias("text_sha256")), "digests")
    best = F.max_by("doc_id", F.struct("len", F.col("doc_id").isNotNull(), -F.col("doc_id"))).alias("keep_id")
    found = heavy_digests(rows, "text_sha256", k)

    def winners(part: DataFrame) -> DataFrame:
        return part.groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))

    heavy = materialise(winners(rows.join(F.broadcast(found), "text_sha256", "left_semi")), "heavy")
    light = rows.join(F.broadcast(found), "text_sha256", "left_anti")
    light_winners = materialise(winners(light), "winners")
    decided = rows.join(F.broadcast(heavy), "text_sha256").unionByName(light.join(light_winners, "text_sha256"))
    return decided.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                          "text_sha256")
