"""Mixing sources to target weights: exact block quotas dealt over output shards."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hortus.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess reshared."""
    out, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / weight > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / weight
            break
        for i in full:
            out[i] = most * sizes[i]
        rest -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Block quotas per shard: each node of a binary tree splits its source quotas
    between its halves by one multivariate-hypergeometric draw."""
    rng = np.random.default_rng(seed)

    def node(q: np.ndarray, n: int) -> list[list[int]]:
        if n == 1:
            return [q.tolist()]
        left = n // 2
        took = np.zeros_like(q)
        need, rest = int(q.sum()) * left // n, int(q.sum())
        for i, c in enumerate(q.tolist()):  # the marginal draws, one source after another
            took[i] = rng.hypergeometric(c, rest - c, need) if need and c else 0
            need, rest = need - int(took[i]), rest - c
        return node(took, left) + node(q - took, n - left)

    return node(np.array(quotas, np.int64), shards)


def _inline(df: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """Driver rows (one per source) as a DataFrame, from a JSON literal."""
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _key():
    """Rows with the same key are interchangeable."""
    return F.xxhash64("doc_id", "source", "text", F.isnull("doc_id"), F.isnull("source"), F.isnull("text"))


def _words():
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), shards: int = 16, seed: int = 11) -> DataFrame:
    """The plan: doc_id, source, size, source_size, target, taken, shards, key, row for every row.

    ``row`` tells rows apart and ``key`` finds their text for ``shard_rows``.

    ``size``: words of the whole text (null: 0).  Sources in code point order,
    null last, take ``weights`` in turn; see ``targets``.  A source is taken
    whole as often as its target allows; the rest is a draw without
    replacement: rows fall into sqrt(rows) hash blocks per source, blocks are
    taken in permuted order until the rest is reached, and inside the one
    block where it ends, rows in permuted order up to the nearest row.
    ``shards`` lists the output shard of each copy: the source's blocks are
    dealt to shards by a multivariate-hypergeometric splitting tree.

    One row per source reaches the driver.  A hot source is split over its
    blocks.  Repeated rows are mixed one by one, null ids like others, an
    empty table gives no rows, a source of size 0 takes 0."""
    rows = materialise(docs.select("doc_id", "source", _words().alias("size"), F.xxhash64(F.lit(seed), "doc_id", "source").alias("h"),
                                   _key().alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))])
    plan = []
    for i, (r, t) in enumerate(zip(found, goal)):
        whole = int(t // r["size"]) if r["size"] else 0
        plan.append({"src": i, "name": r["source"], "source_size": r["size"], "target": t, "blocks": int(np.ceil(np.sqrt(r["n"]))),
                     "whole": whole, "rest": int(round(t)) - whole * r["size"] if r["size"] else 0})
    sources = _inline(docs, plan, "src int, name string, source_size bigint, target double, blocks bigint, whole int, rest bigint")
    placed = (rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")
              .withColumn("block", F.expr("pmod(h, blocks)")))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block"), "block")
    blocks = (placed.groupBy("src", "rest", "block").agg(F.sum("size").alias("block_size"))
              .withColumn("upto", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("before", F.col("upto") - F.col("block_size"))
              .withColumn("drawn", F.col("upto") <= F.col("rest"))
              .withColumn("ends", (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest")))
              .drop("rest"))
    blocks = materialise(blocks, "blocks")
    count = {r["src"]: (r["c"], r["d"]) for r in blocks.groupBy("src").agg(
        F.count("*").alias("c"), F.count_if(F.col("drawn") | F.col("ends")).alias("d")).collect()}
    filled = [count.get(p["src"], (0, 0)) for p in plan]
    dealt = split_quotas([p["whole"] * c + d for p, (c, d) in zip(plan, filled)], shards, seed)
    bounds = np.cumsum(np.array(dealt, np.int64).reshape(shards, len(plan)), axis=0).T.tolist()
    deal = _inline(docs, [{"src": p["src"], "filled": c, "bounds": b} for p, (c, _), b in zip(plan, filled, bounds)],
                   "src int, filled bigint, bounds array<bigint>")
    joined = placed.join(blocks, ["src", "block"])
    inside = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 2), "h"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    ending = (joined.where("ends").withColumn("run", F.sum("size").over(inside))
              .withColumn("extra", F.expr("before + run - size / 2 <= rest and size > 0")).drop("run"))
    other = joined.where("not ends").withColumn("extra", F.col("drawn"))
    out = other.unionByName(ending).join(F.broadcast(deal), "src").withColumn("copies", F.col("whole") + F.col("extra").cast("int"))
    place = F.expr("transform(if(copies > 0, sequence(0, copies - 1), array()), "
                   "c -> size(filter(bounds, b -> b <= c * filled + rank)))")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                      place.alias("shards"), "key", "row")


def shard_rows(docs: DataFrame, mixed: DataFrame, seed: int = 11) -> DataFrame:
    """The mixture itself: one row per copy, clustered by shard and shuffled inside it.

    Columns of ``docs``, ``row`` and the number ``copy`` within it, ``shard``.
    Texts of repeated rows are taken once and joined to each of their rows."""
    copies = mixed.select("key", "row", F.posexplode("shards").alias("copy", "shard"))
    keyed = docs.withColumn("key", _key())
    repeated = materialise(mixed.groupBy("key").count().where("count > 1").select("key"), "repeated")
    texts = keyed.join(repeated, "key", "left_anti").unionByName(keyed.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return (texts.join(copies, "key").drop("key").repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
            .sortWithinPartitions("shard", F.xxhash64(F.lit(seed), "doc_id", "shard")))


def draw(docs: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, shards for every row of ``docs``.

    The mixture is written to the shared folder shard by shard; ``taken`` (0
    without a copy) and ``shards`` are those of the copies read back.  With
    ``texts``, ``text`` is the text of the copies, null where none was taken."""
    mixed = materialise(mix(docs), "mixed")
    copies = materialise(shard_rows(docs, mixed), "mixture", "zstd")
    back = copies.groupBy("row").agg(F.sum(_words()).alias("taken"), F.array_sort(F.collect_list(F.struct("copy", "shard")))["shard"].alias("shards"))
    rows = (mixed.drop("taken", "shards").join(back, "row", "left")
            .select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
                    F.coalesce("shards", F.array().cast("array<int>")).alias("shards")))
    if not texts:
        return rows.drop("row")
    rows = materialise(rows, "rows")
    held = rows.join(copies.where("copy = 0").select("row", "text"), "row")
    return held.unionByName(rows.where("cardinality(shards) = 0").withColumn("text", F.lit(None).cast("string"))).drop("row")
