"""Hard negatives from blocks along a Hilbert curve, read as their zone maps demand."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hortus.llm.common import materialise

#: Components are floor(FINE * x), held within +-LIMIT (less beyond 256 dimensions), so that a hundred times any score fits a long.
FINE, LIMIT = 256, 1 << 24
#: Rows of a block, blocks of a shelf, anchors of a group, anchors compared at once, bits that a component has on the curve.
ROWS, SHELF, GROUP, SLICE, DEPTH = 256, 256, 1 << 16, 32, 2
#: Positives and negatives wanted; a negative's score lies between LOW and HIGH per cent of its positive's.
WANTED, LOW, HIGH = 5, 80, 100
#: The floor of an anchor that has met too few rows of its label to know one.
NO_FLOOR = -(1 << 63)


def hilbert_keys(grid: np.ndarray, bits: int = DEPTH) -> list[bytes]:
    """The place of each row of ``grid`` (integers below 2 ** bits) on the Hilbert curve through its dimensions.

    Bits are set from the highest down: each level undoes the reflections and
    swaps that the levels above it made, then the bits are put in Gray order."""
    x = grid.T.astype(np.int64).copy()
    n = x.shape[0]
    if not n:
        return [b""] * grid.shape[0]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            turned = (x[i] >> level & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[n - 1] >> level & 1, flip ^ ((1 << level) - 1), flip)
    x ^= flip
    planes = np.stack([x[i] >> level & 1 for level in range(bits - 1, -1, -1) for i in range(n)], axis=1).astype(np.uint8)
    return [row.tobytes() for row in np.packbits(planes, axis=1)]


def _keyed(dims: int):
    """Integer components, filled up with zeros to ``dims``, and the place on the curve."""
    most = min(LIMIT, math.isqrt((1 << 56) // max(dims, 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.zeros((len(batch), dims), np.int32)
            for row, own in zip(v, batch["vec"], strict=True):
                row[:len(own)] = np.clip(np.floor(FINE * np.asarray(own, np.float64)), -most, most)
            # The grid's cells part the components of a unit vector of no direction near their quartiles.
            step = 0.6745 * FINE / max(dims, 1) ** 0.5
            grid = 2 * (v >= 0) + ((v >= step) | ((v < 0) & (v >= -step)))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "key": hilbert_keys(grid), "v": [x.tobytes() for x in v]})
    return run


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows: through doubles as long as their 53 bits hold every sum."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _matrix(cells, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.int32).reshape(-1, dims) if dims else np.zeros((len(cells), 0), np.int32)


def _blocks(dims: int, every: int):
    """A row for every ROWS rows in their order: the rows, their zone map, and the floors of the anchors among them.

    A floor is a score that the anchor's last positive reaches at least: that of
    the WANTED-th best row of its label in its own block."""
    def pack(part: pd.DataFrame, name: int) -> pd.DataFrame:
        v, ids, labels = _matrix(part["v"].tolist(), dims), part["vec_id"].to_numpy(np.int64), part["label"].to_numpy(np.int64)
        anchors, floors = np.flatnonzero(ids % every == 0), []
        for i, scores in zip(anchors, _product(v[anchors], v), strict=True):
            same = labels == labels[i]
            same[i] = False
            best = np.sort(scores[same])[::-1]
            floors.append(int(best[WANTED - 1]) if best.size >= WANTED else NO_FLOOR)
        return pd.DataFrame({"part": [name >> 32], "shelf": [name // SHELF], "block": [name], "ids": [ids], "labels": [labels], "v": [v.tobytes()],
                             "lo": [v.min(axis=0).astype(np.int64)], "hi": [v.max(axis=0).astype(np.int64)],
                             "held": [np.unique(labels)], "anchors": [anchors], "floors": [np.array(floors, np.int64)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = len(held) // ROWS * ROWS
            for i in range(0, whole, ROWS):
                yield pack(held.iloc[i:i + ROWS], name)
                name += 1
            held = held.iloc[whole:]
        if held is not None and len(held):
            yield pack(held, name)
    return run


BLOCK = ("part long, shelf long, block long, ids array<long>, labels array<long>, v binary, lo array<long>, hi array<long>, "
         "held array<long>, anchors array<long>, floors array<long>")
FOUND = "anchor_id long, k int, found_id long, score long"


def blocks(rows: DataFrame, dims: int, every: int) -> DataFrame:
    """The Parquet blocks: rows along the curve, ROWS to a block, up to SHELF blocks to a shelf.

    Equal places are told apart by vec_id, so a very common vector spans blocks and tasks."""
    keyed = materialise(rows.mapInPandas(_keyed(dims), "vec_id long, label long, key binary, v binary"), "keyed")
    return materialise(keyed.repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id").mapInPandas(_blocks(dims, every), BLOCK), "blocks")


def _anchors(dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, block, ids, labels, raw, at, floors in zip(*(batch[c] for c in ("part", "block", "ids", "labels", "v", "anchors", "floors")), strict=True):
                yield pd.DataFrame({"part": part, "block": block, "anchor_id": ids[at], "label": labels[at], "floor": floors,
                                    "v": [raw[4 * dims * i:4 * dims * (i + 1)] for i in at]})
    return run


def _needed(a: np.ndarray, anchors: pd.DataFrame, zones: pd.DataFrame, windows: bool) -> np.ndarray:
    """Whether each of the ``anchors`` must read each block, from the least and
    the greatest product that a vector between the block's lo and hi can have.

    For positives: the block holds the anchor's label and the greatest product
    reaches the anchor's floor.  For windows: it holds another label, and the
    products can fall into the window of one of the anchor's positives."""
    lo, hi = (np.array(zones[c].tolist(), np.int64).reshape(len(zones), -1) for c in ("lo", "hi"))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = _product(up, lo) + _product(down, hi), _product(up, hi) + _product(down, lo)
    labels = anchors["label"].to_numpy(np.int64)
    if windows:
        other = np.array([[len(held) > 1 or held[0] != label for held in zones["held"]] for label in labels], bool)
        meets = np.array([((HIGH * s[:, None] >= 100 * low) & (LOW * s[:, None] <= 100 * top)).any(axis=0)
                          for s, low, top in zip(anchors["scores"], least, most, strict=True)], bool)
        return meets & other
    own = np.array([[label in held for held in zones["held"]] for label in labels], bool)
    return own & (most >= anchors["floor"].to_numpy(np.int64)[:, None])


def _slices(anchors: pd.DataFrame, dims: int):
    for i in range(0, len(anchors), SLICE):
        some = anchors.iloc[i:i + SLICE]
        yield some, _matrix(some["v"].tolist(), dims)


def _demanded(dims: int, windows: bool):
    def run(zones: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        need = np.zeros(len(zones), bool)
        if len(zones):
            for some, a in _slices(anchors, dims):
                need |= _needed(a, some, zones, windows).any(axis=0)
        return zones.loc[need, ["shelf", "block", "grp"]]
    return run


def _first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The rows in order of score, ties by id."""
    return np.lexsort((ids, -scores))


def _found(dims: int, windows: bool):
    """What the anchors of a group find in the blocks of a shelf, the WANTED first for each positive (k) or, without windows, for each anchor."""
    def run(shelf: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shelf):
            v, ids, labels = _matrix(shelf["v"].tolist(), dims), np.concatenate(shelf["ids"].tolist()), np.concatenate(shelf["labels"].tolist())
            block = np.repeat(np.arange(len(shelf)), shelf["ids"].map(len))
            for some, a in _slices(anchors, dims):
                rows = np.flatnonzero(_needed(a, some, shelf, windows).any(axis=0)[block])
                for i, (anchor, label, scores) in enumerate(zip(some["anchor_id"], some["label"], _product(a, v[rows]), strict=True)):
                    if not windows:
                        at = np.flatnonzero((labels[rows] == label) & (ids[rows] != anchor))
                        if at.size > WANTED:  # with all that tie with the last
                            at = at[scores[at] >= np.partition(scores[at], -WANTED)[-WANTED]]
                        at = at[_first(scores[at], ids[rows[at]])][:WANTED]
                        out.extend((anchor, 0, int(ids[rows[x]]), int(scores[x])) for x in at)
                        continue
                    wanted = some["scores"].iloc[i]
                    at = np.flatnonzero((labels[rows] != label) & (100 * scores >= LOW * wanted.min()) & (100 * scores <= HIGH * wanted.max()))
                    at = at[_first(scores[at], ids[rows[at]])]
                    for k, p in enumerate(wanted):
                        fits = at[(100 * scores[at] >= LOW * p) & (100 * scores[at] <= HIGH * p)][:WANTED]
                        out.extend((anchor, k, int(ids[rows[x]]), int(scores[x])) for x in fits)
        return pd.DataFrame(out, columns=["anchor_id", "k", "found_id", "score"])
    return run


def search(stored: DataFrame, anchors: DataFrame, dims: int, groups: int, windows: bool) -> DataFrame:
    """anchor_id, k, found_id, score, rank: the WANTED first rows for each anchor (and positive k).

    Each group of anchors meets the zone maps of each shelf; only the blocks that
    a group demands are read for it.  A task holds a shelf and a group, which
    are both bounded; what it found is cut to the WANTED first before it is shuffled."""
    all_groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    zones = stored.select("shelf", "block", "lo", "hi", "held").withColumn("grp", all_groups)
    met = anchors.join(stored.select(F.col("shelf").alias("at")).distinct().withColumn("grp", all_groups), "grp")
    demand = materialise(zones.groupBy("shelf", "grp").cogroup(met.groupBy("at", "grp"))
                         .applyInPandas(_demanded(dims, windows), "shelf long, block long, grp long"), "demand")
    read = stored.select("shelf", "block", "lo", "hi", "held", "ids", "labels", "v").join(demand, ["shelf", "block"])
    met = anchors.join(demand.selectExpr("shelf at", "grp").distinct(), "grp")
    found = (read.groupBy("shelf", "grp").cogroup(met.groupBy("at", "grp")).applyInPandas(_found(dims, windows), FOUND))
    order = Window.partitionBy("anchor_id", "k").orderBy(F.desc("score"), "found_id")
    return materialise(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= WANTED), "found")


def hard_negatives(rows: DataFrame, every: int = 100, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; their positives are the
    5 rows of the same label with the greatest inner products of floor(256 * x);
    their negatives the 5 first rows of other labels whose score is 80 to 100 per
    cent of the positive's.  Ties go by the smaller id.  An anchor without
    another row of its label, and a positive without such negatives, give no rows.

    Rows with a null id, label or vector, or a null or non-finite component, take
    no part.  Of rows that share an id, the least by label and vector does.
    Missing components count as zero where lengths differ, an empty vector
    scores 0 with everything; integer components beyond +-2 ** 24 are held there.  Other
    columns are not looked at; an empty table gives no rows.

    The bounds save reading only where the data cluster: the blocks of vectors without
    any direction all stay within reach, and are then all read.  The result is exact either way."""
    vec = F.col("vec")
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & F.forall(
        vec, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    src = (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("vec")).where(sound)
           .groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec"))
    src = materialise(src, "vectors")
    dims = src.agg(F.max(F.size("vec"))).first()[0] or 0
    stored = blocks(src, dims, every)
    parts, n = stored.agg(F.max("part") + 1, F.sum(F.size("anchors"))).first()
    groups = -(-(n or 1) // GROUP)
    anchors = (stored.where("size(anchors) > 0").mapInPandas(_anchors(dims), "part long, block long, anchor_id long, label long, floor long, v binary")
               .withColumn("grp", F.expr(f"part * {groups} div {parts or 1}")).drop("part"))
    anchors = materialise(anchors, "anchors")
    positives = search(stored, anchors, dims, groups, False)
    scores = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s")).select("anchor_id", F.col("s.score").alias("scores"))
    negatives = search(stored, materialise(anchors.join(scores, "anchor_id"), "scored"), dims, groups, True)
    return (negatives.select("anchor_id", "k", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(positives.select("anchor_id", (F.col("rank") - 1).alias("k"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")),
                  ["anchor_id", "k"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: The same rows in DuckDB's SQL, for vectors of one length.
SQL = """
    with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                      list_transform(embedding, lambda x: floor(256 * x::double)) v
               from embeddings where label is not null and embedding is not null and vec_id is not null
                      and coalesce(list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))), true)),
         s as (select a.vec_id a, b.vec_id b, a.label = b.label same, list_inner_product(a.v, b.v)::bigint score
               from e a join e b on a.vec_id % 100 = 0 and a.vec_id != b.vec_id),
         p as (select a, b, score, row_number() over (partition by a order by score desc, b) k from s where same),
         n as (select p.a, p.b p, p.score ps, s.b n, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) r
               from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score where k <= 5)
    select a anchor_id, p positive_id, r::int rank, n negative_id, ps positive_score, ns negative_score from n where r <= 5"""
