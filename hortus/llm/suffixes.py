"""Repeated passages by a sparse suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hortus.llm.common import _powers, materialise, mix, signed, word_hashes

#: A passage of LEAST words holds a minimiser (of WINDOW runs of GRAM words) in its
#: first GRAM + WINDOW - 1 words, so it has at most WINDOW - 1 words before one.
LEAST, GRAM, WINDOW = 50, 16, 16
#: Rows of keys gathered before they leave a task.
ROWS = 20_000


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, run hashes) at which the hash is the smallest of a window of runs."""
    if words.size < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _run_hashes(words, np.arange(words.size - GRAM + 1), GRAM)
    at = np.lib.stride_tricks.sliding_window_view(g, WINDOW).argmin(axis=1) + np.arange(g.size - WINDOW + 1)
    at = at[np.diff(at, prepend=-1) != 0]
    return at, g[at]


def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for i in range(0, len(b), 256):
            ids, at, keys = [], [], []
            for doc_id, text in zip(b["doc_id"][i:i + 256], b["text"][i:i + 256]):
                p, k = minimisers(word_hashes(text)[0])
                ids += [doc_id] * p.size
                at += p.tolist()
                keys += signed(k)
            yield pd.DataFrame({"doc_id": ids, "pos": at, "run": keys})


def _places(at: np.ndarray, wanted: np.ndarray, n: int, least: int) -> np.ndarray:
    """Starts of the runs of ``least`` words whose minimisers all occur elsewhere.

    Every run has its first minimiser 0 to WINDOW - 1 words after its start; a
    run that occurs twice has the same minimisers at both places."""
    gone = np.zeros(n - GRAM + 2, np.int64)
    only = at[~np.isin(at, wanted)]
    gone[only + 1] = 1
    gone = np.cumsum(gone)
    kept = np.zeros(n, bool)
    for left in range(WINDOW):
        start = wanted - left
        kept[start[(start >= 0) & (start + least <= n)]] = True
    start = np.flatnonzero(kept)
    # The minimisers of the run's own windows lie in its first and last GRAM-long run or between; the
    # outermost positions may be minimisers only of windows that reach beyond it, so those are not asked.
    low, high = start + WINDOW - 1, start + least - GRAM - WINDOW + 2
    return start[(high <= low) | (gone[np.maximum(high, low)] == gone[low])]


def _run_hashes(words: np.ndarray, start: np.ndarray, least: int) -> np.ndarray:
    """Hash of the run of ``least`` words from each start, from one prefix sum."""
    p, inverse = _powers(words.size + 1)
    sums = np.zeros(words.size + 1, np.uint64)
    np.cumsum(words * p[:words.size], out=sums[1:])
    return mix((sums[start + least] - sums[start]) * inverse[start])


def _keys(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The retained suffixes extended to the left: two hashes of every whole run of ``least`` words that may occur twice."""
        columns = ("doc_id", "pos", "k1", "k2")
        for b in batches:
            held, rows = [], 0  # a frame of its own for each document costs more than its hashes
            for doc_id, text, wanted in zip(b["doc_id"], b["text"], b["at"]):
                h = word_hashes(text)[0]
                if h.size >= least:
                    start = _places(minimisers(h)[0], np.asarray(wanted, np.int64), h.size, least)
                    held.append((np.full(start.size, doc_id, np.int64), start, _run_hashes(h, start, least).view(np.int64),
                                 _run_hashes(mix(h + np.uint64(1)), start, least).view(np.int64)))
                    rows += start.size
                if rows >= ROWS:
                    yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*held)))))
                    held, rows = [], 0
            if held:
                yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*held)))))
    return run


def _neighbours(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Equal neighbours in a range of the sorted runs (side null), and its first and last run (side 0 and 1)."""
        last, part, columns = None, None, ["doc_id", "start", "stop", "other_id", "part", "side", "k1", "k2"]

        def rim(row, side):
            return pd.DataFrame([(row[0], row[1], None, None, part, side, row[2], row[3])], columns=columns).astype("Int64")

        for b in batches:
            if not len(b):
                continue
            d, p, x, y = (b[c].to_numpy(np.int64) for c in ("doc_id", "pos", "k1", "k2"))
            if last is None:
                part = int(b["part"].iloc[0])
                yield rim((int(d[0]), int(p[0]), int(x[0]), int(y[0])), 0)
            else:
                d, p, x, y = (np.append(np.int64(l), c) for l, c in zip(last, (d, p, x, y)))
            last = (int(d[-1]), int(p[-1]), int(x[-1]), int(y[-1]))
            i = np.flatnonzero((x[1:] == x[:-1]) & (y[1:] == y[:-1]) & ((d[1:] != d[:-1]) | (p[1:] != p[:-1])))
            yield _joined(d[i], p[i], d[i + 1], p[i + 1], least).reindex(columns=columns).astype("Int64")
        if last is not None:
            yield rim(last, 1)
    return run


def _joined(d, p, e, q, least: int) -> pd.DataFrame:
    """Both sides of equal runs, those that follow each other in one document beside the same other one as one span."""
    doc, pos, other = np.concatenate([d, e]), np.concatenate([p, q]), np.concatenate([e, d])
    order = np.lexsort((pos, other, doc))
    doc, pos, other = doc[order], pos[order], other[order]
    cut = np.ones(doc.size, bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (pos[1:] > pos[:-1] + least)
    first = np.flatnonzero(cut)
    stop = pos[np.append(first[1:], doc.size) - 1] + least if doc.size else pos
    return pd.DataFrame({"doc_id": doc[first], "start": pos[first], "stop": stop, "other_id": other[first]})


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, spans, others: one row per document with a passage of ``least`` words or
    more (50 or any greater number) that also stands elsewhere in the table.

    ``spans``: merged word ranges [start, stop) of the whole text; ``others``:
    documents that stand beside it in the sorted suffixes (itself when it
    repeats its own words).  Words are cut at white space, A-Z lowered.

    Suffixes are retained at minimiser positions, which depend on content
    alone, so equal passages retain equal positions; those of runs that occur
    once are dropped.  Each retained suffix is extended to the left by 0 to
    WINDOW - 1 words, so that a key holds a whole run of ``least`` words
    whatever stands around it; the keys (128-bit hashes of the run) are sorted
    globally and equal neighbours are repeats.  A range of the order is one
    task's; ranges split hot runs by doc_id and position, and two rows per
    range join them up.
    Rows without an id or text have no passages; repeated rows of one id are
    one document; an empty table gives no rows."""
    if least < LEAST:
        raise ValueError(f"least is {LEAST} or more")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    at = materialise(src.mapInPandas(_positions, "doc_id long, pos long, run long"), "positions")
    runs = materialise(at.groupBy("run").agg(F.count("*").alias("c")).where("c > 1").select("run"), "runs")
    wanted = materialise(at.join(runs, "run", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("pos")).alias("at")), "wanted")
    kept = materialise(src.join(wanted, "doc_id").dropDuplicates(["doc_id"])
                       .mapInPandas(_keys(least), "doc_id long, pos long, k1 long, k2 long"), "suffixes")
    order = ["k1", "k2", "doc_id", "pos"]
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    found = materialise(ranged.mapInPandas(_neighbours(least), "doc_id long, start long, stop long, other_id long, "
                                           "part long, side long, k1 long, k2 long"), "matches")
    w = Window.orderBy("part", "side")  # two rows per range
    rims = found.where("side is not null").select("doc_id", F.col("start").alias("pos"), "k1", "k2", "part", "side")
    pairs = rims.select(*[F.lag(c).over(w).alias(f"l_{c}") for c in ("doc_id", "pos", "k1", "k2")], "doc_id", "pos", "k1", "k2", "side")
    joints = (pairs.where("side = 0 and l_k1 = k1 and l_k2 = k2 and (l_doc_id != doc_id or l_pos != pos)")
              .selectExpr(f"inline(array(struct(doc_id, pos as start, pos + {least} as stop, l_doc_id as other_id), "
                          f"struct(l_doc_id as doc_id, l_pos as start, l_pos + {least} as stop, doc_id as other_id)))"))
    matches = found.where("side is null").select("doc_id", "start", "stop", "other_id").unionAll(joints)
    merged = F.expr("""aggregate(s, cast(array() as array<struct<start: bigint, stop: bigint>>), (a, x) ->
        if(size(a) > 0 and x.start <= a[size(a) - 1].stop,
           concat(slice(a, 1, size(a) - 1), array(struct(a[size(a) - 1].start as start, greatest(a[size(a) - 1].stop, x.stop) as stop))),
           concat(a, array(x))))""")
    return (matches.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("s"),
                                          F.array_sort(F.collect_set("other_id")).alias("others"))
            .select("doc_id", merged.alias("spans"), "others"))
