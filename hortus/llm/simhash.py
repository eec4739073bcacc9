"""SimHash near duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.llm.common import components, materialise

BITS, RADIUS, WORDS, SEED = 64, 4, 4, 42
#: Most fingerprints of a bucket that are compared with one another; larger buckets are split by further bits.
BUCKET = 1024
#: Shingles hashed at once, rows of buckets compared at once, links held before they are reduced to stars.
RUN, ROWS, LINKS = 1 << 16, 1 << 17, 1 << 21


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The bits set in more than half of the hashes of the text's word shingles, as an unsigned number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    ends = list(accumulate(len(w) + 1 for w in found))
    said, width = b" ".join(found), min(words, len(found))
    spans = [(a, b - 1) for a, b in zip([0, *ends], ends[width - 1:], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(spans), RUN):
        h = np.array([xxhash.xxh64_intdigest(said[a:b], SEED) for a, b in spans[i:i + RUN]], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans)).tobytes(), "big")


def masks(radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks, of about half the bits each, one of which
    leaves out any ``radius`` bits given.

    Each bit has a non-zero vector of radius + 1 binary digits; a mask takes the
    bits whose vectors have an odd product with its own.  The vectors of
    ``radius`` bits span less than the whole space, so some mask's vector has
    an even product with all of them."""
    size = 2 ** (radius + 1)
    return [sum(1 << i for i in range(BITS) if (v & (1 + i % (size - 1))).bit_count() % 2) for v in range(1, size)]


def finer(mask: int, radius: int = RADIUS) -> list[int]:
    """radius + 1 masks that each add another part of the bits left: two
    fingerprints that differ in ``radius`` bits at most are equal in one part."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[j::radius + 1]) for j in range(radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": [_signed(fingerprint(t, words)) for t in batch["text"]]})
    return run


def _split(radius: int):
    """Rows of too large buckets, once under each finer mask."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mask, part in batch.groupby("mask"):
                fp = part["fp"].to_numpy(np.int64)
                for m in finer(int(mask) % (1 << 64), radius):
                    yield pd.DataFrame({"mask": _signed(m), "val": fp & np.int64(_signed(m)), "fp": fp})
    return run


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest member, member) for the connected components of the links a-b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:a.size], at[a.size:]
    root = np.arange(ids.size)
    while True:
        before, rx, ry = root.copy(), root[x], root[y]
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        root = root[root]
        if (root == before).all():
            return ids[root], ids


def _near(radius: int):
    """Links within each bucket, reduced to stars; rows come sorted by bucket."""
    def links(mask: np.ndarray, val: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        ends = np.r_[new[1:], fp.size]
        after = np.repeat(ends, ends - new) - np.arange(fp.size) - 1  # rows of the bucket that follow
        a, b, held = [], [], 0

        def star():
            lo, hi = stars(np.concatenate(a), np.concatenate(b))
            return lo[lo != hi], hi[lo != hi]

        row, step = np.flatnonzero(after > 0), 1
        while row.size:
            near = row[np.bitwise_count(fp[row] ^ fp[row + step]) <= radius]
            a.append(fp[near])
            b.append(fp[near + step])
            held += near.size
            if held > LINKS:
                lo, hi = star()
                a, b, held = [lo], [hi], lo.size
            step += 1
            row = row[after[row] >= step]
        if held:
            lo, hi = star()
            yield pd.DataFrame({"a": lo.view(np.int64), "b": hi.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch[c].to_numpy(np.int64)]) for h, c in zip(held, ("mask", "val", "fp"), strict=True)]
            if held[0].size >= ROWS:  # all but the last bucket, which may go on
                cut = int(np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))[-1:].sum()) + 1
                if cut < held[0].size and cut > 1:
                    yield from links(held[0][:cut], held[1][:cut], held[2][:cut].view(np.uint64))
                    held = [h[cut:] for h in held]
        if held[0].size:
            yield from links(held[0], held[1], held[2].view(np.uint64))
    return run


def linked(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect just the distinct fingerprints ``fp`` which
    chains of steps of at most ``radius`` bits connect.

    Every fingerprint is posted under each covering mask, so each pair within
    the radius meets in a bucket.  A bucket with more than ``bucket``
    fingerprints is posted again under finer masks, until it is small: no bucket
    is cut, none grows with the data, and only stars leave a task."""
    tables = F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("val"))
                                 for m in masks(radius)]))
    rows = fps.select("fp", tables.alias("t")).select("t.mask", "t.val", "fp")
    found = None
    while True:
        sizes = materialise(rows.groupBy("mask", "val").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        shared = materialise(rows.join(sizes, ["mask", "val"]), "buckets")
        small = (shared.where(f"n <= {bucket}").select("mask", "val", "fp").repartition("mask", "val")
                 .sortWithinPartitions("mask", "val").mapInPandas(_near(radius), "a long, b long"))
        links = materialise(small, "links")
        found = links if found is None else found.unionAll(links)
        large = shared.where(f"n > {bucket}")
        if large.isEmpty():
            return found.distinct()
        rows = materialise(large.select("mask", "val", "fp").mapInPandas(_split(radius), "mask long, val long, fp long").distinct(), "split")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    Null and empty texts, and those without words, have fingerprint zero, which
    links like any other.  Equal fingerprints are one node, so repeated rows,
    ties and groups of copies cost one posting.  Rows of one id with different texts
    have a fingerprint each.  A row without id links nothing and has no
    component.  Other columns are not looked at; an empty table gives no rows."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialise(src.mapInPandas(_fingerprints(words), "doc_id long, fp long"), "prints")
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(linked(nodes.select("fp"), radius, bucket))
    placed = materialise(nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left")
                         .select("fp", "first", F.coalesce("component", "fp").alias("root")), "placed")
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    placed = materialise(placed.join(least, "root").select("fp", "least"), "components")
    own = F.when(F.col("doc_id").isNotNull(), F.col("least"))
    return (prints.join(placed, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id")))
