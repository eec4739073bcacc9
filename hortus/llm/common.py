"""Helpers shared by the operators: written tables, word hashes, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.session import checkpoint_dir


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back: the
    lineage is cut, so a lost executor costs no recomputation upstream, and a
    later join meets a plain scan (AQE can split a hot key on either side)."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UP, _DOWN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A-Z lowered, the white space of the contracts ([\x20\x09-\x0D]) made blanks.
SPACED = bytes.maketrans(_UP + b"\t\n\x0b\x0c\r", _DOWN + b"     ")
#: As SPACED, and every other ASCII byte that is no letter or digit is a blank too.
ALNUM = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in SPACED)

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int):
    if "p" not in _POWERS or _POWERS["p"].size < n:
        size = max(4096, 1 << int(n).bit_length())
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps)
    return _POWERS["p"][:n], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_NONE = np.zeros(0, np.uint64)
_NOWHERE = np.zeros(0, np.int64)


def word_hashes(text: str | None, letters: bytes = SPACED):
    """(hash, first byte, byte after) of every word of the whole text, in order.

    Polynomial hashes from one prefix sum over the bytes, so the cost is a few
    array operations per text, whatever the number of words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(letters)
    a = np.frombuffer(raw, np.uint8)
    inside = np.zeros(a.size + 2, np.int8)
    inside[1:-1] = a != 32
    edge = np.diff(inside)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not s.size:
        return _NONE, _NOWHERE, _NOWHERE
    p, inverse = _powers(a.size)
    sums = np.zeros(a.size + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * p, out=sums[1:])
    h = (sums[e] - sums[s]) * inverse[s]
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), s, e


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; fewer words than ``k`` make one run."""
    n = words.size
    if not n:
        return _NONE
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    multiplier = 0x2545F4914F6CDD1D
    for i in range(width):
        out += words[i:i + n - width + 1] * np.uint64(multiplier)
        multiplier = multiplier * 0x5851F42D4C957F2D % (1 << 64) | 1
    return mix(out)


def signed(x) -> list:
    return np.asarray(x, np.uint64).view(np.int64).tolist()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every linked id but the smallest of each component.

    Alternating large and small stars over the edge table: every vertex moves
    to the smallest neighbour until the edges stop changing.  Minima are
    combined before the shuffle and joined back from a written table, so a
    vertex with a third of all edges is split."""
    edges = materialise(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                        .where("hi != lo").distinct(), "edges")
    state = None
    while True:
        both = edges.selectExpr("hi u", "lo v").unionAll(edges.selectExpr("lo u", "hi v"))
        low = materialise(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "low")
        large = materialise(both.where("v > u").join(low, "u").selectExpr("v hi", "m lo").distinct(), "large")
        low = materialise(large.groupBy("hi").agg(F.min("lo").alias("m")), "low")
        small = (large.join(low, "hi").where("lo != m").selectExpr("lo hi", "m lo")
                 .unionAll(low.selectExpr("hi", "m lo")).distinct())
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.selectExpr("hi id", "lo component")
        state = now
