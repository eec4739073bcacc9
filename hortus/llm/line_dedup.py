"""Repeated lines or paragraphs: the earliest stays, the others are cut out."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from hortus.llm.common import materialise

BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t]*(?:\n[ \t]*)+")}


def units(text: str | None, unit: str = "line"):
    """(start, length, normalised) of every unit; the length includes the break after it."""
    text, at = text or "", 0
    for m in BREAKS[unit].finditer(text):
        yield at, m.end() - at, " ".join(text[at:m.start()].lower().split())
        at = m.end()
    if at < len(text):
        yield at, len(text) - at, " ".join(text[at:].lower().split())


def _text_key() -> Column:
    """128-bit digest of the text, which tells texts of one id apart; null without a text."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def repeated_units(docs: DataFrame, unit: str = "line", least_words: int = 5) -> DataFrame:
    """doc_id, text_key, start, length, keep_doc_id, keep_start of every unit that goes.

    Units are compared in lower case with blanks collapsed, by 128-bit digest,
    over the whole table.  Ranked by (doc_id, start), a null id last, the
    earliest stays; texts of one id are told apart by ``text_key``, which breaks
    ties.  Units under ``least_words`` words are never removed."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                out = []
                for doc_id, key, text in zip(b["doc_id"][i:i + 512], b["text_key"][i:i + 512], b["text"][i:i + 512]):
                    for start, length, words in units(text, unit):
                        if words.count(" ") + 1 >= least_words and words:
                            out.append((doc_id, key, start, length,
                                        hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
                yield pd.DataFrame(out, columns=["doc_id", "text_key", "start", "length", "digest"])

    found = materialise(docs.select(F.col("doc_id").cast("string").alias("doc_id"), _text_key().alias("text_key"), "text")
                        .mapInPandas(split, "doc_id string, text_key binary, start long, length long, digest binary")
                        .withColumn("doc_id", F.col("doc_id").cast("long")), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "text_key")
    groups = materialise(found.groupBy("digest").agg(F.min(rank).alias("k"), F.count("*").alias("c")).where("c > 1")
                         .selectExpr("digest", "k.doc_id keep_doc_id", "k.start keep_start", "k.text_key keep_key"), "groups")
    return (found.join(groups, "digest").where("not (doc_id <=> keep_doc_id and start = keep_start and text_key = keep_key)")
            .select("doc_id", "text_key", "start", "length", "keep_doc_id", "keep_start"))


def drop_repeated(docs: DataFrame, unit: str = "line", least_words: int = 5) -> DataFrame:
    """doc_id, text, n_removed, removed for every row: the text without repeated units,
    and the removed units with offsets in the original (code points, the break
    included) and the occurrence that stays.

    Null texts stay null; repeated rows of one id and text are the same document
    and lose the same units, other texts of that id only their own; rows without
    an id lose nothing; an empty table gives no rows."""
    spans = F.struct("start", "length", "keep_doc_id", "keep_start")
    gone = materialise(repeated_units(docs, unit, least_words).where("doc_id is not null").groupBy("doc_id", "text_key")
                       .agg(F.array_sort(F.collect_set(spans)).alias("removed")), "gone")

    @pandas_udf("string")
    def cut(text: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        out = []
        for t, s, n in zip(text, start, length):
            if t is None or s is None:
                out.append(t)
                continue
            at, kept = 0, []
            for a, k in zip(s, n):
                kept.append(t[at:a])
                at = a + k
            out.append("".join(kept) + t[at:])
        return pd.Series(out, dtype=object)

    joined = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("text_key"), "text")
              .join(gone, ["doc_id", "text_key"], "left"))
    return joined.select("doc_id", cut("text", "removed.start", "removed.length").alias("text"),
                         F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), "removed")
