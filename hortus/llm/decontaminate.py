"""Benchmark passages in documents: an exact bound from word counts, then longest common subsequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.llm.common import ALNUM, word_hashes

BLOCK = 16
#: Words handled at once in a task; a longer text goes through in several pieces.
PIECE = 1 << 16


class Item:
    """One benchmark text; its last quarter is the answer."""

    def __init__(self, item_id, text, least):
        self.id, h = item_id, word_hashes(text, ALNUM)[0]
        self.n, self.words = int(h.size), h
        self.need = max(int(np.ceil(least * self.n)), min(self.n, 5))
        self.blocks = -(-self.n // BLOCK) + 1  # holds every run of n words, wherever it starts in its first block
        self.masks = self._masks(h.tolist())
        tail = h[self.n - max(1, self.n // 4):].tolist() if self.n else []
        self.answer_n, self.answer = len(tail), self._masks(tail)

    @staticmethod
    def _masks(h: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(h):
            out[w] = out.get(w, 0) | 1 << i
        return out


def common_length(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence (bit parallel)."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


class Group:
    """The items whose windows have the same number of blocks."""

    def __init__(self, blocks: int, members: list[Item], vocabulary: np.ndarray):
        self.blocks, self.members = blocks, members
        own = np.unique(np.concatenate([m.words for m in members]))
        #: Number of each word of the vocabulary in this group; 0 for other words.
        self.number = np.zeros(vocabulary.size + 1, np.int32)
        self.number[np.searchsorted(vocabulary, own) + 1] = np.arange(1, own.size + 1)
        self.has = np.zeros((own.size + 1, len(members)), np.uint8)
        keys, masks = [], []
        for j, m in enumerate(members):
            w = np.searchsorted(own, np.array(list(m.masks), np.uint64)) + 1
            self.has[w, j] = 1
            if m.n < 64:
                keys.append(w * len(members) + j)
                masks.append(np.array(list(m.masks.values()), np.uint64))
        order = np.argsort(np.concatenate(keys)) if keys else []
        self.keys = np.concatenate(keys)[order] if keys else np.zeros(0, np.int64)
        self.masks = np.concatenate(masks)[order] if keys else np.zeros(0, np.uint64)
        self.need = np.array([m.need for m in members])
        self.full = np.array([(1 << m.n) - 1 if m.n < 64 else 0 for m in members], np.uint64)
        self.counts = np.uint8 if blocks * BLOCK < 256 else np.uint32

    def candidates(self, words: np.ndarray, use: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) wherever enough words of the window are words of the item: no common subsequence is longer."""
        at = words.reshape(-1, BLOCK)
        held = np.zeros((len(at) + self.blocks, len(self.members)), self.counts)
        for i in range(BLOCK):
            held[:len(at)] += self.has[at[:, i]]
        count = held[use]
        for i in range(1, self.blocks):
            count += np.where((use + i < end)[:, None], held[use + i], 0)
        return np.nonzero(count >= self.need)

    def common(self, words: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common subsequences of windows (rows of ``words``) and items of fewer than 64 words (bit parallel)."""
        full = self.full[j]
        v = full.copy()
        masks = np.zeros(words.shape, np.uint64)
        r, c = np.nonzero(self.has[words, j[:, None]] * (full > 0)[:, None])
        masks[r, c] = self.masks[np.searchsorted(self.keys, words[r, c].astype(np.int64) * len(self.members) + j[r])]
        for m in masks.T:
            u = v & m
            v = ((v + u) | (v - u)) & full
        return np.bitwise_count(full).astype(np.int64) - np.bitwise_count(v)


def _search(items: list[Item], answer: float):
    sizes = {}
    for item in items:
        if item.n:
            sizes.setdefault(item.blocks, []).append(item)
    vocabulary = np.unique(np.concatenate([i.words for i in items if i.n])) if sizes else np.zeros(0, np.uint64)
    groups = [Group(q, members, vocabulary) for q, members in sizes.items()]

    def hits(texts: list[np.ndarray], ids: list):
        """texts: word hashes of whole texts, or of overlapping pieces of a long one."""
        padded, owner, last = [], [], []
        for d, h in enumerate(texts):
            blocks = -(-h.size // BLOCK)
            near = np.minimum(np.searchsorted(vocabulary, h), vocabulary.size - 1)
            pad = np.zeros(blocks * BLOCK, np.int32)
            pad[:h.size] = np.where(vocabulary[near] == h, near + 1, 0)
            padded.append(pad)
            last += [len(owner) + blocks] * blocks
            owner += [d] * blocks
        if not owner:
            return
        f, owner, last = np.concatenate(padded), np.array(owner), np.array(last)
        start = np.arange(owner.size)
        first = np.diff(owner, prepend=-1) != 0
        at0 = np.flatnonzero(first)[np.cumsum(first) - 1]
        for g in groups:
            q = g.blocks
            use = start[first | (start + q <= last)]
            end = np.minimum(use + q, last[use])
            words = g.number[f]
            runs = np.lib.stride_tricks.sliding_window_view(np.append(words, np.zeros(BLOCK * q, np.int32)), q * BLOCK)[::BLOCK]
            c, j = g.candidates(words, use, end)
            for lo in range(0, c.size, 8192):
                cc, jj = c[lo:lo + 8192], j[lo:lo + 8192]
                inside = np.where(np.arange(q * BLOCK) < ((end - use)[cc] * BLOCK)[:, None], runs[use[cc]], 0)
                enough = (g.full[jj] == 0) | (g.common(inside, jj) >= g.need[jj])
                for a, b in zip(cc[enough], jj[enough]):
                    item, d = g.members[b], owner[use[a]]
                    i = int(use[a] - at0[use[a]]) * BLOCK
                    window = texts[d][i:i + int(end[a] - use[a]) * BLOCK].tolist()
                    common = common_length(item.masks, item.n, window)
                    if common >= item.need and common_length(item.answer, item.answer_n, window) >= answer * item.answer_n:
                        yield ids[d], item.id, i, common, item.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        overlap = max((g.blocks for g in groups), default=0) * BLOCK
        for batch in batches:
            out, held, ids, count = [], [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                h = word_hashes(text, ALNUM)[0]
                for i in range(0, h.size, PIECE):
                    held.append(h[i:i + PIECE + overlap])
                    ids.append(doc_id)
                    count += held[-1].size
                    if count >= PIECE:
                        out += hits(held, ids) if groups else []
                        held, ids, count = [], [], 0
            if held and groups:
                out += hits(held, ids)
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "at", "common", "n_words"])
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.7, answer: float = 0.5,
                 items_per_pass: int = 2048) -> DataFrame:
    """doc_id, item_id, common, n_words: one row per document and benchmark item found in it.

    Every window of every whole text is compared with every item.  The number
    of its words that are words of the item bounds their longest common
    subsequence, so no window is lost where that is too small; the others are
    confirmed when a longest common subsequence covers ``least`` of the item's
    words and ``answer`` of its last quarter.  Windows start at every
    ``BLOCK``-th word and are long enough that every run of as many words as
    the item has lies in one.  Items go through in passes of
    ``items_per_pass``, so what a task holds does not grow with the benchmark.
    Null and empty texts on either side match nothing; rows without an id are
    not reported; repeated rows and items count once; empty tables give no
    rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    known = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    passes, held = [], []

    def search(rows):
        items = [Item(r["item_id"], r["text"], least) for r in rows]
        return texts.mapInPandas(_search(items, answer), "doc_id long, item_id long, at long, common long, n_words long")

    for row in known.toLocalIterator():
        held.append(row)
        if len(held) == items_per_pass:
            passes.append(search(held))
            held = []
    if held or not passes:
        passes.append(search(held))
    found = passes[0]
    for p in passes[1:]:
        found = found.unionAll(p)
    return found.groupBy("doc_id", "item_id").agg(F.max("common").alias("common"), F.max("n_words").alias("n_words"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, columns unchanged."""
    return docs.join(contaminated(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
