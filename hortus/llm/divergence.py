"""Source divergence audit: how far the term shares of sources lie apart, counted through a minimal acyclic transducer."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hortus.llm.common import materialise

#: A kept term stands in so many documents of its language; shares are in billionths, with this much added to every count.
LEAST, SCALE, ADDED, RANKS = 30, 1_000_000_000, 5, 50
#: Terms of one transducer; bytes of transducers sent to the tasks for one pass over the texts; entries a task adds up before it hands them on (places, which are only numbers: 16 times as many).
TERMS, SENT, HELD = 1 << 16, 64 << 20, 1 << 18
#: Terms and sources compared at once.
BLOCK, SOURCES = 256, 32

#: A-Z lowered, every other byte that is neither a letter nor part of a code point from U+0080 on made a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


class Transducer:
    """Minimal acyclic automaton of sorted terms whose transitions sum up to a term's place in the order.

    ``edges`` are state * 256 + byte in ascending order, with the state each
    leads to and the number of terms that come before any term through it, among
    those of its state.  ``final`` marks the states in which a term ends."""

    def __init__(self, start: int, edges: np.ndarray, to: np.ndarray, before: np.ndarray, final: np.ndarray):
        self.start, self.edges, self.to, self.before, self.final = start, edges, to, before, final

    def packed(self) -> bytes:
        return pickle.dumps((self.start, self.edges, self.to, self.before, self.final))

    @classmethod
    def unpacked(cls, raw: bytes) -> Transducer:
        return cls(*pickle.loads(raw))

    @classmethod
    def of(cls, terms: list[bytes]) -> Transducer:
        """Built from sorted, distinct terms: what no later term can change is settled, equal states as one."""
        known: dict[tuple, int] = {}  # what can follow a state -> the state
        states: list[tuple] = []
        sizes: list[int] = []  # terms that end in the state or beyond

        def settle(open_state: list) -> int:
            key = (open_state[0], tuple(open_state[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
                sizes.append(open_state[0] + sum(sizes[s] for _, s in open_state[1]))
            return known[key]

        path, last = [[False, []]], b""  # the states of the last term, not yet settled: (final, edges)
        for term in terms:
            same = next((i for i, (x, y) in enumerate(zip(term, last, strict=False)) if x != y), min(len(term), len(last)))
            while len(path) > same + 1:
                done = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], done))
            path.extend([False, []] for _ in term[same:])
            path[-1][0], last = True, term
        while len(path) > 1:
            done = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        start = settle(path[0])
        edges, to, before = [], [], []
        for s, (final, out) in enumerate(states):
            passed = int(final)
            for byte, t in out:
                edges.append(s * 256 + byte)
                to.append(t)
                before.append(passed)
                passed += sizes[t]
        return cls(start, np.array(edges, np.int64), np.array(to, np.int64), np.array(before, np.int64), np.array([f for f, _ in states], bool))

    def places(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word raw[start:end] in the order of the terms, -1 for words that are no term.

        All words take a step through their next byte at a time."""
        out = np.full(start.size, -1, np.int64)
        word, state, place, at = np.arange(start.size), np.full(start.size, self.start), np.zeros(start.size, np.int64), start
        while word.size:
            over = at == end[word]
            done = over & self.final[state]
            out[word[done]] = place[done]
            on = ~over
            word, state, place, at = word[on], state[on], place[on], at[on]
            if not self.edges.size:
                break
            key = state * 256 + raw[at]
            edge = np.minimum(np.searchsorted(self.edges, key), self.edges.size - 1)
            on = self.edges[edge] == key
            edge, word = edge[on], word[on]
            state, place, at = self.to[edge], place[on] + self.before[edge], at[on] + 1
        return out

    def terms(self) -> Iterator[bytes]:
        """The terms in order."""
        open_states = [(self.start, b"")]
        while open_states:
            state, said = open_states.pop()
            if self.final[state]:
                yield said
            lo, hi = np.searchsorted(self.edges, [state * 256, state * 256 + 256])
            open_states.extend((int(self.to[i]), said + bytes([int(self.edges[i]) % 256])) for i in range(hi - 1, lo - 1, -1))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, term, n): documents with the term, added up within the task."""
    def rows() -> Iterator[pd.DataFrame]:
        for lang, c in counts.items():
            if c:  # terms hold no blank, so they can be decoded as one text
                yield pd.DataFrame({"lang": lang, "term": b" ".join(c).decode("utf-8", "surrogatepass").split(" "), "n": list(c.values())})
        counts.clear()

    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            counts.setdefault(lang, Counter()).update(set(_words(text)))
        if sum(map(len, counts.values())) > HELD:
            yield from rows()
    yield from rows()


def _transducers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for every run of up to TERMS terms of one language, from rows sorted by language and term."""
    def built(lang: str, terms: list[str]) -> pd.DataFrame:
        machine = Transducer.of([t.encode("utf-8", "surrogatepass") for t in terms])
        return pd.DataFrame({"lang": [lang], "least": [terms[0]], "n": [len(terms)], "machine": [machine.packed()]})

    held, lang = [], None
    for batch in batches:
        for own, term in zip(batch["lang"], batch["term"], strict=True):
            if held and (own != lang or len(held) == TERMS):
                yield built(lang, held)
                held = []
            lang = own
            held.append(term)
    if held:
        yield built(lang, held)


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, base, n, machine): transducers of the terms that stand in at least
    ``least`` documents of their language, in UTF-8 order; ``base`` terms of the language come before the machine's."""
    kept = (docs.mapInPandas(_document_counts, "lang string, term string, n long")
            .groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term"))
    kept = materialise(kept, "kept")
    machines = (kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
                .mapInPandas(_transducers, "lang string, least string, n long, machine binary"))
    machines = materialise(machines, "transducers")
    before = Window.partitionBy("lang").orderBy("least").rowsBetween(Window.unboundedPreceding, -1)
    # The places are laid over the machines without their bytes, a row for up to TERMS terms.
    bases = machines.select("lang", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return machines.join(bases, ["lang", "least"]).select("lang", "base", "n", "machine")


def dictionary(machines: DataFrame) -> DataFrame:
    """(lang, ord, term): the terms read back out of the transducers."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, base, raw in zip(batch["lang"], batch["base"], batch["machine"], strict=True):
                terms = [t.decode("utf-8", "surrogatepass") for t in Transducer.unpacked(raw).terms()]
                yield pd.DataFrame({"lang": lang, "ord": np.arange(base, base + len(terms)), "term": terms})
    return machines.mapInPandas(run, "lang string, ord long, term string")


def _recount(sent):
    """Texts streamed through the transducers: (lang, source, ord, n), added up within the task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines: dict[str, list] = {}
        for lang, base, raw in sent.value:
            machines.setdefault(lang, []).append((base, Transducer.unpacked(raw)))
        held: dict[tuple, list] = {}  # (lang, source) -> places, still to be counted
        size = 0

        def rows() -> Iterator[pd.DataFrame]:
            for (lang, source), places in held.items():
                found, n = np.unique(np.concatenate(places), return_counts=True)
                yield pd.DataFrame({"lang": lang, "source": source, "ord": found, "n": n})
            held.clear()

        for batch in batches:
            for key, part in batch[batch["lang"].isin(machines.keys())].groupby(["lang", "source"], sort=False):
                raw = np.frombuffer(" ".join(part["text"]).encode("utf-8", "surrogatepass").translate(TERM_BYTES), np.uint8)
                edge = np.diff(np.concatenate([[False], raw != 32, [False]]).astype(np.int8))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for base, machine in machines[key[0]]:
                    place = machine.places(raw, start, end)
                    place = place[place >= 0] + base
                    if place.size:
                        held.setdefault(key, []).append(place)
                        size += place.size
            if size > 16 * HELD:
                yield from rows()
                size = 0
        yield from rows()
    return run


def counts_by_place(docs: DataFrame, machines: DataFrame, sent_bytes: int = SENT) -> DataFrame:
    """(lang, source, ord, c) with c > 0.

    The transducers go to the tasks in parcels of at most ``sent_bytes`` (and one
    machine at least), each parcel in one pass over the texts, so what is
    broadcast does not grow with the vocabulary."""
    sc, parcels, size = docs.sparkSession.sparkContext, [[]], 0
    schema, found = "lang string, source string, ord long, n long", None

    def counted(parcel: list) -> DataFrame:
        return materialise(docs.mapInPandas(_recount(sc.broadcast(parcel)), schema)
                           .groupBy("lang", "source", "ord").agg(F.sum("n").alias("c")), "counts")

    for row in machines.toLocalIterator():
        if parcels[-1] and size + len(row["machine"]) > sent_bytes:
            done = counted(parcels.pop())
            found, parcels, size = done if found is None else found.unionAll(done), [[]], 0
        parcels[-1].append((row["lang"], row["base"], bytes(row["machine"])))
        size += len(row["machine"])
    done = counted(parcels.pop())
    return done if found is None else found.unionAll(done)


def _distances(cells: pd.DataFrame) -> pd.DataFrame:
    """Sum of abs(p - q) over a block of places for each pair of sources of two blocks."""
    v = int(cells["v"].iloc[0])
    width = min(BLOCK, v - int(cells["block"].iloc[0]) * BLOCK)
    sides = []
    for side in (0, 1):
        own = cells[cells["side"] == side]
        gids, row = np.unique(own["gid"], return_inverse=True)
        p = np.zeros((gids.size, width), np.int64)
        p[row] = own["z"].to_numpy(np.int64)[:, None]  # every place at first as though the term did not occur
        real = own["at"].notna().to_numpy()
        p[row[real], own["at"][real].to_numpy(np.int64)] = own["p"][real].to_numpy(np.int64)
        sides.append((gids, p))
    (a, pa), (b, pb) = sides
    sums = np.stack([np.abs(pa - q).sum(axis=1) for q in pb], axis=1)
    return pd.DataFrame({"lang": cells["lang"].iloc[0], "a": np.repeat(a, b.size), "b": np.tile(b, a.size), "f": sums.ravel()})


def divergence(docs: DataFrame, least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every (lang, source) that occurs.

    Null text, lang and source are ''.  Repeated rows are documents of their own; a
    source without terms has a count of zero for every kept term; a language that keeps no
    term gives its pairs of sources with value 0 and no terms.  Ties go by the UTF-8 order
    of the item, for terms by their place in the transducer.  Columns other than
    text, lang and source are not looked at; an empty table gives no rows.

    1. Documents per term are added up within tasks, then by term.
    2. The kept terms, sorted over all tasks, become transducers of bounded size.
    3. The texts stream through them again and are counted by place.
    4. Sources are compared in blocks of places and sources, so no task holds more
       than a block of either, however large a source or vocabulary is."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    machines = materialise(vocabulary(src.select("lang", "text"), least), "vocabulary")
    counts = counts_by_place(src, machines)
    order = Window.partitionBy("lang").orderBy("source")
    sizes = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    kept = machines.groupBy("lang").agg(F.sum("n").alias("v"))
    groups = (src.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
              .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
                      (F.row_number().over(order) - 1).cast("long").alias("gid")))
    groups = materialise(groups, "groups")

    def share(c: Column, n: Column) -> Column:
        """1 + floor(SCALE * (c + ADDED) / (n + ADDED * v)), exact beyond 64 bits."""
        top = F.lit(SCALE).cast("decimal(10,0)") * (c + ADDED).cast("decimal(20,0)")
        under = (n + ADDED * F.col("v")).cast("decimal(20,0)")
        return F.lit(1) + F.call_function("div", top, under)

    # Every place of a group counts, so the cells of a block are those of the terms that
    # occur and one that says what the share of the others is.
    sb = F.floor(F.col("gid") / SOURCES)
    empty = (groups.where("v > 0").withColumn("z", share(F.lit(0), F.col("n")))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / BLOCK)))))
    placed = counts.join(groups, ["lang", "source"])
    real = placed.select("lang", "v", "gid", F.floor(F.col("ord") / BLOCK).alias("block"), share(F.lit(0), F.col("n")).alias("z"),
                         (F.col("ord") % BLOCK).alias("at"), share(F.col("c"), F.col("n")).alias("p"))
    none = F.lit(None).cast("long")
    cells = real.unionByName(empty.select("lang", "v", "gid", "block", "z", none.alias("at"), none.alias("p")))
    top = groups.groupBy("lang").agg(F.floor(F.max("gid") / SOURCES).alias("top"))
    sided = cells.withColumn("sb", sb).join(top, "lang")
    # Pairs of source blocks (i, j), i <= j: a cell is needed on the left for all j and on the right for all i.
    left = sided.withColumn("j", F.explode(F.sequence("sb", "top"))).withColumn("i", F.col("sb")).withColumn("side", F.lit(0))
    right = sided.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sb")))).withColumn("j", F.col("sb")).withColumn("side", F.lit(1))
    parts = (left.unionByName(right).groupBy("lang", "block", "i", "j")
             .applyInPandas(_distances, "lang string, a long, b long, f long").where("a < b"))
    summed = materialise(parts.groupBy("lang", "a", "b").agg(F.sum("f").alias("f")), "distances")
    both = summed.unionAll(summed.selectExpr("lang", "b", "a", "f"))
    named = groups.select("lang", "source", "gid")
    # A language that keeps no term has its pairs all the same.
    bare = groups.where("v = 0").select("lang", "source", "gid")
    bare = (bare.selectExpr("lang", "gid a").join(bare.selectExpr("lang", "gid b"), "lang").where("a != b")
            .select("lang", "a", "b", F.lit(0).cast("long").alias("f")))
    pairs = (both.unionAll(bare).join(named.selectExpr("lang", "gid a", "source"), ["lang", "a"])
             .join(named.selectExpr("lang", "gid b", "source item"), ["lang", "b"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.col("f").alias("value")))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    whole = counts.groupBy("lang", "ord").agg(F.sum("c").alias("all"))
    totals = groups.groupBy("lang").agg(F.sum("n").alias("total"))
    over = (placed.join(whole, ["lang", "ord"]).join(totals, "lang")
            .withColumn("value", share(F.col("c"), F.col("n")) - share(F.col("all"), F.col("total"))).where("value > 0"))
    by_place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ord")
    first = over.select("lang", "source", "ord", "value", F.row_number().over(by_place).alias("rank")).where(F.col("rank") <= ranks)
    terms = (first.join(dictionary(machines), ["lang", "ord"])
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
    return pairs.unionByName(terms)


#: The same rows in DuckDB's SQL.
SQL = rf"""
    with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') words from documents),
         w as (select id, lang, source, unnest(words) term from d),
         k as (select lang, term from w group by 1, 2 having count(distinct id) >= {LEAST}),
         v as (select lang, count(*) v from k group by 1),
         c as (select lang, source, term, count(*)::hugeint c from w semi join k using (lang, term) group by 1, 2, 3),
         g as (select lang, source, coalesce(n, 0) n, coalesce(v, 0) v from (select distinct lang, source from d)
               left join (select lang, source, sum(c)::hugeint n from c group by 1, 2) using (lang, source) left join v using (lang)),
         p as (select g.lang, g.source, k.term, coalesce(c, 0) c,
                      1 + ({SCALE}::hugeint * (coalesce(c, 0) + {ADDED}))::hugeint // (n + {ADDED} * v)::hugeint p
               from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
         q as (select lang, term, 1 + ({SCALE}::hugeint * (coalesce(sum(c), 0) + {ADDED}))::hugeint // (any_value(t) + {ADDED} * any_value(v))::hugeint q
               from p join (select lang, sum(n) t, any_value(v) v from g group by 1) using (lang) group by 1, 2),
         pair as (select a.lang, a.source, b.source item,
                         coalesce((select sum(abs(x.p - y.p)) from p x join p y using (lang, term)
                                   where x.lang = a.lang and x.source = a.source and y.source = b.source), 0)::bigint as value
                  from g a join g b on a.lang = b.lang and a.source != b.source),
         term as (select lang, source, term item, (p - q)::bigint as value from p join q using (lang, term) where c > 0 and p > q)
    select *, row_number() over (partition by lang, source order by value desc, item)::int rank
    from (select lang, source, 'pair' part, item, value from pair)
    union all
    select * from (select lang, source, 'term' part, item, value,
                          row_number() over (partition by lang, source order by value desc, item)::int rank from term) where rank <= {RANKS}"""
