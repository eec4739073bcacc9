"""Near duplicates: an inverted join on signature coordinates, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.llm.common import components, gram_hashes, materialise, mix, signed, word_hashes

#: 40 coordinates, 17 of which must agree.  At similarity 0.75 the matches are
#: binomial (mean 30, deviation 2.7): a link is missed about once in 200,000.
COORDINATES, MATCHES, WORDS, PERCENT = 40, 17, 5, 75
#: Finer signatures of the classes that pass the first: 205 of 320 (mean 240, deviation 7.7).
FINE, FINE_MATCHES = 320, 205
#: Shingles held by so many classes or fewer are rare: pairs that share one are looked up by it.
RARE = 8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of hashed word runs of the whole text."""
    return np.unique(gram_hashes(word_hashes(text)[0], words))


def signature(h: np.ndarray, coordinates: int) -> np.ndarray:
    """For each coordinate the smallest value of a random permutation over the set."""
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = seeds[:coordinates] | np.uint64(1), seeds[coordinates:]
    out = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, h.size, 1024):
        np.minimum(out, (h[i:i + 1024, None] * a + b).min(axis=0), out=out)
    return out


def _signatures(coordinates: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, k1, k2, sigs = [], [], [], []
            for text in batch["text"]:
                h = shingles(text, words)
                n.append(h.size)
                k1.append(mix(h + np.uint64(1)).sum(dtype=np.uint64))
                k2.append(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                sigs.append(signed(signature(h, coordinates)))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "k1": signed(k1), "k2": signed(k2), "sig": sigs})
    return run


def _sets(words: int, coordinates: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.iloc[i:i + 256]
                sets = [shingles(t, words) for t in part["text"]]
                yield pd.DataFrame({"id": part["doc_id"], "n": [h.size for h in sets], "h": [signed(h) for h in sets],
                                    "sig": [signed(signature(h, coordinates)) for h in sets]})
    return run


def shared_values(signatures: DataFrame, matches: int) -> DataFrame:
    """(id, n, t): the coordinate-value pairs held by two ids or more, rarest first,
    of the ids with at least ``matches`` of them."""
    tokens = materialise(signatures.select("id", "n", F.posexplode("sig").alias("pos", "val"))
                         .select("id", "n", F.xxhash64("pos", "val").alias("tok")), "tokens")
    shared = materialise(tokens.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    return (tokens.join(shared, "tok").groupBy("id", "n")
            .agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t")).where(F.size("t") >= matches))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES,
                    fine: int = FINE, fine_matches: int = FINE_MATCHES, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A text without words (or null) has an empty set and links with nothing; a
    null id links with nothing and is kept.  Repeated rows of one id get the
    same answer.  An empty table gives no rows.

    1. Rows with equal sets form a class; only classes are compared.
    2. A class that shares fewer than ``matches`` coordinate-value pairs with
       all others has no link.  The rest gets ``fine`` coordinates, and each
       class is posted under its coordinate-value pairs, rarest first.  Two
       classes agreeing in ``fine_matches`` coordinates must meet among the
       first (shared values - fine_matches + 1) of either, so only that prefix is
       posted; values held by one class are never posted, nor is a class
       with too many shingles that no other class holds.
    3. In each posting list every class is first tested against the list's
       leader only, the class whose values are held by most others.  Classes linked
       by that need no further test among themselves; what stays in different
       components is then tested across components, so a large group of copies
       costs a star, not all pairs, and no link between different components is lost.
    4. Across components a pair either shares a rare shingle, one of at most ``rare``
       classes, and is looked up by it, or shares frequent ones only.  These are bounded
       by the frequent parts of their intersections with the leader: what two members share
       lies inside the leader or beside it, and neither part is larger than the
       smaller of theirs.  Components, then a class and a component, then two classes are
       dropped where that bound is too low, once for each leader, in however many
       lists they meet.
    5. Pairs with enough agreeing coordinates are confirmed on their full sets."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialise(src.mapInPandas(_signatures(coordinates, words),
                                       "doc_id long, n long, k1 long, k2 long, sig array<long>"), "sets")
    classes = materialise(sets.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n")
                          .agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    able = materialise(shared_values(classes, matches).select(F.col("id").alias("doc_id")), "able")
    full = materialise(src.join(able, "doc_id", "left_semi").dropDuplicates(["doc_id"])
                       .mapInPandas(_sets(words, fine), "id long, n long, h array<long>, sig array<long>"), "full")
    prefix = F.expr(f"slice(t, 1, size(t) - {fine_matches} + 1).tok")
    weight = F.expr("aggregate(t, 0L, (a, x) -> a + x.df)")
    held = materialise(shared_values(full, fine_matches).select("id", "n", weight.alias("w"), prefix.alias("toks")), "held")
    # Shingles that one class alone holds are in no intersection, whatever the partner.
    grams = full.join(held, "id", "left_semi").select("id", F.explode("h").alias("g"))
    counts = materialise(grams.groupBy("g").agg(F.count("*").alias("c")).where("c > 1"), "counts")
    sizes = materialise(grams.join(counts, "g").groupBy("id").agg(
        F.count("*").alias("s"), F.collect_list(F.when(F.col("c") > rare, F.col("g"))).alias("hot"),
        F.array_sort(F.collect_list(F.when(F.col("c") <= rare, F.struct("c", "g")))).alias("few")), "sizes")
    postings = materialise(held.join(sizes.select("id", "s"), "id").where(f"100 * s >= {percent} * n")
                           .select("id", "n", "s", "w", F.explode("toks").alias("tok")), "postings")
    leaders = materialise(postings.groupBy("tok").agg(F.max_by(F.struct("id", "n", "s"), F.struct("w", -F.col("id"))).alias("l"), F.count("*").alias("c"))
                          .where("c > 1").selectExpr("tok", "l.id a", "l.n na", "l.s sa"), "leaders")

    def fits(x: str, y: str) -> str:
        """No intersection is larger than the smaller number of shingles that any other class holds, nor than the
        smaller parts of these that lie inside (i) and beside (e) the leader's set."""
        most = f"least(s{x}, s{y}, least(i{x}, i{y}) + least(e{x}, e{y}))"
        return f"100 * {most} >= {percent} * (n{x} + n{y} - {most})"

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """``pairs`` with the size i of the intersection of their full sets."""
        return materialise(pairs.join(full.selectExpr("id a", "n na", "h ha"), "a").join(full.selectExpr("id b", "n nb", "h hb"), "b")
                           .select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("i")), name)

    linked = f"100 * i >= {percent} * (na + nb - i)"
    most = "least(s, sa)"
    stars = materialise(postings.join(leaders, "tok").where(f"a != id and 100 * {most} >= {percent} * (n + na - {most})")
                        .selectExpr("a", "id b").distinct(), "stars")
    known = confirmed(stars, "known")
    links = known.where(linked).select("a", "b")
    found = components(links)
    component = F.coalesce("component", "id").alias("c")
    # What stays apart in a posting list, by component: members of a leader, (tok, component) rows.
    placed = materialise(postings.join(leaders.select("tok", "a"), "tok").join(found, "id", "left")
                         .select("tok", "a", component, "id", "n"), "placed")
    mixed = placed.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("tok")
    placed = materialise(placed.join(mixed, "tok", "left_semi"), "mixed")
    inside = F.size(F.array_intersect("hota", "hot")).cast("long")
    members = materialise(placed.select("a", "c", "id", "n").distinct().join(sizes.select("id", "hot"), "id")
                          .join(sizes.selectExpr("id a", "hot hota"), "a")
                          .select("a", "c", "id", "n", F.size("hot").cast("long").alias("s"), inside.alias("i"))
                          .withColumn("e", F.expr("s - i")), "members")
    bounds = [F.min("n").alias("n"), *[F.max(x).alias(x) for x in "sie"]]
    parts = materialise(placed.select("tok", "a", "id").join(members, ["a", "id"]).groupBy("tok", "a", "c").agg(*bounds), "parts")

    def side(df: DataFrame, x: str, *keys: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(c + x) for c in df.columns if c not in keys])

    apart = materialise(side(parts, "1", "tok", "a").join(side(parts.drop("a"), "2", "tok"), "tok")
                        .where("c1 < c2 and " + fits("1", "2")).selectExpr("a", "c1 cx", "c2 cy").distinct(), "apart")
    whole = members.groupBy("a", "c").agg(*bounds).withColumnRenamed("c", "cy")
    rest = (apart.join(side(whole, "2", "a", "cy"), ["a", "cy"])
            .join(side(members, "x", "a"), ["a", "cx"]).where(fits("x", "2"))
            .join(side(members, "y", "a"), ["a", "cy"]).where(fits("x", "y"))
            .select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")))
    # A pair shares percent of the shingles of either; what the frequent ones leave of that are rare ones, so it
    # meets in a prefix of these.
    least = f"greatest(ceil({percent} * n / 100) - size(hot), 1)"
    few = materialise(held.select("id", "n").join(sizes.where("size(few) > 0"), "id").where(f"100 * s >= {percent} * n")
                      .withColumn("left", F.expr(f"size(few) - {least} + 1").cast("int")).where("left > 0")
                      .select("id", "n", F.expr("explode(slice(few, 1, left).g)").alias("g"))
                      .join(found, "id", "left").select("g", "id", "n", component), "few")
    mixed = few.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g")
    few = materialise(few.join(mixed, "g", "left_semi"), "mixed")
    near = (side(few, "1", "g").join(side(few, "2", "g"), "g")
            .where(f"id1 < id2 and c1 != c2 and 100 * least(n1, n2) >= {percent} * greatest(n1, n2)").selectExpr("id1 a", "id2 b"))
    rest = rest.unionAll(near).distinct()
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    likely = materialise(rest.join(tested, ["a", "b"], "left_anti")
                         .join(full.selectExpr("id a", "sig sa"), "a").join(full.selectExpr("id b", "sig sb"), "b")
                         .where(agree >= fine_matches).select("a", "b"), "likely")
    more = confirmed(likely, "more").where(linked).select("a", "b")
    found = components(found.selectExpr("id a", "component b").unionAll(more))
    groups = materialise(classes.select("k1", "k2", "n", "id").join(found, "id", "left")
                         .select("k1", "k2", "n", F.coalesce("component", "id").alias("component")), "groups")
    out = sets.select("doc_id", "n", "k1", "k2").join(groups, ["k1", "k2", "n"], "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                      F.col("doc_id").eqNullSafe(own).alias("kept"))
