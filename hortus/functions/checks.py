"""Set-wise request checks: ordered reject codes, outcomes, in-batch duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.columns import true_or_false

ORDER_COLS = ("ts", "seq")


def request_order() -> Column:
    """The order requests are applied in: time, then sequence number."""
    return F.struct(*[F.col(c) for c in ORDER_COLS])


def first_failing(*checks: tuple[Column, str]) -> Column:
    """Code of the first check whose condition holds (NULL counts as not failing).

    The checks are listed in the order the order system runs them; the first
    failing one decides the code, as a procedure stops at its first error.
    """
    expr = F.lit(None).cast("string")
    for failed, code in reversed(checks):
        expr = F.when(true_or_false(failed), F.lit(code)).otherwise(expr)
    return expr


def reason_of(code: Column) -> Column:
    mapping = F.create_map(*[x for k, v in codes.REASONS.items() for x in (F.lit(k), F.lit(v))])
    return mapping[code]


def with_outcome(df: DataFrame, code: Column, noop: Column | None = None) -> DataFrame:
    """Adds ``code``, ``reason`` and ``esito`` (accepted / noop / rejected)."""
    df = df.withColumn("code", code)
    esito = F.when(F.col("code").isNotNull(), F.lit(codes.REJECTED))
    if noop is not None:
        esito = esito.when(true_or_false(noop), F.lit(codes.NOOP))
    return (df.withColumn("esito", esito.otherwise(F.lit(codes.ACCEPTED)))
              .withColumn("reason", reason_of(F.col("code"))))


def exists_in(df: DataFrame, table: DataFrame, on: Sequence[tuple[str, str]], flag: str) -> DataFrame:
    """Adds boolean ``flag``: a row of ``table`` matches on the (request col, table col) pairs.

    The table is first cut to the keys the batch asks about (a left-semi join
    with the batch's distinct keys, which AQE broadcasts when they are small),
    so a large table is scanned but never shuffled or de-duplicated whole.  The
    flag never multiplies request rows.
    """
    names = [f"_k{i}" for i in range(len(on))]
    asked = df.select(*[F.col(r).alias(n) for (r, _), n in zip(on, names)]).distinct()
    held = table.select(*[F.col(t).alias(n) for (_, t), n in zip(on, names)])
    hits = held.join(asked, names, "left_semi").distinct().withColumn(flag, F.lit(True))
    cond = None
    for (r, _), n in zip(on, names):
        c = df[r] == hits[n]
        cond = c if cond is None else cond & c
    j = df.join(hits, cond, "left")
    return j.drop(*names).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def one_per_time(df: DataFrame, flag: str, times: DataFrame | None = None) -> DataFrame:
    """Adds boolean ``flag``: true for all but one of the requests that share (ts, seq).

    ``times``, where known, are the (ts, seq) that more than one request has.  The least request by its
    columns stays, whatever becomes of it; of equal copies of it, one.  Copies are
    counted, not ordered in a window, so any number of them may share one time.  Only
    requests of shared times are moved; where these are few the others are not shuffled."""
    from hortus.session import written

    cols = df.columns
    whole = F.struct(*[F.col(c) for c in cols])
    if times is None:
        times = (df.filter(F.col("ts").isNotNull() & F.col("seq").isNotNull())
                 .groupBy("ts", "seq").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("ts", "seq"))
    shared = written(df.join(times, ["ts", "seq"]).groupBy("ts", "seq").agg(F.min(whole).alias("_one")))
    alone = df.join(shared, ["ts", "seq"], "left_anti").withColumn(flag, F.lit(False))
    copies = (df.join(shared, ["ts", "seq"]).groupBy(*cols, "_one").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))))
    return alone.unionByName(copies.select(*cols, ((whole != F.col("_one")) | (F.col("_i") > 1)).alias(flag)))


def first_in_batch(df: DataFrame, key: Sequence[str], eligible: Column, flag: str) -> DataFrame:
    """Adds boolean ``flag``: an eligible request on the same key comes earlier in the batch.

    This is how the second insert of one key in a batch meets the key the first
    one wrote.  Done as an aggregate per key joined back (partial aggregation
    before the shuffle; a hot key is split by AQE in the join), not as a window
    that would hold a hot key's rows in one task.
    """
    first = (df.filter(eligible).groupBy(*key).agg(F.min(request_order()).alias("_first")))
    j = df.join(first, list(key), "left")
    return j.withColumn(flag, true_or_false(request_order() > F.col("_first"))).drop("_first")


#: Of the undecided requests a round must decide one in so many, else the rest goes by components.
ROUND_SHARE = 4


def earliest_unique(df: DataFrame, key_sets: Sequence[Sequence[str]], eligible: Column, flag: str) -> DataFrame:
    """Adds boolean ``flag``: an earlier accepted request already holds one of this
    request's unique keys (so the insert would hit a duplicate key).

    Requests are accepted greedily in request order: a request is accepted when
    it is ``eligible`` and no earlier accepted request shares any key of
    ``key_sets``.  With one key this is one aggregate.  With several keys a
    request can depend on a chain of earlier ones.  Set-wise rounds decide
    every request that is the earliest undecided one in all of its key groups and
    refuse those with an earlier accepted one in a group; a key that very many
    requests ask for is done after two.  As soon as a round decides too few, which is
    what long chains do, the rest is cut into the components of its conflicts
    (O(log n) rounds) and each is walked in order.
    """
    if len(key_sets) == 1:
        return first_in_batch(df, key_sets[0], eligible, flag)
    from hortus.session import written
    keys = list(dict.fromkeys(c for ks in key_sets for c in ks))
    base = written(df.withColumn("_open", true_or_false(eligible)).withColumn("_rid", F.monotonically_increasing_id()))
    open_ = base.filter("_open").select("_rid", *keys, "ts", "seq")
    accepted, left = open_.limit(0), None
    while True:
        s = open_
        for i, ks in enumerate(key_sets):
            s = s.join(open_.groupBy(*ks).agg(F.min(request_order()).alias(f"_first{i}")), list(ks), "left")
        # A key with a NULL in it is in no group and meets nothing.
        leads = [F.coalesce(F.col(f"_first{i}") == request_order(), F.lit(True)) for i, _ in enumerate(key_sets)]
        first = leads[0]
        for x in leads[1:]:
            first = first & x
        won = written(s.filter(first).select(*open_.columns))
        accepted = accepted.unionByName(won)
        rest = open_.join(won.select("_rid"), "_rid", "left_anti")
        for ks in key_sets:  # whoever shares a key with a winner comes after it
            rest = rest.join(won.select(*ks).distinct(), list(ks), "left_anti")
        open_, before = written(rest.select(*open_.columns)), left
        left = open_.count()
        if not left:
            break
        if before is not None and before - left < before // ROUND_SHARE:
            accepted = accepted.unionByName(_walk_components(open_, key_sets))
            break
    # Every request (eligible or not) is flagged when an accepted request
    # earlier in the batch holds one of its keys, as ``first_in_batch`` does.
    accepted = written(accepted)
    flags, held = base.select("_rid", *keys, "ts", "seq"), F.lit(False)
    for i, ks in enumerate(key_sets):
        first = accepted.groupBy(*ks).agg(F.min(request_order()).alias(f"_fa{i}"))
        flags = flags.join(first, list(ks), "left")
        held = held | true_or_false(F.col(f"_fa{i}") < request_order())
    flags = flags.select("_rid", held.alias(flag))
    return base.join(flags, "_rid", "inner").drop("_rid", "_open")


def _walk_components(open_: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """The accepted of ``open_``, by one walk in request order through each component of its conflicts."""
    from hortus.functions.graph import components
    from hortus.functions.ordered import fold_by_key

    edges = None
    for ks in key_sets:  # a star for each key: all that share it are connected through its first request
        least = open_.groupBy(*ks).agg(F.min("_rid").alias("_to"))
        star = open_.join(least, list(ks)).select(F.col("_rid").alias("a"), F.col("_to").alias("b"))
        edges = star if edges is None else edges.unionAll(star)
    found, _ = components(edges)
    placed = open_.join(found.withColumnRenamed("id", "_rid"), "_rid", "left").withColumn("_comp", F.coalesce("component", "_rid")).drop("component")

    def walk(batches):
        comp, taken = None, []
        for pdf in batches:
            rows = [list(zip(*[pdf[c].tolist() for c in ks])) for ks in key_sets]
            keep = []
            for c, *own in zip(pdf["_comp"].tolist(), *rows):
                if c != comp:
                    comp, taken = c, [set() for _ in key_sets]
                free = all(k not in t for k, t in zip(own, taken))
                keep.append(free)
                if free:
                    for k, t in zip(own, taken):
                        if not any(v is None or v != v for v in k):
                            t.add(k)
            yield pdf[keep]

    return fold_by_key(placed, ["_comp"], ["ts", "seq"], walk, placed.schema).drop("_comp")


def missing(*cols: str) -> Column:
    """True when a required request column is NULL (never NULL itself).

    A Parquet read does not enforce ``nullable=False``, and a NULL makes most
    check conditions NULL, which ``first_failing`` reads as passed; so every
    chain of checks tests its required columns by name, first of all.
    """
    cond = F.lit(False)
    for c in ("ts", "seq", *cols):
        cond = cond | F.col(c).isNull()
    return cond


def too_long(*pairs: tuple[str, str, str]) -> Column:
    """True when a request value is longer than the column it is stored in.

    ``pairs`` are (request column, table, table column); the widths are the
    order system's (``schemas.MAX_LENGTH``).  DataFrames do not enforce them.
    """
    from hortus.sources.schemas import MAX_LENGTH

    cond = F.lit(False)
    for col, table, tcol in pairs:
        cond = cond | true_or_false(F.length(F.col(col)) > F.lit(MAX_LENGTH[(table, tcol)]))
    return cond
