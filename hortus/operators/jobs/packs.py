"""Pack allocation, checked against what is still to pack.

A request puts ``quantita`` of a species into an existing pack (``pacco``)
or into a new pack named by a request-side handle (``new_pack``, shared by
the lines of one new pack).  The first request of a handle creates the pack;
if it is refused the pack does not exist and the handle's later requests get
45026.  Checks, in the order the order system runs them: new pack for an open
order 45034, for an unknown order 45027; species not in the order 45020;
quantity above ordered minus packed 45015; unknown pack 45026; species
already in the pack ``DUPLICATE``.

The remainder depends on earlier accepted requests of the same order and
species only, so that is what a fold goes through: an order with very many
requests is dealt by its species.  Across species a request depends on nothing
but whether its pack was created.  Creations are first taken as accepted
where nothing set-wise is against them; where a fold finds otherwise, the
(order, species) with later requests for that pack are folded again, until
no creation changes.  Each round decides at least the earliest creation that
was assumed wrongly, and all before it, for good.  Pack numbers come last:
``max + 1, 2, ...`` along the accepted creations of an order, counted over ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hortus.functions import codes
from hortus.functions.checks import first_failing, missing, request_order, with_outcome
from hortus.functions.columns import true_or_false
from hortus.functions.ordered import cluster_by_key, column_values, fold_by_key, rank_in_key
from hortus.operators.jobs.base import JobResult, Tables, unsequenced, with_refused, years_of_orders
from hortus.operators.totals import count
from hortus.session import passing_tables, shuffles_dropped, written

REQUEST_COLS = ("ts", "seq", "ordine", "pacco", "new_pack", "specie_di_pianta", "quantita")
RESULTS = [T.StructField("fold_code", T.StringType())]
#: A batch is cut into slices of about so many requests, and into so many at most.
SLICE_ROWS, MOST_SLICES = 4_000_000, 4
_ORDER_OF = {"orders": "id", "order_lines": "ordine", "packs": "ordine", "pack_contents": "ordine"}
_KEY = ["ordine", "specie_di_pianta"]
_IN = ["ordine", "specie_di_pianta", "pacco", "new_pack", "quantita", "pre_code", "unpacked", "creates", "has_pack", "stored", "content"]


def remainder_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The requests of each (order, species) in order, against what is left to pack and where it lies.

    What lies in the old packs comes first, as rows of its own (``content``), which go no further."""
    line, left, placed, held = None, 0, set(), set()
    for pdf in batches:
        found, lies = [], []
        for o, sp, pacco, handle, q, pre, unpacked, creates, has_pack, stored, content in zip(*[column_values(pdf[c]) for c in _IN]):
            if (o, sp) != line:
                line, left, placed, held = (o, sp), unpacked, set(), set()
            pack, code = (handle, pacco), pre
            if content:
                held.add(pacco)
            stored = stored or handle is None and pacco in held
            if code is None and not content:
                if q > left:
                    code = codes.ABOVE_REMAINDER
                elif not has_pack:
                    code = codes.UNKNOWN_PACK
                elif not creates and (stored or pack in placed):
                    code = codes.DUPLICATE
                if code is None:
                    left -= q
                    placed.add(pack)
            found.append(code)
            lies.append(stored)
        yield pdf.assign(fold_code=found, stored=lies)[~pdf["content"].astype(bool)].drop(columns="content")


def _of_packs(tables: Tables, requests: DataFrame) -> DataFrame:
    """Requests with what is known of their order and their pack, old or to be made."""
    r = requests.select(*REQUEST_COLS)
    o = tables["orders"].select(F.col("id").alias("ordine"), F.col("aperto_or_finalizzato").alias("_status"))
    first = r.filter(F.col("new_pack").isNotNull()).groupBy("ordine", "new_pack").agg(F.min(request_order()).alias("_created"))
    pk = tables["packs"].filter(F.col("numero").isNotNull())
    # One name for both kinds of pack, so that one join looks both up.
    named = first.select(F.col("ordine").alias("_o"), F.col("new_pack").alias("_h"), F.lit(None).cast("int").alias("_p"), "_created",
                         F.lit(False).alias("_exists"))
    known = named.unionByName(pk.select(F.col("ordine").alias("_o"), F.lit(None).cast("string").alias("_h"), F.col("numero").alias("_p"),
                                        F.lit(True).alias("_exists")), allowMissingColumns=True)
    j = (r.join(o, "ordine", "left").withColumn("_pack", F.when(F.col("new_pack").isNull(), F.col("pacco")))
          .join(known, (F.col("ordine") == F.col("_o")) & F.col("new_pack").eqNullSafe(F.col("_h")) & F.col("_pack").eqNullSafe(F.col("_p")), "left"))
    creates = true_or_false(F.col("_created") == request_order())
    pre = first_failing(
        (missing("ordine", "specie_di_pianta", "quantita") | (F.col("quantita") < 0), codes.INVALID),
        (creates & (F.col("_status") == 1), codes.ORDER_OPEN),
        (creates & F.col("_status").isNull(), codes.UNKNOWN_PACK_ORDER))
    in_old = F.col("new_pack").isNull()
    return j.select(*REQUEST_COLS, pre.alias("pre_code"), creates.alias("creates"), (in_old & true_or_false(F.col("_exists"))).alias("_old"),
                    (~in_old & true_or_false(F.col("_status") != 1)).alias("_made"))


def _of_lines(tables: Tables, requests: DataFrame) -> DataFrame:
    """``_of_packs`` with what is known of their lines, and the contents of these, clustered by line."""
    lines = tables["order_lines"].select(*_KEY, F.col("quantita").alias("_ordered"))
    contents = tables["pack_contents"]
    packed = contents.groupBy(*_KEY).agg(F.sum("quantita").alias("_packed"))
    no = F.lit(False)
    # No NULL where none is needed, as a fold would get floats for it.
    lies = contents.select(*_KEY, "pacco", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("quantita"),
                           no.alias("creates"), no.alias("_old"), no.alias("_made"), F.lit(True).alias("content"))
    both = requests.withColumn("content", no).unionByName(lies, allowMissingColumns=True)
    j = cluster_by_key(both, _KEY).join(lines, _KEY, "left").join(packed, _KEY, "left")
    pre = F.coalesce(F.col("pre_code"), F.when(F.col("_ordered").isNull(), F.lit(codes.NOT_IN_ORDER)))
    return j.select(*REQUEST_COLS, pre.alias("pre_code"),
                    (F.col("_ordered") - F.coalesce(F.col("_packed"), F.lit(0))).cast("long").alias("unpacked"), "creates", "_old",
                    no.alias("stored"), "_made", "content")


def _folded(ready: DataFrame, clustered: bool = False) -> DataFrame:
    schema = T.StructType([*(f for f in ready.schema.fields if f.name != "content"), *RESULTS])
    return written(fold_by_key(ready, _KEY, ["ts", "seq"], remainder_fold, schema, clustered))


def _decided(base: DataFrame) -> DataFrame:
    """``base`` (of ``_of_lines``) with ``fold_code``, creations iterated to a fixed point."""
    made, runs, redone, todo = None, [], None, None
    # What a later request of a pack is first taken to meet, it carries itself: no join with the creations.
    done = _folded(base.withColumn("has_pack", F.col("_old") | F.col("creates") | F.col("_made")), clustered=True)
    base = done.drop("_made", "has_pack", "fold_code").withColumn("content", F.lit(False))
    creations = done.filter("creates").select("ordine", "new_pack", "pre_code", F.col("fold_code").isNull().alias("_now"), "_made")
    if written(creations.groupBy("ordine", "new_pack").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")).isEmpty():
        runs.append(done.withColumn("_run", F.lit(0)))
        made = creations.select("ordine", "new_pack", F.col("_now").alias("_made"))
        changed = written(creations.filter(F.col("_now") != F.col("_made")).select("ordine", "new_pack"))
    else:  # orders or lines that repeat: a request then meets each of the creations
        made = written(creations.select("ordine", "new_pack", F.col("pre_code").isNull().alias("_made")))
        changed = None
    named = base.filter(F.col("new_pack").isNotNull() & ~F.col("creates"))
    while changed is None or not changed.isEmpty():
        part = base
        if changed is not None:
            todo = written(named.join(changed, ["ordine", "new_pack"], "left_semi").select(*_KEY).distinct())
            part = base.join(todo, _KEY, "left_semi")
            again = todo.withColumn("_last", F.lit(len(runs)))
            redone = again if redone is None else redone.unionByName(again)
        ready = (part.join(made, ["ordine", "new_pack"], "left")
                 .withColumn("has_pack", F.col("_old") | F.col("creates") | true_or_false(F.col("_made"))))
        done = _folded(ready.select(*base.columns, "has_pack"))
        runs.append(done.withColumn("_run", F.lit(len(runs))))
        now = done.filter("creates").select("ordine", "new_pack", F.col("fold_code").isNull().alias("_now"))
        kept = made.join(now, ["ordine", "new_pack"], "left").withColumn("_now", F.coalesce("_now", "_made"))
        changed = written(kept.filter(F.col("_now") != F.col("_made")).select("ordine", "new_pack"))
        made = written(kept.select("ordine", "new_pack", F.col("_now").alias("_made")))
    every = reduce(DataFrame.unionByName, [run.select(*REQUEST_COLS, "creates", "fold_code", "_run") for run in runs])
    if redone is None:
        return every.drop("_run")
    # Of a line folded again its last run counts.
    last = written(redone.groupBy(*_KEY).agg(F.max("_last").alias("_last")))
    return written(every.join(last, _KEY, "left").filter(F.col("_run") == F.coalesce(F.col("_last"), F.lit(0))).drop("_last", "_run"))


def _allocated(tables: Tables, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The requests with ``fold_code`` and ``pack_number``, and the packs created."""
    decided = _decided(_of_lines(tables, written(_of_packs(tables, requests))))
    ok = decided.filter(F.col("fold_code").isNull())
    top = tables["packs"].groupBy("ordine").agg(F.max("numero").alias("_top"))
    created = rank_in_key(ok.filter("creates").select("ordine", "new_pack", "ts", "seq"), "ordine", ["ts", "seq"], "_nth")
    created = written(created.join(top, "ordine", "left").select(
        "ordine", "new_pack", (F.coalesce(F.col("_top"), F.lit(0)) + F.col("_nth")).cast("int").alias("numero")), lasting=True)
    decided = decided.select(*REQUEST_COLS, "fold_code")
    named = F.col("new_pack").isNotNull()
    numbered = (decided.filter(named).join(created, ["ordine", "new_pack"], "left")
                .unionByName(decided.filter(~named), allowMissingColumns=True))
    decided = numbered.withColumn("pack_number", F.when(F.col("fold_code").isNull(), F.coalesce("numero", "pacco")))
    return written(decided.select(*REQUEST_COLS, "fold_code", "pack_number"), lasting=True), created


def _sliced(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``_slice``: in which of ``n`` slices of the orders a row is, a NULL order in one of them, too."""
    return df.withColumn("_slice", F.pmod(F.xxhash64(F.col(order).cast("long")), F.lit(n)).cast("int"))


def allocate_packs(tables: Tables, requests: DataFrame) -> JobResult:
    """Returns new ``packs`` and ``pack_contents`` and per-request outcomes with the pack number.

    A NULL order, species or quantity, or a negative quantity, is ``INVALID``.
    Orders have nothing to do with one another, so a large batch is done a slice of
    the orders at a time: what lies on disk between the steps is that of one slice."""
    spark = requests.sparkSession
    with passing_tables(spark):
        fit, refused = unsequenced(requests)
        if refused is not None:
            refused = written(refused, lasting=True)
        with shuffles_dropped(spark):
            n = max(1, min(MOST_SLICES, -(-fit.count() // SLICE_ROWS)))
        fit = written(_sliced(fit.select(*REQUEST_COLS), "ordine", n), lasting=True, by="_slice")
    cut = {name: _sliced(tables[name], order, n) for name, order in _ORDER_OF.items()}
    done = []
    for i in range(n):
        with passing_tables(spark):
            part = {name: df.filter(F.col("_slice") == i) if n > 1 else df for name, df in cut.items()}
            done.append(_allocated({name: df.drop("_slice") for name, df in part.items()}, fit.filter(F.col("_slice") == i)))
    decided, created = (reduce(DataFrame.unionByName, frames) for frames in zip(*done))
    ok = decided.filter(F.col("fold_code").isNull())
    packs, contents = tables["packs"], tables["pack_contents"]
    new_contents = contents.unionByName(ok.select("ordine", F.col("pack_number").alias("pacco"), "specie_di_pianta", "quantita"))
    outcomes = with_outcome(decided, F.col("fold_code")).drop("fold_code")
    years = {"packs": years_of_orders(tables["orders"], created), "pack_contents": years_of_orders(tables["orders"], ok)}
    result = JobResult({"packs": packs.unionByName(created.select("ordine", "numero")), "pack_contents": new_contents}, outcomes, years=years,
                       changes={"packed_totals": count(ok, "packed_totals")})
    return with_refused(result, refused)
