"""Price changes on the time-versioned price list (SCD type 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hortus.functions import codes
from hortus.functions.asof import quarter
from hortus.functions.checks import first_failing, missing, with_outcome
from hortus.functions.ordered import neighbour
from hortus.operators.jobs.base import JobResult, Tables, in_sequence
from hortus.session import written
from hortus.sources.schemas import PRICE

REQUEST_COLS = ("ts", "seq", "specie_di_pianta", "valore")


@in_sequence
def apply_price_changes(tables: Tables, changes: DataFrame) -> JobResult:
    """Apply ``changes`` (ts, seq, specie_di_pianta, valore) in time order.

    A change equal to the price in force is a no-op; otherwise the open price
    is closed at ``ts`` and a new open price starts.  Codes: unknown species
    45014; a change not after the open price's start ``OUT_OF_ORDER``; a
    negative or missing price ``INVALID``.  Two changes of one species in the
    same second: the later sequence number wins, the other is a no-op.

    Only the open price of each species in the batch takes part: the closed
    history is carried over untouched, without a shuffle.  The previous and
    next price of a change come from windows over (species, quarter), stitched
    at the quarters' edges (``functions/ordered.neighbour``): one path for
    all species, and one with a third of the changes spans many tasks.
    """
    prices = tables["prices"]
    req = changes.select(*REQUEST_COLS).withColumn("valore", F.col("valore").cast(PRICE))
    open_ = prices.filter(F.col("data_termine").isNull()).select(
        "specie_di_pianta", F.col("data_adozione").alias("_open_since"), F.col("valore").alias("_open_value"))
    j = req.join(open_, "specie_di_pianta", "left")
    code = first_failing(
        (F.col("_open_since").isNull(), codes.UNKNOWN_SPECIES),
        (missing("valore") | (F.col("valore") < 0), codes.INVALID),
        (F.col("ts") <= F.col("_open_since"), codes.OUT_OF_ORDER),
    )
    # Checked once and written: the dedup, the chain and the outcomes all read it.
    checked = written(j.withColumn("_code", code))
    valid = checked.filter(F.col("_code").isNull())
    # Same species, same second: only the latest sequence number stays.
    latest = valid.groupBy("specie_di_pianta", "ts").agg(F.max("seq").alias("_last_seq"))
    valid = valid.join(latest, ["specie_di_pianta", "ts"]).withColumn("_superseded", F.col("seq") != F.col("_last_seq"))
    live = valid.filter(~F.col("_superseded"))
    # Chain per species: the open price, then the surviving changes in time order.
    opened = open_.join(live.select("specie_di_pianta").distinct(), "specie_di_pianta", "left_semi").select(
        "specie_di_pianta", F.col("_open_since").alias("ts"), F.lit(-1).cast("long").alias("seq"),
        F.col("_open_value").alias("valore"), F.lit(True).alias("_is_open"))
    chain = opened.unionByName(live.select("specie_di_pianta", "ts", F.col("seq").cast("long"), "valore",
                                           F.lit(False).alias("_is_open")))
    chain = neighbour(chain.withColumn("_quarter", quarter(F.col("ts"))), "specie_di_pianta", "_quarter", ["ts", "seq"], ["valore"])
    # The open price always stays; a change stays when it differs from the price before it.
    differs = F.col("_is_open") | ~F.coalesce(F.col("valore") == F.col("prev_valore"), F.lit(False))
    chain = written(chain.withColumn("_effective", differs))
    kept = neighbour(chain.filter(F.col("_effective")), "specie_di_pianta", "_quarter", ["ts", "seq"], ["ts"], "next")
    rewritten = kept.select("specie_di_pianta", F.col("ts").alias("data_adozione"), "valore",
                            F.col("next_ts").alias("data_termine"))
    touched = kept.select("specie_di_pianta").distinct()
    new_prices = (prices.filter(F.col("data_termine").isNotNull())
                  .unionByName(prices.filter(F.col("data_termine").isNull()).join(touched, "specie_di_pianta", "left_anti"))
                  .unionByName(rewritten))
    effective = chain.filter(~F.col("_is_open")).select(
        F.col("specie_di_pianta").alias("_sp"), F.col("ts").alias("_ts"), F.col("seq").alias("_s"), "_effective")
    out = (checked.join(effective, (F.col("specie_di_pianta") == F.col("_sp")) & (F.col("ts") == F.col("_ts"))
                        & (F.col("seq") == F.col("_s")), "left")
                  .drop("_sp", "_ts", "_s"))
    outcomes = with_outcome(out.select(*REQUEST_COLS, "_code", "_effective"), F.col("_code"),
                            noop=~F.coalesce(F.col("_effective"), F.lit(False))).drop("_code", "_effective")
    return JobResult({"prices": new_prices}, outcomes)
