"""C22 on live state: orders, lines, finalizations and restocks as one stream in event time.

Two stateful operators, both of which hold events back until the watermark has
passed them and then apply them in (time, sequence) order, so an event that
comes late, but not later than ``delay``, takes its place:

* ``OrderGate``, by order: owner and status, seeded once from the orders of the
  snapshot, changed by NEW_ORDER and FINALIZE events.  It decides what depends on
  the order alone and hands the line events on.
* ``StockGate``, by species: the stock, seeded once from the snapshot and changed
  by line events and RESTOCK, and the lines touched so far.

A finalized order is remembered for ``keep`` and then forgotten, by a timer: its
owner and status in the one operator, its lines in the others.  What comes for
it later is refused as for an unknown order (45005).  State lives in the RocksDB state
store and is recovered from the checkpoint after a failure.

Of the events of one order, or of one species, that share time and sequence all
but one are ``DUPLICATE``; an event without sequence, order, customer or species is ``INVALID``,
one without time comes to no watermark and is left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hortus.functions import codes
from hortus.functions.ordered import column_values
from hortus.operators.jobs.orders import OPS, ledger_step
from hortus.streaming.order_lines import ROCKSDB

NEW_ORDER, FINALIZE, RESTOCK, TICK, FORGET = "NEW_ORDER", "FINALIZE", "RESTOCK", "TICK", "FORGET"
EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("cliente", T.StringType()), T.StructField("ordine", T.IntegerType()),
    T.StructField("specie_di_pianta", T.IntegerType()), T.StructField("quantita", T.IntegerType()),
])
_FIELDS = EVENT_SCHEMA.fieldNames()
#: Between the operators: the key of the second one, the line at the snapshot, and what the order says.
GATED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("q0", T.IntegerType()), T.StructField("chiave", T.LongType()),
                             T.StructField("pre_code", T.StringType()), T.StructField("is_final", T.BooleanType())])
OUTPUT_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("code", T.StringType()), T.StructField("esito", T.StringType()),
                              T.StructField("stock_after", T.IntegerType())])
_HELD = "ms long, seq long, op string, cliente string, ordine int, specie int, quantita int, q0 int, pre_code string, is_final boolean"


def _ms(t: pd.Series) -> list[int]:
    return (t.astype("datetime64[ms, UTC]").astype("int64") if t.dt.tz is not None else t.astype("datetime64[ms]").astype("int64")).tolist()


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms", tz="UTC")


class _InOrder(StatefulProcessor):
    """Holds events until the watermark has passed them; ``apply`` then gets them in order."""

    def hold(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _HELD)
        self.alarm = handle.getValueState("alarm", "ms long")

    def wake(self, ms: int) -> None:
        """A timer at the earliest event that waits (or memory that ends)."""
        if self.alarm.exists():
            if self.alarm.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.alarm.get()[0])
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if not len(pdf):
                continue
            have = pdf.columns
            ms = _ms(pdf["ts"])
            cols = [column_values(pdf[c]) if c in have else [None] * len(pdf)
                    for c in ("seq", "op", "cliente", "ordine", "specie_di_pianta", "quantita", "q0", "pre_code", "is_final")]
            self.waiting.appendList([tuple(r) for r in zip(ms, *cols)])
            first = min([*ms, *([] if first is None else [first])])
        if first is not None:
            self.wake(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        self.alarm.clear()
        held = sorted(self.waiting.get(), key=lambda r: tuple((v is not None, v) for v in r))
        ready = [r for r in held if r[0] <= until]
        rest = held[len(ready):]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        # Of the events that share time and sequence here, the least has its place in the order.
        again = {id(r) for r, last in zip(ready[1:], ready) if r[:2] == last[:2] and FORGET not in (r[2], last[2])}
        out = self.apply(int(key[0]), ready, until, again)
        later = [r[0] for r in rest[:1]] + self.ends()
        if later:
            self.wake(min(later))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class OrderGate(_InOrder):
    columns = GATED_SCHEMA.fieldNames()

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hold(handle)
        self.order = handle.getValueState("order", "cliente string, finale boolean, fine long")
        self.touched = handle.getMapState("touched", "specie int", "n int")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.order.update((str(initialState["_owner"].iloc[0]), bool(initialState["_final"].iloc[0]), None))

    def ends(self) -> list[int]:
        """When a finalized order is to be forgotten."""
        return [self.order.get()[2]] if self.order.exists() and self.order.get()[2] is not None else []

    def apply(self, order: int, ready: list, until: int, again: set) -> list[tuple]:
        out = []

        def forgotten(ms: int) -> None:
            """Ends the memory of the order if that is due by then."""
            ends = self.ends()
            if ends and ends[0] <= ms:
                out.extend((_time(ends[0]), 0, FORGET, None, order, k[0], None, None, k[0], None, None) for k in self.touched.keys())
                self.order.clear()
                self.touched.clear()

        for event in ready:
            ms, seq, op, cliente, _, sp, q, q0, _, _ = event
            forgotten(ms - 1)
            owner, final, end = self.order.get() if self.order.exists() else (None, False, None)
            mine, code = owner is not None and owner == cliente, None
            if seq is None or order < 0 or cliente is None or op not in (NEW_ORDER, FINALIZE, *OPS) or (op in OPS and sp is None):
                code = codes.INVALID
            elif id(event) in again:
                code = codes.DUPLICATE
            elif op == NEW_ORDER:
                code = codes.DUPLICATE if owner is not None else None
                if code is None:
                    self.order.update((cliente, False, None))
            elif not mine:
                code = codes.NOT_OWNER
            elif op == FINALIZE:
                if end is None:
                    self.order.update((owner, True, ms + self.keep_ms))
            elif op != "REMOVE" and (q is None or q < 0):
                code = codes.INVALID
            else:
                self.touched.updateValue((sp,), (1,))
            # What is about an order, or no species, is passed through under a key of the order's own.
            key = -2 - order if op not in OPS or sp is None else sp
            out.append((_time(ms), seq, op, cliente, None if order < 0 else order, sp, q, q0, key, code, bool(final)))
        forgotten(until)
        return out


class StockGate(_InOrder):
    columns = OUTPUT_SCHEMA.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hold(handle)
        self.stock = handle.getValueState("stock", "stock int")
        self.lines = handle.getMapState("lines", "ordine int", "quantita int")  # -1: removed

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.stock.update((int(initialState["_stock"].iloc[0]),))

    def ends(self) -> list[int]:
        return []

    def apply(self, species: int, ready: list, until: int, again: set) -> list[tuple]:
        out, stock = [], self.stock.get()[0] if self.stock.exists() else None
        for event in ready:
            ms, seq, op, cliente, ordine, sp, q, q0, pre, final = event
            if op == FORGET:
                if self.lines.containsKey((ordine,)):
                    self.lines.removeKey((ordine,))
                continue
            code, noop = pre, False
            if id(event) in again and pre is None:
                code = codes.DUPLICATE
            elif op == RESTOCK:
                code = codes.UNKNOWN_SPECIES if stock is None else codes.INVALID if q is None or q < 0 else None
                stock = stock if code else stock + q
            elif op in OPS and pre is None:
                cur = q0
                if self.lines.containsKey((ordine,)):
                    held = self.lines.getValue((ordine,))[0]
                    cur = None if held < 0 else held
                code, noop, moved, left, _ = ledger_step(op, q, cur, stock, bool(final), None)
                if code is None and not noop:
                    stock -= moved
                    self.lines.updateValue((ordine,), (-1 if left is None else int(left),))
            esito = codes.REJECTED if code else codes.NOOP if noop else codes.ACCEPTED
            out.append((_time(ms), seq, op, cliente, ordine, sp, q, code, esito, stock))
        if stock is not None:
            self.stock.update((int(stock),))
        return out


def live_ledger(events: DataFrame, tables: Mapping[str, DataFrame], delay: str = "1 hour",
                keep: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """The streaming query (not started) over ``events`` (``EVENT_SCHEMA``): a row for each event but TICK.

    Orders, order lines and species of ``tables`` are the state at the start, read
    once.  TICK events carry nothing but time: they let a quiet stream's watermark pass."""
    ev = events.withWatermark("ts", delay)
    lines = tables["order_lines"].select("ordine", "specie_di_pianta", F.col("quantita").alias("q0"))
    by_order = ev.filter(~F.col("op").eqNullSafe(RESTOCK)).join(lines, ["ordine", "specie_di_pianta"], "left").select(*_FIELDS, "q0")
    by_order = by_order.withColumn("ordine", F.coalesce("ordine", F.lit(-1)))
    owners = tables["orders"].select(F.col("id").alias("ordine"), F.col("cliente").alias("_owner"),
                                     (F.col("aperto_or_finalizzato") == 0).alias("_final"))
    gated = by_order.groupBy("ordine").transformWithStateInPandas(
        OrderGate(int(keep.total_seconds() * 1000)), GATED_SCHEMA, "Append", "EventTime",
        initialState=owners.groupBy("ordine"), eventTimeColumnName="ts")
    none = F.lit(None)
    restocks = ev.filter(F.col("op") == RESTOCK).select(
        *_FIELDS, none.cast("int").alias("q0"), F.col("specie_di_pianta").cast("long").alias("chiave"),
        none.cast("string").alias("pre_code"), F.lit(False).alias("is_final"))
    stock = tables["species"].select(F.col("codice").cast("long").alias("chiave"), F.col("giacenza").alias("_stock"))
    out = gated.unionByName(restocks).groupBy("chiave").transformWithStateInPandas(
        StockGate(), OUTPUT_SCHEMA, "Append", "EventTime", initialState=stock.groupBy("chiave"))
    return out.filter(~F.col("op").eqNullSafe(TICK))


def run_live(spark: SparkSession, tables: Mapping[str, DataFrame], source_dir: str, sink_dir: str, checkpoint: str, **options) -> DataFrame:
    """Processes all events that lie in ``source_dir`` now; returns what the sink holds so far."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(source_dir)
    q = (live_ledger(events, tables, **options).writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(sink_dir)
