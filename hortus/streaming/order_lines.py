"""The order-line ledger on an unbounded stream of line events.

``readStream`` of line events -> stream-static joins for the order owner and
status, the line at the snapshot and the species stock -> keyed by groups of species,
``transformWithStateInPandas`` keeps each species' stock and the lines touched so far
(``MapState``, the lines in blocks: order -> quantity, -1 for a removed line).  Within
a species and micro-batch the events are applied in (time, sequence) order; across
micro-batches arrival order decides.  The rules are ``ledger_step``, the same
function the batch job folds with.  State lives in the RocksDB state store and
is recovered from the checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hortus.functions import codes
from hortus.functions.checks import first_failing, missing
from hortus.functions.columns import true_or_false
from hortus.functions.ordered import column_values
from hortus.operators.jobs.orders import LINE_CHANGE_COLS, OPS, ledger_step

EVENT_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), T.StructField("seq", T.LongType()),
    T.StructField("op", T.StringType()), T.StructField("cliente", T.StringType()),
    T.StructField("ordine", T.IntegerType()), T.StructField("specie_di_pianta", T.IntegerType()),
    T.StructField("quantita", T.IntegerType()),
])

OUTPUT_SCHEMA = T.StructType([
    *EVENT_SCHEMA.fields,
    T.StructField("code", T.StringType()), T.StructField("esito", T.StringType()),
    T.StructField("stock_after", T.IntegerType()),
])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REMOVED = -1
#: Species are dealt to so many groups, each one key of the state; fixed, as the state is kept by group.
GROUPS = 4096
#: About so many lines of a species are kept in one value of the state.
BLOCK_LINES = 1024
_EVENT_COLS = [f.name for f in EVENT_SCHEMA.fields]
_STEP_COLS = ["specie_di_pianta", "ordine", "op", "quantita", "pre_code", "is_final", "q0", "stock0"]


def block_of(ordine: int, blocks: int) -> int:
    """The block of an order's line, of ``blocks``; with twice as many, block b is dealt to 2b and 2b + 1."""
    return (ordine * 2654435761 & 0xFFFFFFFF) * blocks >> 32


class SpeciesLedger:
    """One species in one micro-batch: its stock, and the blocks of lines that the batch meets."""

    def __init__(self, specie: int | None, stock0: int | None, ledgers, blocks):
        self.specie, self.store, self.blocks = specie, ledgers, blocks
        self.known = None if specie is None else ledgers.getValue((specie,))
        self.stock, self.count, self.n = (stock0, 0, 1) if self.known is None else self.known
        self.held, self.written = {}, set()

    def _read(self, i: int) -> dict:
        found = None if self.known is None else self.blocks.getValue((self.specie, i))
        return {} if found is None else dict(zip(found[0], found[1]))

    def block(self, i: int) -> dict:
        if i not in self.held:
            self.held[i] = self._read(i)
        return self.held[i]

    def step(self, op, ordine, q, pre, final, q0):
        """One event; (code, noop)."""
        cur, lines, at = q0, None, None
        if ordine is not None and pre is None:
            at = block_of(ordine, self.n)
            lines = self.block(at)
            cur = lines.get(ordine, q0)
            cur = None if cur == REMOVED else cur
        code, noop, delta, new_qty, _ = ledger_step(op, q, cur, self.stock, final, pre)
        if code is None and not noop:
            self.stock -= delta
            self.count += ordine not in lines
            lines[ordine] = REMOVED if new_qty is None else int(new_qty)
            self.written.add(at)
        return code, noop

    def _deal(self, n: int) -> None:
        """The lines in ``n`` blocks, from the last block, as the places of its parts are read already."""
        each = n // self.n
        for i in range(self.n - 1, -1, -1):
            parts = [([], []) for _ in range(each)]
            for ordine, q in (self.held.pop(i) if i in self.held else self._read(i)).items():
                part = parts[block_of(ordine, n) - i * each]
                part[0].append(ordine)
                part[1].append(q)
            for j, part in enumerate(parts):
                self.blocks.updateValue((self.specie, i * each + j), part)
        self.n = n

    def close(self) -> None:
        """Writes what the batch changed."""
        if self.stock is None or self.specie is None or (self.known is not None and not self.written):
            return
        n = self.n
        while self.count > n * BLOCK_LINES:
            n *= 2
        if n > self.n:
            self._deal(n)
        else:
            for i in self.written:
                self.blocks.updateValue((self.specie, i), (list(self.held[i]), list(self.held[i].values())))
        self.store.updateValue((self.specie,), (int(self.stock), self.count, self.n))


class StockLedger(StatefulProcessor):
    """Per group of species: stock and touched lines, updated event by event.

    A key of the state and a call to its store cost far more than an event.  So a
    key is a group of species, and lines lie in blocks, each read and written once in a
    micro-batch that meets it; a species seen for the first time reads none.  The
    blocks double as the lines grow: a species with very many of them reads
    those of its batch's orders, not all."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledgers = handle.getMapState("ledgers", "specie int", "stock int, lines long, blocks int")
        self.blocks = handle.getMapState("blocks", "specie int, block int", "ordine array<int>, quantita array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.take(np.lexsort([pdf[c].to_numpy() for c in ("seq", "ts", "specie_di_pianta")]))
        code_out, esito_out, after, ledger = [], [], [], None
        for specie, ordine, op, q, pre, final, q0, stock0 in zip(*[column_values(pdf[c]) for c in _STEP_COLS]):
            if ledger is None or specie != ledger.specie:
                if ledger is not None:
                    ledger.close()
                ledger = SpeciesLedger(specie, stock0, self.ledgers, self.blocks)
            code, noop = ledger.step(op, ordine, q, pre, bool(final), q0)
            code_out.append(code)
            esito_out.append(codes.REJECTED if code else (codes.NOOP if noop else codes.ACCEPTED))
            after.append(ledger.stock)
        ledger.close()
        yield pdf[_EVENT_COLS].assign(code=code_out, esito=esito_out, stock_after=pd.array(after, dtype="Int32"))

    def close(self) -> None:
        pass


def enrich(tables: Mapping[str, DataFrame], events: DataFrame) -> DataFrame:
    """Stream-static joins: order owner and status, snapshot line, species stock."""
    o = tables["orders"].select(F.col("id").alias("ordine"), F.col("cliente").alias("_owner"),
                                F.col("aperto_or_finalizzato").alias("_status"))
    q0 = tables["order_lines"].select("ordine", "specie_di_pianta", F.col("quantita").alias("q0"))
    sp = tables["species"].select(F.col("codice").alias("specie_di_pianta"), F.col("giacenza").alias("stock0"))
    r = events.join(o, "ordine", "left").join(q0, ["ordine", "specie_di_pianta"], "left") \
              .join(sp, "specie_di_pianta", "left")
    return r.select(
        *LINE_CHANGE_COLS, "q0", "stock0",
        true_or_false(F.col("_status") == 0).alias("is_final"),
        first_failing(
            (missing("op", "cliente", "ordine", "specie_di_pianta") | ~F.col("op").isin(*OPS), codes.INVALID),
            (~true_or_false(F.col("_owner") == F.col("cliente")), codes.NOT_OWNER),
            ((F.col("op") != "REMOVE") & (F.col("quantita").isNull() | (F.col("quantita") < 0)), codes.INVALID),
        ).alias("pre_code"))


def order_line_stream(spark: SparkSession, tables: Mapping[str, DataFrame], source_dir: str) -> DataFrame:
    """The streaming query (not started): line events from parquet files in ``source_dir``."""
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(source_dir)
    grouped = enrich(tables, events).withColumn("gruppo", F.pmod(F.xxhash64("specie_di_pianta"), F.lit(GROUPS)).cast("int"))
    return grouped.groupBy("gruppo").transformWithStateInPandas(
        statefulProcessor=StockLedger(), outputStructType=OUTPUT_SCHEMA, outputMode="Append", timeMode="None")


def run_available(spark: SparkSession, tables: Mapping[str, DataFrame], source_dir: str, sink_dir: str,
                  checkpoint: str) -> DataFrame:
    """Process every event available now (``trigger(availableNow=True)``) into a
    parquet sink and return the sink as a DataFrame."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    q = (order_line_stream(spark, tables, source_dir).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(OUTPUT_SCHEMA).parquet(sink_dir)
