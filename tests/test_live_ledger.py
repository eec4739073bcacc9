"""C22 on live state: orders opened, restocked and finalized on the stream, late events, state that goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hortus.streaming.live_ledger import EVENT_SCHEMA, run_live
from tests.test_edge_cases import build, order, sp

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def small(spark, **rows):
    return {name: df.coalesce(1) for name, df in build(spark, **rows).items()}


class Live:
    """A stream fed file by file; each ``feed`` is one micro-batch or more on the same checkpoint."""

    def __init__(self, spark, tables, path, **options):
        self.spark, self.tables, self.path, self.options, self.n = spark, tables, path, options, 0
        self.delay = dt.timedelta(minutes=int(options.get("delay", "60 minutes").split()[0]))

    def feed(self, *events):
        df = self.spark.createDataFrame([(*e, *[None] * (7 - len(e))) for e in events], EVENT_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        old = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")
        try:
            self.sink = run_live(self.spark, self.tables, f"{self.path}/in", f"{self.path}/out", f"{self.path}/state", **self.options)
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", old)

    def until(self, t):
        """A tick after which all up to ``t`` is decided."""
        self.n += 1
        self.feed((t + self.delay, 10**9 + self.n, "TICK"))

    def rows(self):
        return [(r["seq"], r["op"], r["esito"], r["code"], r["stock_after"]) for r in self.sink.orderBy("ts", "seq").collect()]


def replay(stock, owners, lines, events):
    """One event at a time in (ts, seq) order over global state."""
    stock, owners, lines, out = dict(stock), {k: list(v) for k, v in owners.items()}, dict(lines), {}
    for ts, seq, op, cliente, o, k, q in sorted((tuple(e) + (None,) * (7 - len(e)) for e in events), key=lambda e: e[:2]):
        code, noop, own = None, False, owners.get(o)
        if op == "NEW_ORDER":
            code = "DUPLICATE" if own else None
            owners.setdefault(o, [cliente, False])
        elif op == "RESTOCK":
            code = None if k in stock else "45014"
            if not code:
                stock[k] += q
        elif own is None or own[0] != cliente:
            code = "45005"
        elif op == "FINALIZE":
            own[1] = True
        else:
            cur, s = lines.get((o, k)), stock.get(k)
            need = q if op == "ADD" else q - cur if op == "CHANGE" and cur is not None else None
            if op != "ADD" and cur is None:
                noop = True
            elif need is not None and s is not None and need > s:
                code = "45006"
            elif own[1]:
                code = "45007"
            elif op == "ADD" and cur is not None:
                code = "45008"
            elif s is None:
                code = "45014"
            else:
                stock[k] = s - (need if need is not None else -cur)
                if op == "REMOVE":
                    del lines[(o, k)]
                else:
                    lines[(o, k)] = q
        out[seq] = ("rejected" if code else "noop" if noop else "accepted", code, stock.get(k) if op != "NEW_ORDER" and op != "FINALIZE" else None)
    return out, stock


def test_opened_restocked_and_late_between_batches(spark, tmp_path):
    """An order opened on the stream, a restock, and an event that arrives a batch late: the answers of the replay."""
    t = small(spark, species=[sp(1, 5)], orders=[order(1, "A")], order_lines=[(1, 1, 2)])
    live = Live(spark, t, str(tmp_path))
    live.feed((at(10), 10, "ADD", "B", 7, 1, 4))  # order 7 is not known yet, but a late event opens it before
    live.feed((at(5), 5, "NEW_ORDER", "B", 7), (at(12), 12, "ADD", "A", 1, 1, 1), (at(20), 20, "CHANGE", "A", 1, 1, 9))
    live.feed((at(15), 15, "RESTOCK", None, None, 1, 10), (at(30), 30, "FINALIZE", "B", 7), (at(40), 40, "REMOVE", "B", 7, 1))
    live.until(at(60))
    live.feed((at(70), 70, "CHANGE", "A", 1, 1, 1), (at(75), 75, "FINALIZE", "X", 1))
    live.until(at(200))
    assert live.rows() == [
        (5, "NEW_ORDER", "accepted", None, None), (10, "ADD", "accepted", None, 1), (12, "ADD", "rejected", "45008", 1),
        (15, "RESTOCK", "accepted", None, 11), (20, "CHANGE", "accepted", None, 4), (30, "FINALIZE", "accepted", None, None),
        (40, "REMOVE", "rejected", "45007", 4), (70, "CHANGE", "accepted", None, 12), (75, "FINALIZE", "rejected", "45005", None)]


@pytest.mark.parametrize("seed", [1])
def test_random_events_out_of_order(spark, tmp_path, seed):
    rnd = random.Random(seed)
    stock, owners = {1: 30, 2: 8}, {1: ["A", False], 2: ["B", True]}
    lines = {(1, 1): 3, (2, 1): 4}
    events = []
    for n in range(160):
        op = rnd.choice(["ADD", "ADD", "ADD", "CHANGE", "CHANGE", "REMOVE", "RESTOCK", "NEW_ORDER", "FINALIZE"])
        o, k = rnd.randint(1, 6), rnd.choice([1, 1, 1, 2, 3])
        who = rnd.choice("AAB")
        if op == "RESTOCK":
            events.append((at(n // 2), n, op, None, None, k, rnd.randint(1, 6)))
        elif op in ("NEW_ORDER", "FINALIZE"):
            events.append((at(n // 2), n, op, who, o))
        else:
            events.append((at(n // 2), n, op, who, o, k, None if op == "REMOVE" else rnd.randint(0, 7)))
    t = small(spark, species=[sp(k, q) for k, q in stock.items()],
              orders=[order(o, c, open_=int(not f)) for o, (c, f) in owners.items()], order_lines=[(o, k, q) for (o, k), q in lines.items()])
    live = Live(spark, t, str(tmp_path), delay="30 minutes")
    arrival = sorted(events, key=lambda e: e[0] + dt.timedelta(minutes=rnd.uniform(0, 25)))
    for i in range(0, len(arrival), 45):
        live.feed(*arrival[i:i + 45])
    live.until(at(500))
    want, _ = replay(stock, owners, lines, events)
    got = {seq: (esito, code, after) for seq, _, esito, code, after in live.rows()}
    assert got == want


def test_finalized_orders_are_forgotten(spark, tmp_path):
    """Past ``keep`` after its finalization an order has no state: not its owner, not its lines."""
    t = small(spark, species=[sp(1, 50)], orders=[order(1, "A")])
    live = Live(spark, t, str(tmp_path), keep=dt.timedelta(hours=6))
    live.feed((at(0), 0, "NEW_ORDER", "B", 7), (at(1), 1, "ADD", "B", 7, 1, 4), (at(2), 2, "ADD", "A", 1, 1, 3), (at(3), 3, "FINALIZE", "B", 7))
    live.until(at(60))

    def state(operator, name):
        df = (spark.read.format("statestore").option("path", f"{tmp_path}/state").option("operatorId", operator)
              .option("stateVarName", name).load())
        return df

    def kept(name):
        for operator in (0, 1):
            try:
                return sorted((r["key"][0], *r["value"]) if name != "lines" else (r["key"][0], r["user_map_key"][0], r["user_map_value"][0])
                              for r in state(operator, name).collect())
            except Exception as e:  # the operators' numbers are Spark's to choose
                last = e
        raise last

    assert [r[:3] for r in kept("order")] == [(1, "A", False), (7, "B", True)]
    assert kept("lines") == [(1, 1, 3), (1, 7, 4)]
    live.feed((at(120), 120, "CHANGE", "B", 7, 1, 9))
    live.until(at(60 * 24))
    live.feed((at(60 * 30), 1800, "CHANGE", "B", 7, 1, 9))
    live.until(at(60 * 48))
    assert [r[:3] for r in kept("order")] == [(1, "A", False)]
    assert kept("lines") == [(1, 1, 3)]
    assert [r for r in live.rows() if r[0] >= 120] == [(120, "CHANGE", "rejected", "45007", 43), (1800, "CHANGE", "rejected", "45005", 43)]
    assert live.sink.filter(F.col("op").isin("FORGET", "TICK")).isEmpty()


def test_bad_events_and_empty_input(spark, tmp_path):
    t = small(spark, species=[sp(1, 5)], orders=[order(1, "A")])
    live = Live(spark, t, str(tmp_path))
    live.feed((at(1), 1, "ADD", None, 1, 1, 1), (at(2), 2, "ADD", "A", None, 1, 1), (at(3), 3, "ADD", "A", 1, None, 1), (at(4), 4, None, "A", 1, 1, 1),
              (at(5), 5, "ADD", "A", 1, 1, -1), (at(6), 6, "ADD", "A", 1, 99, 1), (at(7), 7, "RESTOCK", None, None, 99, 1), (at(8), 8, "ADD", "A", 1, 1, 4),
              (at(8), 8, "ADD", "A", 1, 1, 4), (at(9), 9, "RESTOCK", None, None, 1, 2), (at(9), 9, "RESTOCK", None, None, 1, 2))
    live.until(at(60))
    assert sorted((r[0], r[3]) for r in live.rows() if r[3]) + [(r[0], r[3]) for r in live.rows() if not r[3]] == [(1, "INVALID"), (2, "INVALID"), (3, "INVALID"), (4, "INVALID"), (5, "INVALID"),
                                                   (6, "45014"), (7, "45014"), (8, "DUPLICATE"), (9, "DUPLICATE"), (8, None), (9, None)]
    assert live.rows()[-1][4] == 3  # 5 - 4 + 2
