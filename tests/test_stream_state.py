"""C22's state: blocks of lines, few calls to the store, the same decisions as one event at a time."""

import random

import pandas as pd

from hortus.operators.jobs.orders import ledger_step
from hortus.streaming import order_lines as OL


class Store:
    """A state variable in memory that counts its calls."""

    def __init__(self, log):
        self.kept, self.log = {}, log

    def _call(self, key=()):
        self.log.append(key)
        return key

    def getValue(self, key):
        return self.kept.get(self._call(key))

    def containsKey(self, key):
        return self._call(key) in self.kept

    def updateValue(self, key, value):
        self.kept[self._call(key)] = tuple(value)

    def exists(self):
        return self._call() in self.kept

    def get(self):
        return self.kept.get(self._call())

    def update(self, value):
        self.kept[self._call()] = tuple(value)


class Handle:
    def __init__(self):
        self.log = []

    def getMapState(self, *_):
        return Store(self.log)

    getValueState = getMapState


def events(n, species, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        op = r.choice(["ADD", "ADD", "CHANGE", "REMOVE"])
        rows.append({"ts": pd.Timestamp("2001-01-01") + pd.Timedelta(seconds=seed * n + r.randrange(n)), "seq": seed * n + i, "op": op,
                     "cliente": "c", "ordine": None if r.random() < 0.01 else r.randrange(400), "specie_di_pianta": r.choice(species),
                     "quantita": None if op == "REMOVE" else r.randrange(5), "q0": None, "stock0": 500, "is_final": r.random() < 0.1,
                     "pre_code": None})
        if rows[-1]["ordine"] is None:
            rows[-1]["pre_code"] = "INVALID"
        elif rows[-1]["ordine"] % 3 == 0:
            rows[-1]["q0"] = 2
    return rows


def replay(batches):
    """One event at a time: seq -> (code, stock)."""
    stock, lines, out = {}, {}, {}
    for rows in batches:
        for e in sorted(rows, key=lambda e: (e["ts"], e["seq"])):
            sp = e["specie_di_pianta"]
            place, s = (sp, e["ordine"]), stock.get(sp, e["stock0"])
            code, noop, delta, q, _ = ledger_step(e["op"], e["quantita"], lines.get(place, e["q0"]), s, e["is_final"], e["pre_code"])
            if code is None and not noop:
                s -= delta
                lines[place] = q
            stock[sp] = s
            out[e["seq"]] = (code, s)
    return out


def test_blocks_give_the_decisions_of_single_events(monkeypatch):
    monkeypatch.setattr(OL, "BLOCK_LINES", 8, raising=False)
    batches = [events(600, [1, 2, 3], seed) for seed in range(4)]
    ledger, handle, found = OL.StockLedger(), Handle(), {}
    ledger.init(handle)
    for rows in batches:
        pdf = pd.DataFrame(rows)
        for out in ledger.handleInputRows((0,), iter([pdf.iloc[:250], pdf.iloc[250:]]), None):
            found |= {s: (None if pd.isna(c) else c, a) for s, c, a in zip(out["seq"], out["code"], out["stock_after"])}
    assert found == replay(batches)


def test_the_store_is_called_by_block_not_by_event():
    ledger, handle = OL.StockLedger(), Handle()
    ledger.init(handle)
    list(ledger.handleInputRows((0,), iter([pd.DataFrame(events(2000, [1], 0))]), None))
    assert len(handle.log) < 20
