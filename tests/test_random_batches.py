"""Seeded random batches against the sequential replays, at several partition counts
(SURVEY 5.3), and the price-history invariants after C1 (SURVEY 5.4)."""

import random
from decimal import Decimal

import pytest

from hortus.operators.jobs import orders as OR
from hortus.operators.jobs import packs as PK
from hortus.operators.jobs import prices as PR
from hortus.plans import requests as RQ
from tests import sequential as SEQ
from tests.test_edge_cases import PACK_SCHEMA, LINE_SCHEMA, build, order, sp, ts


def _random_ledger(seed):
    rnd = random.Random(seed)
    species = [sp(k, rnd.randint(0, 30)) for k in range(1, 6)]
    orders = [order(i, rnd.choice("AB"), open_=rnd.choice([0, 1, 1])) for i in range(1, 9)]
    lines = {}
    for i in range(1, 9):
        for k in rnd.sample(range(1, 6), 2):
            lines[(i, k)] = rnd.randint(1, 9)
    reqs = []
    for n in range(300):
        op = rnd.choice(["ADD", "ADD", "CHANGE", "REMOVE"])
        reqs.append((ts(n // 3), n, op, rnd.choice("AAAB"), rnd.randint(1, 9), rnd.choice([1, 1, 2, 3, 4, 5, 6]),
                     None if op == "REMOVE" else rnd.randint(0, 12)))
    return species, orders, lines, reqs


@pytest.mark.parametrize("seed,partitions,range_rows", [(1, 3, 10**6), (2, 11, 10**6), (3, 1, 10**6),
                                                      (6, 4, 10), (7, 7, 1), (8, 2, 30)])
def test_ledger_random_batches(spark, seed, partitions, range_rows):
    species, orders, lines, reqs = _random_ledger(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        t = build(spark, species=species, orders=orders, order_lines=[(o, k, q) for (o, k), q in lines.items()])
        res = OR.apply_order_line_changes(t, spark.createDataFrame(reqs, LINE_SCHEMA), range_rows=range_rows)
        got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["stock_after"]) for r in res.outcomes.collect()}
        stock_rows = {r["codice"]: r["giacenza"] for r in res.tables["species"].collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    cols = ["ts", "seq", "op", "cliente", "ordine", "specie_di_pianta", "quantita"]
    want, want_stock, _, _ = SEQ.replay_line_changes(
        {s[0]: s[6] for s in species}, {o[0]: [o[1], o[3]] for o in orders}, lines,
        [dict(zip(cols, r)) for r in reqs])
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == want[k][2] for k in want if want[k][0] == "accepted")
    assert stock_rows == want_stock


@pytest.mark.parametrize("seed,partitions", [(4, 2), (5, 9)])
def test_packs_random_batches(spark, seed, partitions):
    rnd = random.Random(seed)
    status = {i: rnd.choice([0, 0, 1]) for i in range(1, 7)}
    ordered = {(o, k): rnd.randint(1, 10) for o in status for k in rnd.sample(range(1, 5), 3)}
    packs = {o: {1} for o in status if status[o] == 0 and rnd.random() < 0.5}
    contents = {(o, 1, k) for o in packs for (oo, k) in ordered if oo == o and rnd.random() < 0.3}
    packed = {}
    for (o, p, k) in contents:
        packed[(o, k)] = packed.get((o, k), 0) + 1
    reqs = []
    for n in range(200):
        handle = rnd.choice([None, "h1", "h2", "h3"])
        reqs.append((ts(n), n, rnd.randint(1, 7), None if handle else rnd.choice([1, 2]), handle,
                     rnd.randint(1, 5), rnd.randint(0, 6)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        t = build(spark, species=[sp(k, 0) for k in range(1, 6)],
                  orders=[order(o, "A", open_=s) for o, s in status.items()],
                  order_lines=[(o, k, q) for (o, k), q in ordered.items()],
                  packs=[(o, 1) for o in packs], pack_contents=[(o, p, k, 1) for (o, p, k) in contents])
        res = PK.allocate_packs(t, spark.createDataFrame(reqs, PACK_SCHEMA))
        got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["pack_number"]) for r in res.outcomes.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    cols = ["ts", "seq", "ordine", "pacco", "new_pack", "specie_di_pianta", "quantita"]
    want, _ = SEQ.replay_packs(status, ordered, packed, packs, contents, [dict(zip(cols, r)) for r in reqs])
    assert got == want


def test_price_history_invariants(src, tables):
    res = PR.apply_price_changes(tables, RQ.price_changes(src))
    p = res.tables["prices"]
    # exactly one open price per species
    assert p.filter("data_termine is null").groupBy("specie_di_pianta").count().filter("count <> 1").count() == 0
    assert p.filter("data_termine is null").count() == tables["species"].count()
    # contiguous periods: each closed period ends where the next one of its species starts
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    w = Window.partitionBy("specie_di_pianta").orderBy("data_adozione")
    gaps = p.withColumn("nxt", F.lead("data_adozione").over(w)).filter(
        "(data_termine is null) <> (nxt is null) or data_termine <> nxt")
    assert gaps.count() == 0
    # accepted + no-op + rejected = requests
    assert res.outcomes.count() == RQ.price_changes(src).count()


@pytest.mark.parametrize("stock", [100000, 60])
def test_hot_species_third_of_the_batch(spark, stock):
    """One species holds a third of the requests and is folded in ranges, with ample
    and with little stock.  Both must equal the sequential replay."""
    rnd = random.Random(stock)
    species = [sp(1, stock)] + [sp(k, 50) for k in range(2, 8)]
    orders = [order(i, "A", open_=1 if i % 5 else 0) for i in range(1, 60)]
    reqs = []
    for n in range(900):
        k = 1 if n % 3 == 0 else rnd.randint(2, 7)
        op = rnd.choice(["ADD", "ADD", "ADD", "CHANGE", "REMOVE"])
        reqs.append((ts(n), n, op, "A", rnd.randint(1, 59), k, None if op == "REMOVE" else rnd.randint(1, 9)))
    t = build(spark, species=species, orders=orders)
    res = OR.apply_order_line_changes(t, spark.createDataFrame(reqs, LINE_SCHEMA), range_rows=200)
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["stock_after"]) for r in res.outcomes.collect()}
    cols = ["ts", "seq", "op", "cliente", "ordine", "specie_di_pianta", "quantita"]
    want, want_stock, _, _ = SEQ.replay_line_changes(
        {s[0]: s[6] for s in species}, {o[0]: [o[1], o[3]] for o in orders}, {}, [dict(zip(cols, r)) for r in reqs])
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == want[k][2] for k in want if want[k][0] == "accepted")
    assert {r["codice"]: r["giacenza"] for r in res.tables["species"].collect()} == want_stock


def _replayed(species, orders, lines, reqs):
    cols = ["ts", "seq", "op", "cliente", "ordine", "specie_di_pianta", "quantita"]
    return SEQ.replay_line_changes({s[0]: s[6] for s in species}, {o[0]: [o[1], o[3]] for o in orders}, lines,
                                   [dict(zip(cols, r)) for r in reqs])


@pytest.mark.parametrize("range_rows", [400, 1500])
def test_species_that_runs_out_a_thousand_times(spark, range_rows):
    """A third of the batch asks for one species, whose stock runs out more than 1,000
    times in between removals; no fold is longer than a range."""
    rnd = random.Random(range_rows)
    species = [sp(1, 40)] + [sp(k, 10**6) for k in range(2, 8)]
    orders = [order(i, "A") for i in range(1, 4000)]
    reqs, held = [], []
    for n in range(18000):
        if n % 3:
            reqs.append((ts(n), n, "ADD", "A", rnd.randint(1, 3999), rnd.randint(2, 7), rnd.randint(1, 9)))
            continue
        op = rnd.choice(["ADD", "ADD", "CHANGE", "REMOVE"])
        o = rnd.choice(held[-60:]) if held and op != "ADD" else rnd.randint(1, 3999)
        held.append(o)
        reqs.append((ts(n), n, op, "A", o, 1, None if op == "REMOVE" else rnd.randint(1, 12)))
    t = build(spark, species=species, orders=orders)
    res = OR.apply_order_line_changes(t, spark.createDataFrame(reqs, LINE_SCHEMA), range_rows=range_rows)
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["stock_after"]) for r in res.outcomes.collect()}
    want, want_stock, want_lines, _ = _replayed(species, orders, {}, reqs)
    assert sum(v[1] == "45006" for v in want.values()) > 1000
    assert got == want
    assert {r["codice"]: r["giacenza"] for r in res.tables["species"].collect()} == want_stock
    assert {(r[0], r[1]): r[2] for r in res.tables["order_lines"].collect()} == want_lines


def test_no_fold_is_longer_than_a_range(spark, monkeypatch):
    """Whatever is folded, no (species, range) has more than about range_rows requests."""
    longest = []
    fold = OR._fold

    def watched(rows, schema, clustered=False):
        longest.append(rows.groupBy("specie_di_pianta", "_range").count().agg({"count": "max"}).first()[0] or 0)
        return fold(rows, schema, clustered)
    monkeypatch.setattr(OR, "_fold", watched)
    reqs = [(ts(n), n, "ADD", "A", n, 1 if n % 3 else 2, 1) for n in range(1, 3000)]
    t = build(spark, species=[sp(1, 700), sp(2, 10)], orders=[order(i, "A") for i in range(1, 3000)])
    res = OR.apply_order_line_changes(t, spark.createDataFrame(reqs, LINE_SCHEMA), range_rows=300)
    assert res.accepted.count() == 710
    assert max(longest) < 600  # range bounds are sampled


def test_open_orders_in_ranges(spark):
    """New orders for one hot species, in ranges: each first line is a line of its own."""
    rnd = random.Random(5)
    reqs = [(ts(n), n, "A", "x", None, 1, rnd.randint(1, 9)) for n in range(900)]
    schema = ("ts timestamp_ntz, seq long, cliente string, indirizzo_spedizione string, contatto string, "
              "specie_di_pianta int, quantita int")
    t = build(spark, species=[sp(1, 1500)], customers=[("A", "a", "res", None, 1, "a@x")])
    res = OR.open_orders(t, spark.createDataFrame(reqs, schema), range_rows=100)
    stock, nth = 1500, 0
    for r in res.outcomes.orderBy("ts", "seq").collect():
        fits = r["quantita"] <= stock
        stock -= r["quantita"] if fits else 0
        nth += fits
        assert (r["code"], r["id"], r["stock_after"]) == ((None, nth, stock) if fits else ("45006", None, stock))


def test_packs_of_a_hot_order(spark):
    """An order with a third of the batch is folded by its species; creations depend on
    one another across species, and the numbers follow the accepted ones."""
    rnd = random.Random(11)
    status = {i: 0 for i in range(1, 40)}
    ordered = {(o, k): rnd.randint(5, 40) for o in status for k in range(1, 30)}
    packs, contents, packed = {1: {1, 2}}, {(1, 1, 3)}, {(1, 3): 1}
    reqs = []
    for n in range(2400):
        o = 1 if n % 3 == 0 else rnd.randint(2, 39)
        handle = rnd.choice([None, *(f"h{i}" for i in range(120))])
        reqs.append((ts(n // 2), n, o, None if handle else rnd.choice([1, 2, 9]), handle, rnd.randint(1, 31), rnd.randint(0, 25)))
    t = build(spark, species=[sp(k, 0) for k in range(1, 32)], orders=[order(o, "A", open_=0) for o in status],
              order_lines=[(o, k, q) for (o, k), q in ordered.items()], packs=[(1, 1), (1, 2)], pack_contents=[(1, 1, 3, 1)])
    res = PK.allocate_packs(t, spark.createDataFrame(reqs, PACK_SCHEMA))
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["pack_number"]) for r in res.outcomes.collect()}
    cols = ["ts", "seq", "ordine", "pacco", "new_pack", "specie_di_pianta", "quantita"]
    want, _ = SEQ.replay_packs(status, ordered, packed, packs, contents, [dict(zip(cols, r)) for r in reqs])
    assert got == want
    assert {v[1] for v in want.values()} >= {"45015", "45020", "45026", "DUPLICATE", None}


def test_pack_creations_that_hang_on_one_another(spark):
    """Pack h(i+1) is created out of what h(i)'s refused or accepted content leaves: as many rounds as packs."""
    reqs, n = [], 0
    for i in range(6):
        # h(i) is created on species i; a later content of it takes species i + 1, before h(i + 1) asks for all of that.
        reqs.append((ts(n), n, 1, None, f"h{i}", i, 5))
        reqs.append((ts(n + 1), n + 1, 1, None, f"h{i}", i + 1, 1))
        n += 2
    t = build(spark, species=[sp(k, 0) for k in range(8)], orders=[order(1, "A", open_=0)], order_lines=[(1, k, 5) for k in range(8)])
    res = PK.allocate_packs(t, spark.createDataFrame(reqs, PACK_SCHEMA))
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["pack_number"]) for r in res.outcomes.collect()}
    cols = ["ts", "seq", "ordine", "pacco", "new_pack", "specie_di_pianta", "quantita"]
    want, _ = SEQ.replay_packs({1: 0}, {(1, k): 5 for k in range(8)}, {}, {}, set(), [dict(zip(cols, r)) for r in reqs])
    assert got == want


def test_price_changes_of_a_hot_species_match_a_replay(spark):
    rnd = random.Random(2)
    prices = [(k, ts(-1), Decimal("5.00"), None) for k in (1, 2)] + [(1, ts(-9), Decimal("4.00"), ts(-1))]
    reqs = [(ts(rnd.randint(0, 60000)), n, 1 if n % 3 else 2, Decimal(rnd.choice(["5.00", "6.00", "7.50"]))) for n in range(1500)]
    t = build(spark, species=[sp(1, 0), sp(2, 0)], prices=prices)
    res = PR.apply_price_changes(t, spark.createDataFrame(reqs, "ts timestamp_ntz, seq long, specie_di_pianta int, valore decimal(7,2)"))
    want, kinds = {(k, ts(-1)): Decimal("5.00") for k in (1, 2)}, {}
    for k in (1, 2):
        price = Decimal("5.00")
        mine = sorted(r for r in reqs if r[2] == k)
        for r, after in zip(mine, [*mine[1:], None]):
            if after is not None and after[0] == r[0] or r[3] == price:
                kinds[r[1]] = "noop"
                continue
            price, kinds[r[1]] = r[3], "accepted"
            want[(k, r[0])] = price
    got = res.tables["prices"].collect()
    assert {(r[0], r[1]): r[2] for r in got if r[1] >= ts(-1)} == want
    assert {r["seq"]: r["esito"] for r in res.outcomes.collect()} == kinds
    for k in (1, 2):  # each ends where the next begins
        mine = sorted(r for r in got if r[0] == k)
        assert [r[3] for r in mine] == [*(r[1] for r in mine[1:]), None]
