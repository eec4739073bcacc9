"""K1 on the batch's own order: requests without time or sequence, or that share them, in every job."""

from decimal import Decimal

import pytest

from hortus.functions import codes
from hortus.functions.checks import earliest_unique, one_per_time
from hortus.functions.graph import components
from hortus.operators.jobs import catalog as CA
from hortus.operators.jobs import customers as CU
from hortus.operators.jobs import orders as OR
from hortus.operators.jobs import packs as PK
from hortus.operators.jobs import prices as PR
from hortus.operators.jobs import suppliers as SU
from tests.test_edge_cases import build, order, outcome_codes, req, sp, ts
from tests.test_required import loose

FISCAL = "ABCDEF80A01H501Z"

# job, request kind, a request that is accepted, another one that would be, required columns by position
CASES = {
    "price_changes": (PR.apply_price_changes, "price_changes", (1, Decimal(7)), (2, Decimal(8)), ()),
    "new_species": (CA.load_species, "new_species", ("n", "new one", 1, None, 0, 3, Decimal(2)), ("n", "new two", 1, None, 0, 3, Decimal(2)), (0, 1)),
    "species_removals": (CA.remove_species, "species_removals", (1,), (2,), (0,)),
    "add_colours": (CA.add_colourings, "colours", (1, "red"), (2, "red"), (0, 1)),
    "remove_colours": (CA.remove_colourings, "colours", (1, "blue"), (2, "blue"), (0, 1)),
    "private": (CU.load_private_customers, "private_customers", (FISCAL, "n", "r", None), ("B" + FISCAL[1:], "n", "r", None), (0,)),
    "retail": (CU.load_retail_customers, "retail_customers", ("12345678901", "n", "r", None, "x", "y"), ("12345678902", "n", "r", None, "x", "y"), (0,)),
    "addresses": (CU.update_addresses, "addresses", ("A", "residenza", "x"), ("B", "residenza", "x"), (0, 1)),
    "add_contacts": (CU.add_contacts, "contacts", ("A", "new@x", "email"), ("B", "newer@x", "email"), (0, 1, 2)),
    "remove_contacts": (CU.remove_contacts, "contacts", ("A", "a@x", None), ("B", "b@x", None), (0, 1)),
    "preferred": (CU.set_preferred_contacts, "contacts", ("A", "a@x", None), ("B", "b@x", None), (0,)),
    "new_orders": (OR.open_orders, "new_orders", ("A", None, None, 1, 2), ("B", "s", "b@x", 2, 2), (0, 3)),
    "line_changes": (OR.apply_order_line_changes, "line_changes", ("ADD", "A", 1, 1, 3), ("ADD", "B", 2, 2, 3), (0, 1, 2, 3)),
    "finalizations": (OR.finalize_orders, "finalizations", ("A", 1), ("B", 2), (0, 1)),
    "suppliers": (SU.load_suppliers, "suppliers", (FISCAL, "n", 1, "street"), ("B" + FISCAL[1:], "n", 2, "road"), (1,)),
    "supplier_addresses": (SU.add_supplier_addresses, "supplier_addresses", (1, "lane"), (1, "alley"), (0, 1)),
    "availability": (SU.add_availability, "availability", (1, 1), (1, 2), (0, 1)),
    "supply_requests": (SU.load_supply_requests, "supply_requests", (1, 3, 4), (1, 4, 4), (0, 1, 2)),
    "packing": (PK.allocate_packs, "packing", (3, None, "h", 1, 2), (3, None, "g", 2, 2), (0, 3, 4)),
}


@pytest.fixture(scope="module")
def store(spark):
    old = ts(-100)
    t = build(spark, species=[sp(k, 50) for k in (1, 2, 3, 4)], prices=[(k, old, Decimal(5), None) for k in (1, 2, 3, 4)],
              colourings=[(1, "blue"), (2, "blue")],
              customers=[("A", "a", "ra", None, 1, "a@x"), ("B", "b", "rb", None, 1, None)],
              contacts=[("a@x", "email"), ("b@x", "email")], customer_contacts=[("a@x", "A"), ("b@x", "B")],
              orders=[(1, "A", old, 1, "s", "z@x"), (2, "B", old, 1, "s", "z@x"), (3, "A", old, 0, "s", "z@x")],
              order_lines=[(3, 1, 9), (3, 2, 9)], suppliers=[(1, "Z" + FISCAL[1:], "s")], availability=[(3, 1), (4, 1)])
    return {name: df.coalesce(1) for name, df in t.items()}


def of(kind, store):
    """The tables a job needs; a species in use cannot be removed, so its lines go."""
    if kind == "species_removals":
        return {**store, "order_lines": store["order_lines"].limit(0)}
    return store


@pytest.mark.parametrize("name", sorted(CASES))
def test_order_and_required_columns(spark, store, name):
    """One batch for each job: three requests that share a (ts, seq), two of them equal; requests without one;
    a request with a NULL for each required column.  One of the three goes through, the others are refused."""
    job, kind, a, b, required = CASES[name]
    rows = [(ts(1), 1, *a), (ts(1), 1, *b), (ts(1), 1, *a)]
    untimed = [(None, 2, *a), (ts(3), None, *a), (None, None, *b)]
    nulls = [(ts(9 + i), 90 + i, *(None if j == i else v for j, v in enumerate(a))) for i in required]
    res = job(of(kind, store), req(spark, rows + untimed + nulls, loose(kind)))
    out = res.outcomes.collect()
    assert sorted(x["code"] or "" for x in out if x["seq"] == 1 and x["ts"] is not None) == ["", "DUPLICATE", "DUPLICATE"]
    assert {x["code"] for x in out if x["seq"] != 1} == {codes.INVALID}
    assert len(out) == 6 + len(required)
    if name not in ("line_changes", "packing", "new_species"):
        return
    alone = job(of(kind, store), req(spark, [min(rows, key=lambda r: [(v is not None, v) for v in r])], loose(kind)))
    for table, df in alone.tables.items():
        assert sorted(map(repr, df.collect())) == sorted(map(repr, res.tables[table].collect())), table


def test_one_line_added_twice_at_one_time_takes_stock_once(spark):
    t = build(spark, species=[sp(1, 50)], orders=[order(1, "A")])
    r = req(spark, [(ts(1), 1, "ADD", "A", 1, 1, 3), (ts(1), 1, "ADD", "A", 1, 1, 3)], loose("line_changes"))
    res = OR.apply_order_line_changes(t, r)
    assert res.tables["species"].first()["giacenza"] == 47
    assert [tuple(x) for x in res.tables["order_lines"].collect()] == [(1, 1, 3)]


def test_finalization_without_time_closes_nothing(spark):
    t = build(spark, species=[sp(1, 50)], orders=[order(1, "A")])
    r = req(spark, [(ts(5), 5, "ADD", "A", 1, 1, 3)], loose("line_changes"))
    res = OR.apply_order_line_changes(t, r, req(spark, [(None, 1, "A", 1)], loose("finalizations")))
    assert outcome_codes(res) == [None]
    assert res.tables["orders"].first()["aperto_or_finalizzato"] == 1
    assert [x["code"] for x in res.extra["finalizations"].collect()] == ["INVALID"]


def test_one_per_time_on_a_hot_time(spark):
    rows = [(ts(1), 1, n % 3) for n in range(3000)] + [(ts(2), 1, 5), (None, 1, 5), (None, 1, 5)]
    out = one_per_time(spark.createDataFrame(rows, "ts timestamp_ntz, seq long, a int"), "again")
    assert out.count() == len(rows)
    assert sorted((str(r["ts"]), r["a"]) for r in out.filter("not again").collect()) == sorted(
        [(str(ts(1)), 0), (str(ts(2)), 5), ("None", 5), ("None", 5)])


# ---- unique keys over conflict chains


def greedy(rows):
    held, want = [set(), set()], {}
    for _, s, a, b, ok in sorted(rows):
        want[s] = a in held[0] or b in held[1]
        if ok and not want[s]:
            held[0].add(a)
            held[1].add(b)
    return want


def test_chain_of_ten_thousand_conflicts(spark, monkeypatch):
    """Request i shares one key with i - 1 and the other with i + 1: every second one is accepted,
    which set-wise rounds alone would take thousands of rounds to find."""
    from hortus.functions import graph
    rounds = []
    found = graph.components
    monkeypatch.setattr(graph, "components", lambda e: rounds.append((out := found(e))[1]) or out)
    rows = [(ts(i), i, (i + 1) // 2, i // 2, True) for i in range(10000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, a int, b int, ok boolean")
    got = {r["seq"]: r["dup"] for r in earliest_unique(df, [["a"], ["b"]], df.ok, "dup").collect()}
    assert got == greedy(rows)
    assert sum(rounds) <= 24


def test_hot_key_needs_no_walk(spark, monkeypatch):
    from hortus.functions import checks
    monkeypatch.setattr(checks, "_walk_components", lambda *a: pytest.fail("a star is not walked"))
    rows = [(ts(i), i, 1 if i % 3 == 0 else i, -i, True) for i in range(3000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, a int, b int, ok boolean")
    got = {r["seq"]: r["dup"] for r in earliest_unique(df, [["a"], ["b"]], df.ok, "dup").collect()}
    assert got == greedy(rows)


def test_components(spark):
    edges = [(1, 2), (3, 2), (7, 8), (9, 9), *((100 + i, 101 + i) for i in range(500))]
    got, rounds = components(spark.createDataFrame(edges, "a long, b long"))
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7} | {i: 100 for i in range(100, 601)}
    assert {r["id"]: r["component"] for r in got.collect()} == want
    assert rounds < 16
