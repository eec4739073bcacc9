"""Hand-written edge cases (FIXTURES.md) on tiny tables built from the engine schemas."""

import datetime as dt
from decimal import Decimal

import pytest

from hortus.functions.checks import earliest_unique
from hortus.operators import catalog as RC
from hortus.operators import orders as RO
from hortus.operators import packing as RP
from hortus.operators.jobs import catalog as CA
from hortus.operators.jobs import customers as CU
from hortus.operators.jobs import maintenance as M
from hortus.operators.jobs import orders as OR
from hortus.operators.jobs import packs as PK
from hortus.operators.jobs import prices as PR
from hortus.operators.jobs import suppliers as SU
from hortus.sources.schemas import TABLES

T0 = dt.datetime(2020, 1, 1)


def ts(i):
    return T0 + dt.timedelta(hours=i)


def build(spark, **rows):
    """Engine tables: the named ones from rows, the others empty."""
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in TABLES.items()}


def sp(codice, stock, green=0, latin=None):
    return (codice, latin or f"Latinus {codice}", f"name{codice}", 1, green, 0, stock)


def order(i, cliente, open_=1):
    return (i, cliente, T0, open_, "addr", f"{cliente}@x")


def req(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


LINE_SCHEMA = "ts timestamp_ntz, seq long, op string, cliente string, ordine int, specie_di_pianta int, quantita int"


def outcome_codes(res):
    return [r["code"] for r in res.outcomes.orderBy("ts", "seq").collect()]


def test_stock_is_spent_in_order(spark):
    t = build(spark, species=[sp(1, 10)], orders=[order(1, "A"), order(2, "A"), order(3, "A")])
    r = req(spark, [(ts(1), 1, "ADD", "A", 1, 1, 6), (ts(2), 2, "ADD", "A", 2, 1, 6), (ts(3), 3, "ADD", "A", 3, 1, 4)],
            LINE_SCHEMA)
    res = OR.apply_order_line_changes(t, r)
    assert outcome_codes(res) == [None, "45006", None]
    assert res.tables["species"].first()["giacenza"] == 0


def test_check_order_stock_before_finalized(spark):
    t = build(spark, species=[sp(1, 5)], orders=[order(1, "A", open_=0)])
    r = req(spark, [(ts(1), 1, "ADD", "A", 1, 1, 9), (ts(2), 2, "ADD", "A", 1, 1, 3)], LINE_SCHEMA)
    assert outcome_codes(OR.apply_order_line_changes(t, r)) == ["45006", "45007"]


def test_duplicate_line_owner_and_unknown(spark):
    t = build(spark, species=[sp(1, 50)], orders=[order(1, "A"), order(2, "B")])
    r = req(spark, [(ts(1), 1, "ADD", "A", 1, 1, 3), (ts(2), 2, "ADD", "A", 1, 1, 3),
                    (ts(3), 3, "ADD", "A", 2, 1, 3), (ts(4), 4, "ADD", "A", 99, 1, 3),
                    (ts(5), 5, "ADD", "A", 1, 77, 3)], LINE_SCHEMA)
    assert outcome_codes(OR.apply_order_line_changes(t, r)) == [None, "45008", "45005", "45005", "45014"]


def test_change_and_remove(spark):
    t = build(spark, species=[sp(1, 2)], orders=[order(1, "A"), order(2, "A")],
              order_lines=[(1, 1, 5), (2, 1, 8)])
    r = req(spark, [(ts(1), 1, "CHANGE", "A", 1, 1, 8), (ts(2), 2, "CHANGE", "A", 2, 1, 5),
                    (ts(3), 3, "CHANGE", "A", 1, 1, 8), (ts(4), 4, "CHANGE", "A", 1, 9, 1),
                    (ts(5), 5, "REMOVE", "A", 2, 1, None)], LINE_SCHEMA)
    res = OR.apply_order_line_changes(t, r)
    rows = res.outcomes.orderBy("seq").collect()
    assert [x["code"] for x in rows] == ["45006", None, None, None, None]
    assert [x["esito"] for x in rows] == ["rejected", "accepted", "accepted", "noop", "accepted"]
    # 2 + 3 (8 -> 5) - 3 (5 -> 8) + 5 (removed) = 7
    assert res.tables["species"].first()["giacenza"] == 7
    # the emptied order 2 is gone at the end of the batch
    assert sorted(r["id"] for r in res.tables["orders"].collect()) == [1]


def test_new_orders_contacts(spark):
    t = build(spark, species=[sp(1, 10)],
              customers=[("A", "a", "resA", None, 1, "a@x"), ("B", "b", "resB", None, 1, None),
                         ("C", "c", "resC", None, 0, None)],
              contacts=[("a@x", "email"), ("b@x", "email"), ("ref@x", "email")],
              customer_contacts=[("a@x", "A"), ("b@x", "B")], referent_contacts=[("ref@x", "C")],
              orders=[order(7, "A")])
    schema = ("ts timestamp_ntz, seq long, cliente string, indirizzo_spedizione string, contatto string, "
              "specie_di_pianta int, quantita int")
    r = req(spark, [(ts(1), 1, "A", None, None, 1, 4), (ts(2), 2, "B", None, None, 1, 1),
                    (ts(3), 3, "A", "x", "b@x", 1, 1), (ts(4), 4, "C", "y", "ref@x", 1, 9),
                    (ts(5), 5, "C", "y", "ref@x", 1, 6)], schema)
    res = OR.open_orders(t, r)
    rows = res.outcomes.orderBy("seq").collect()
    assert [x["code"] for x in rows] == [None, "45002", "45009", "45006", None]
    assert [x["id"] for x in rows] == [8, None, None, None, 9]
    new = {x["id"]: x for x in res.tables["orders"].collect()}
    assert new[8]["indirizzo_spedizione"] == "resA" and new[8]["contatto"] == "a@x"


def test_finalize(spark):
    t = build(spark, orders=[order(1, "A"), order(2, "B")])
    r = req(spark, [(ts(1), 1, "A", 1), (ts(2), 2, "A", 2), (ts(3), 3, "A", 1)],
            "ts timestamp_ntz, seq long, cliente string, ordine int")
    res = OR.finalize_orders(t, r)
    assert outcome_codes(res) == [None, "45005", None]
    assert {x["id"]: x["aperto_or_finalizzato"] for x in res.tables["orders"].collect()} == {1: 0, 2: 1}


PACK_SCHEMA = "ts timestamp_ntz, seq long, ordine int, pacco int, new_pack string, specie_di_pianta int, quantita int"


def test_packs(spark):
    t = build(spark, species=[sp(1, 0), sp(2, 0)], orders=[order(1, "A", open_=0), order(2, "A", open_=1)],
              order_lines=[(1, 1, 5), (1, 2, 4), (2, 1, 3)], packs=[(1, 1)], pack_contents=[(1, 1, 2, 1)])
    r = req(spark, [
        (ts(1), 1, 1, None, "n1", 1, 3),   # new pack 2
        (ts(2), 2, 1, None, "n2", 1, 3),   # 3 more of 5 with 3 packed: 45015, pack not created
        (ts(3), 3, 1, None, "n2", 2, 1),   # its handle never got a pack: 45026
        (ts(4), 4, 1, None, "n1", 2, 2),   # into new pack 2
        (ts(5), 5, 1, None, "n1", 2, 1),   # same species twice in one pack
        (ts(6), 6, 2, None, "n3", 1, 1),   # open order: 45034
        (ts(7), 7, 9, None, "n4", 1, 1),   # unknown order: 45027
        (ts(8), 8, 1, 1, None, 9, 1),      # species not in the order: 45020
        (ts(9), 9, 1, 5, None, 1, 1),      # unknown pack: 45026
        (ts(10), 10, 1, 1, None, 2, 1),    # already in pack 1: DUPLICATE
        (ts(11), 11, 1, None, "n5", 1, 2),  # new pack 3
    ], PACK_SCHEMA)
    res = PK.allocate_packs(t, r)
    rows = res.outcomes.orderBy("seq").collect()
    assert [x["code"] for x in rows] == [None, "45015", "45026", None, "DUPLICATE", "45034", "45027", "45020",
                                         "45026", "DUPLICATE", None]
    assert [x["pack_number"] for x in rows if x["code"] is None] == [2, 2, 3]
    assert sorted((x["ordine"], x["numero"]) for x in res.tables["packs"].collect()) == [(1, 1), (1, 2), (1, 3)]


def test_price_changes(spark):
    t = build(spark, species=[sp(1, 0), sp(2, 0)],
              prices=[(1, dt.datetime(2019, 1, 1), Decimal("5.00"), None),
                      (2, dt.datetime(2018, 1, 1), Decimal("7.00"), dt.datetime(2019, 1, 1)),
                      (2, dt.datetime(2019, 1, 1), Decimal("8.00"), None)])
    schema = "ts timestamp_ntz, seq long, specie_di_pianta int, valore decimal(7,2)"
    r = req(spark, [(ts(1), 1, 1, Decimal("5.00")),   # equal to the open price: no-op
                    (ts(2), 2, 1, Decimal("6.00")),
                    (ts(2), 3, 1, Decimal("6.50")),   # same second: the later sequence wins
                    (ts(3), 4, 1, Decimal("6.50")),   # equal to the price then in force
                    (ts(4), 5, 3, Decimal("1.00")),   # unknown species
                    (ts(5), 6, 2, Decimal("9.00"))], schema)
    res = PR.apply_price_changes(t, r)
    rows = res.outcomes.orderBy("seq").collect()
    assert [x["esito"] for x in rows] == ["noop", "noop", "accepted", "noop", "rejected", "accepted"]
    p = sorted((x["specie_di_pianta"], x["data_adozione"], x["valore"], x["data_termine"])
               for x in res.tables["prices"].collect())
    assert p == [(1, dt.datetime(2019, 1, 1), Decimal("5.00"), ts(2)), (1, ts(2), Decimal("6.50"), None),
                 (2, dt.datetime(2018, 1, 1), Decimal("7.00"), dt.datetime(2019, 1, 1)),
                 (2, dt.datetime(2019, 1, 1), Decimal("8.00"), ts(5)), (2, ts(5), Decimal("9.00"), None)]
    # exactly one open price per species, contiguous periods
    assert res.tables["prices"].filter("data_termine is null").count() == 2


def test_order_report_as_of(spark):
    t = build(spark, species=[sp(1, 0)],
              prices=[(1, dt.datetime(2019, 1, 1), Decimal("5.00"), T0), (1, T0, Decimal("6.00"), None)],
              orders=[order(1, "A"), (2, "A", dt.datetime(2019, 6, 1), 1, "a", "c"),
                      (3, "A", dt.datetime(2018, 1, 1), 1, "a", "c")],
              order_lines=[(1, 1, 2), (2, 1, 3), (3, 1, 4)])
    lines = {x["ordine"]: x for x in RO.order_report_lines(t).collect()}
    assert lines[1]["unit_price"] == Decimal("6.00")  # dated exactly at the price start
    assert lines[2]["cumulative_price"] == Decimal("15.00")
    assert 3 not in lines  # dated before the first price: no line


def test_status_and_packing_semantics(spark):
    t = build(spark, species=[sp(1, 0), sp(2, 0)], orders=[order(1, "A", 0), order(2, "A", 0), order(3, "A", 1)],
              customers=[("A", "a", "r", None, 1, None)],
              order_lines=[(1, 1, 2), (2, 1, 1), (2, 2, 1), (3, 1, 1)], pack_contents=[(1, 1, 1, 2), (2, 1, 2, 1)])
    st = {x["ordine"]: x["stato"] for x in RO.order_status(t).collect()}
    assert st == {1: "Completed", 2: "Not yet completed", 3: "Already open"}
    intended = {(x["ordine"], x["codice"]): x["already_processed"] for x in RP.packing_remaining(t).collect()}
    assert intended[(2, 1)] == 0 and intended[(3, 1)] == 0
    ref = {(x["ordine"], x["codice"]) for x in RP.packing_remaining(t, semantics="reference").collect()}
    assert (2, 1) not in ref and (3, 1) not in ref  # species packed only for other orders vanish


def test_search_fragments(spark):
    t = build(spark, species=[(1, "L1", "Rosa canina", 1, 0, 0, 1), (2, "L2", "a_b", 1, 1, 0, 1),
                              (3, "L3", "axb", 1, 1, 0, 1)],
              prices=[(1, T0, Decimal("1.00"), None), (2, T0, Decimal("1.00"), None), (3, T0, Decimal("1.00"), None)])
    assert RC.species_search(t, "").count() == 3
    assert RC.species_search(t, None).count() == 3
    assert [x["codice"] for x in RC.species_search(t, "ROSA").collect()] == [1]
    assert sorted(x["codice"] for x in RC.species_search(t, "a_b").collect()) == [2, 3]  # _ is a wildcard


def test_retention_and_restock(spark):
    now = dt.datetime(2024, 1, 1)
    t = build(spark, species=[sp(1, 1)],
              prices=[(1, dt.datetime(2020, 1, 1), Decimal("1.00"), dt.datetime(2021, 1, 1)),
                      (1, dt.datetime(2021, 1, 1), Decimal("2.00"), None)],
              orders=[(1, "A", dt.datetime(2021, 6, 1), 0, "a", "c"), (2, "A", dt.datetime(2023, 6, 1), 1, "a", "c")],
              order_lines=[(1, 1, 1), (2, 1, 1)],
              supply_requests=[(dt.datetime(2023, 1, 1), 1, 1, 5, 1), (dt.datetime(2025, 1, 1), 1, 1, 7, 1)])
    res = M.apply_retention(t, now)
    assert [x["id"] for x in res.tables["orders"].collect()] == [2]
    assert [x["ordine"] for x in res.tables["order_lines"].collect()] == [2]
    assert res.tables["prices"].count() == 1  # closed three years ago: gone; open one stays
    res = M.apply_restock(t, now)
    assert res.tables["species"].first()["giacenza"] == 6  # only the request dated before now
    assert sorted(x["pendente_si_no"] for x in res.tables["supply_requests"].collect()) == [0, 1]


def test_species_jobs(spark):
    t = build(spark, species=[sp(1, 0, green=1, latin="Rosa"), sp(2, 0)], supply_requests=[(T0, 1, 2, 1, 1)],
              colourings=[(2, "red")])
    schema = ("ts timestamp_ntz, seq long, nome_comune string, nome_latino string, interni_or_esterni int, "
              "colore string, esotica_si_no int, giacenza int, prezzo decimal(7,2)")
    r = req(spark, [(ts(1), 1, "a", "Rosa", 1, None, 0, 1, Decimal("1.00")),
                    (ts(2), 2, "b", "Nova", 3, None, 0, 1, Decimal("1.00")),
                    (ts(3), 3, "c", "Nova", 1, "blue", 0, 1, Decimal("1.00")),
                    (ts(4), 4, "d", "Nova", 1, None, 0, 1, Decimal("1.00"))], schema)
    res = CA.load_species(t, r)
    rows = res.outcomes.orderBy("seq").collect()
    assert [x["code"] for x in rows] == ["45021", "45022", None, "45021"]
    assert rows[2]["codice"] == 3
    assert res.tables["colourings"].filter("specie_fiorita = 3").first()["colore"] == "blue"
    rm = CA.remove_species(t, req(spark, [(ts(1), 1, 2), (ts(2), 2, 1), (ts(3), 3, 1), (ts(4), 4, 9)],
                                  "ts timestamp_ntz, seq long, codice int"))
    assert [x["esito"] for x in rm.outcomes.orderBy("seq").collect()] == ["rejected", "accepted", "noop", "noop"]
    col = CA.add_colourings(t, req(spark, [(ts(1), 1, 1, "x"), (ts(2), 2, 2, "red"), (ts(3), 3, 2, "blue"),
                                           (ts(4), 4, 2, "blue"), (ts(5), 5, 9, "x")],
                                   "ts timestamp_ntz, seq long, specie_fiorita int, colore string"))
    assert outcome_codes(col) == ["45019", "45030", None, "45030", "45014"]


def test_customer_jobs(spark):
    t = build(spark, customers=[("AAAAAA00A00A000A", "a", "r", None, 1, None)],
              contacts=[("a@x", "email"), ("b@x", "email")], customer_contacts=[("a@x", "AAAAAA00A00A000A")],
              orders=[(1, "AAAAAA00A00A000A", T0, 1, "addr", "a@x")])
    sch = "ts timestamp_ntz, seq long, codice string, nome string, residenza string, fatturazione string"
    res = CU.load_private_customers(t, req(spark, [(ts(1), 1, "aaaaaa00a00a000a", "x", "r", None),
                                                   (ts(2), 2, "12345678901", "x", "r", None),
                                                   (ts(3), 3, "XAAAAAA00A00A000A", "x", "r", None),  # 17 > 16
                                                   (ts(4), 4, "bbbbbb11b11b111b", "x", "r", None),
                                                   (ts(5), 5, "BBBBBB11B11B111B", "x", "r", None),
                                                   (ts(6), 6, "AAAAAA00A00A00AA", "x", "r", None)], sch))
    assert outcome_codes(res) == ["45011", "45000", "INVALID", None, "45011", "45001"]
    pref = CU.set_preferred_contacts(t, req(spark, [(ts(1), 1, "AAAAAA00A00A000A", "zz@x"),
                                                    (ts(2), 2, "AAAAAA00A00A000A", "b@x"),
                                                    (ts(3), 3, "AAAAAA00A00A000A", "a@x")],
                                            "ts timestamp_ntz, seq long, owner string, contatto string"))
    assert outcome_codes(pref) == ["45013", "45009", None]
    rm = CU.remove_contacts(t, req(spark, [(ts(1), 1, "AAAAAA00A00A000A", "a@x"), (ts(2), 2, "AAAAAA00A00A000A", "b@x")],
                                   "ts timestamp_ntz, seq long, owner string, contatto string"))
    assert outcome_codes(rm) == ["45012", "45009"]


def test_supplier_jobs(spark):
    t = build(spark, species=[sp(1, 0)], suppliers=[(1, "AAAAAA00A00A000A", "s")],
              supplier_addresses=[("Via 1", 1)], availability=[(1, 1)])
    sch = "ts timestamp_ntz, seq long, codice_fiscale string, nome string, specie_di_pianta int, indirizzo string"
    res = SU.load_suppliers(t, req(spark, [
        (ts(1), 1, "bad", "x", 1, "A"),
        (ts(2), 2, "aaaaaa00a00a000a", "x", 1, "B"),
        (ts(3), 3, "CCCCCC00C00C000C", "x", 7, "C"),
        (ts(4), 4, "DDDDDD00D00D000D", "x", 1, "Via 1"),
        (ts(5), 5, "EEEEEE00E00E000E", "x", 1, "E"),
        (ts(6), 6, "FFFFFF00F00F000F", "x", 1, "E"),      # address taken by seq 5
        (ts(7), 7, "FFFFFF00F00F000F", "x", 1, "F"),      # code free again: seq 6 was refused
        (ts(8), 8, "GGGGGG00G00G000G", "x", 1, "F")], sch))
    rows = res.outcomes.orderBy("seq").collect()
    assert [x["code"] for x in rows] == ["45023", "45035", "UNKNOWN_KEY", "45035", None, "45035", None, "45035"]
    assert [x["codice_fornitore"] for x in rows if x["code"] is None] == [2, 3]
    sr = SU.load_supply_requests(t, req(spark, [(ts(1), 1, 1, 1, 5), (ts(1), 2, 1, 1, 5), (ts(2), 3, 2, 1, 5)],
                                        "ts timestamp_ntz, seq long, fornitore int, specie_di_pianta int, quantita int"))
    assert outcome_codes(sr) == [None, "DUPLICATE", "45024"]


@pytest.mark.parametrize("n", [40])
def test_earliest_unique_matches_greedy(spark, n):
    import random
    rnd = random.Random(7)
    rows = [(ts(i), i, rnd.randint(0, 6), rnd.randint(0, 6), rnd.random() < 0.8) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, seq long, a int, b int, ok boolean")
    got = {r["seq"]: r["dup"] for r in earliest_unique(df, [["a"], ["b"]], df.ok, "dup").collect()}
    held_a, held_b, want = set(), set(), {}
    for _, s, a, b, ok in rows:
        want[s] = a in held_a or b in held_b
        if ok and not want[s]:
            held_a.add(a)
            held_b.add(b)
    assert got == want


def test_values_longer_than_their_column(spark):
    t = build(spark, species=[sp(1, 0)], suppliers=[(1, "AAAAAA00A00A000A", "s")])
    sch = "ts timestamp_ntz, seq long, codice string, nome string, residenza string, fatturazione string"
    res = CU.load_private_customers(t, req(spark, [(ts(1), 1, "bbbbbb11b11b111b", "x" * 33, "r", None),
                                                   (ts(2), 2, "cccccc11c11c111c", "x" * 32, "r", None)], sch))
    assert outcome_codes(res) == ["INVALID", None]
    addr = SU.add_supplier_addresses(t, req(spark, [(ts(1), 1, 1, "v" * 65), (ts(2), 2, 1, "v" * 64)],
                                            "ts timestamp_ntz, seq long, fornitore int, indirizzo string"))
    assert outcome_codes(addr) == ["INVALID", None]
