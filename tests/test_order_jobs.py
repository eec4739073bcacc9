"""C12, C13 and C19 against the sequential replay, on whole derived batches."""

from hortus.operators.jobs import orders as OR
from hortus.operators.jobs import packs as PK
from hortus.plans import requests as RQ
from tests import sequential as SEQ


def _rows(df):
    return [r.asDict() for r in df.collect()]


import pytest


@pytest.mark.parametrize("range_rows", [1_000_000, 100])
def test_line_changes_match_replay(src, tables, range_rows):
    changes = _rows(RQ.order_line_changes(src))
    fins = _rows(RQ.finalizations(src))
    stock = {r["codice"]: r["giacenza"] for r in tables["species"].collect()}
    orders = {r["id"]: [r["cliente"], r["aperto_or_finalizzato"]] for r in tables["orders"].collect()}
    lines = {(r["ordine"], r["specie_di_pianta"]): r["quantita"] for r in tables["order_lines"].collect()}
    want, want_stock, want_lines, want_emptied = SEQ.replay_line_changes(stock, orders, lines, changes, fins)

    res = OR.apply_order_line_changes(tables, RQ.order_line_changes(src), RQ.finalizations(src), range_rows=range_rows)
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["stock_after"]) for r in res.outcomes.collect()}
    assert len(got) == len(changes)
    mismatches = [(k, got[k], want[k]) for k in want if got[k][:2] != want[k][:2]]
    assert not mismatches, mismatches[:5]
    # running stock after each accepted request
    acc = [k for k in want if want[k][0] == "accepted"]
    assert all(got[k][2] == want[k][2] for k in acc)
    got_stock = {r["codice"]: r["giacenza"] for r in res.tables["species"].collect()}
    assert got_stock == want_stock
    got_lines = {(r["ordine"], r["specie_di_pianta"]): r["quantita"] for r in res.tables["order_lines"].collect()}
    assert got_lines == want_lines
    got_orders = {r["id"] for r in res.tables["orders"].collect()}
    assert got_orders == set(orders) - want_emptied
    kinds = {v[1] for v in want.values()}
    assert {"45005", "45006", "45007", "45008", None} <= kinds


def test_line_changes_invariants(src, tables):
    res = OR.apply_order_line_changes(tables, RQ.order_line_changes(src), RQ.finalizations(src))
    assert res.tables["species"].filter("giacenza < 0").count() == 0
    before = tables["species"].groupBy().sum("giacenza").first()[0] + tables["order_lines"].groupBy().sum("quantita").first()[0]
    after = (res.tables["species"].groupBy().sum("giacenza").first()[0]
             + res.tables["order_lines"].groupBy().sum("quantita").first()[0])
    assert before == after  # stock + ordered quantity is conserved
    n = res.outcomes.count()
    assert n == res.outcomes.filter("esito in ('accepted','noop','rejected')").count()


@pytest.mark.parametrize("range_rows", [1_000_000, 5])
def test_new_orders_match_replay(src, tables, range_rows):
    reqs = _rows(RQ.new_orders(src))
    stock = {r["codice"]: r["giacenza"] for r in tables["species"].collect()}
    customers = {r["codice"]: (r["indirizzo_residenza"], r["contatto_preferito"]) for r in tables["customers"].collect()}
    owners = {}
    for r in tables["customer_contacts"].collect():
        owners.setdefault(r["contatto"], set()).add(r["cliente"])
    for r in tables["referent_contacts"].collect():
        owners.setdefault(r["contatto"], set()).add(r["referente"])
    max_id = max(r["id"] for r in tables["orders"].select("id").collect())
    want, want_stock = SEQ.replay_new_orders(stock, customers, owners, reqs, max_id)
    res = OR.open_orders(tables, RQ.new_orders(src), range_rows=range_rows)
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["id"]) for r in res.outcomes.collect()}
    assert got == want
    assert {r["codice"]: r["giacenza"] for r in res.tables["species"].collect()} == want_stock
    assert {v[1] for v in want.values()} >= {"45002", "45009", "45006", None}
    new = res.tables["orders"].filter(f"id > {max_id}")
    assert new.count() == sum(1 for v in want.values() if v[0] == "accepted")


def test_packs_match_replay(src, tables):
    reqs = _rows(RQ.pack_requests(src))
    status = {r["id"]: r["aperto_or_finalizzato"] for r in tables["orders"].collect()}
    ordered = {(r["ordine"], r["specie_di_pianta"]): r["quantita"] for r in tables["order_lines"].collect()}
    packed, contents, packs = {}, set(), {}
    for r in tables["pack_contents"].collect():
        k = (r["ordine"], r["specie_di_pianta"])
        packed[k] = packed.get(k, 0) + r["quantita"]
        contents.add((r["ordine"], r["pacco"], r["specie_di_pianta"]))
    for r in tables["packs"].collect():
        packs.setdefault(r["ordine"], set()).add(r["numero"])
    want, added = SEQ.replay_packs(status, ordered, packed, packs, contents, reqs)
    res = PK.allocate_packs(tables, RQ.pack_requests(src))
    got = {(r["ts"], r["seq"]): (r["esito"], r["code"], r["pack_number"]) for r in res.outcomes.collect()}
    assert got == want
    assert {v[1] for v in want.values()} >= {"45034", None}
    # packed never exceeds ordered
    pc = res.tables["pack_contents"].groupBy("ordine", "specie_di_pianta").sum("quantita").collect()
    for r in pc:
        assert r[2] <= ordered[(r[0], r[1])]
