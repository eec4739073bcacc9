"""NULL in a required request column, a batch's finalizations, and report arguments."""

import pytest

from hortus.functions import codes
from hortus.operators.jobs import catalog as CA
from hortus.operators.jobs import customers as CU
from hortus.operators.jobs import orders as OR
from hortus.operators.jobs import suppliers as SU
from hortus.run import report_args
from hortus.sources.schemas import REQUESTS
from tests.test_edge_cases import LINE_SCHEMA, build, order, outcome_codes, req, sp, ts


def loose(kind):
    """A request schema as a Parquet read gives it: every column nullable."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in REQUESTS[kind].fields)


@pytest.mark.parametrize("range_rows", [1, 1_000_000])
def test_null_in_a_line_change_moves_no_stock(spark, range_rows):
    t = build(spark, species=[sp(1, 50)], orders=[order(1, "A")], order_lines=[(1, 1, 5)])
    r = req(spark, [(ts(1), 1, None, "A", 1, 1, 5), (ts(2), 2, "REMOVE", "A", 1, None, None),
                    (ts(3), 3, "REMOVE", "A", None, 1, None), (ts(4), 4, "REMOVE", None, 1, 1, None),
                    (ts(5), 5, "CHANGE", "A", 1, 1, 6), (ts(6), 6, "CHANGE", "A", 1, 1, 7)], LINE_SCHEMA)
    res = OR.apply_order_line_changes(t, r, range_rows=range_rows)
    assert outcome_codes(res) == [codes.INVALID] * 4 + [None, None]
    assert res.tables["species"].first()["giacenza"] == 48
    assert [tuple(x) for x in res.tables["order_lines"].collect()] == [(1, 1, 7)]


@pytest.mark.parametrize("range_rows", [1, 1_000_000])
def test_null_in_a_new_order(spark, range_rows):
    t = build(spark, species=[sp(1, 50)], customers=[("A", "a", "res", None, 1, "a@x")])
    r = req(spark, [(ts(1), 1, "A", None, None, None, 4), (ts(2), 2, None, None, None, 1, 4),
                    (ts(3), 3, "A", None, None, 1, 4), (ts(4), 4, "A", None, None, 1, 4)], loose("new_orders"))
    assert outcome_codes(OR.open_orders(t, r, range_rows=range_rows)) == [codes.INVALID, codes.INVALID, None, None]


def test_null_in_set_wise_requests(spark):
    t = build(spark, species=[sp(1, 5)], customers=[("A", "a", "res", None, 1, None)])
    private = "ABCDEF80A01H501Z"
    cases = [
        (CA.load_species, "new_species", (None, "latin", 1, None, 0, 3, None)),
        (CA.load_species, "new_species", ("name", "latin", None, None, 0, 3, None)),
        (CA.add_colourings, "colours", (1, None)),
        (CU.load_private_customers, "private_customers", (None, "n", "r", None)),
        (CU.load_retail_customers, "retail_customers", ("12345678901", "n", "r", None, None, "c")),
        (CU.update_addresses, "addresses", ("A", None, "x")),
        (CU.add_contacts, "contacts", ("A", "x@y", None)),
        (SU.load_suppliers, "suppliers", (private, None, 1, "street")),
    ]
    for job, kind, row in cases:
        res = job(t, req(spark, [(ts(1), 1, *row)], loose(kind)))
        assert outcome_codes(res) == [codes.INVALID], (job.__name__, row)


def test_finalizations_of_a_batch_reach_the_orders(spark):
    t = build(spark, species=[sp(1, 50)], orders=[order(1, "A"), order(2, "B")])
    r = req(spark, [(ts(1), 1, "ADD", "A", 1, 1, 5), (ts(3), 3, "CHANGE", "A", 1, 1, 6)], LINE_SCHEMA)
    f = req(spark, [(ts(2), 2, "A", 1), (ts(2), 9, "A", 2)], loose("finalizations"))
    res = OR.apply_order_line_changes(t, r, f)
    assert outcome_codes(res) == [None, codes.ORDER_FINALIZED]
    assert {x["id"]: x["aperto_or_finalizzato"] for x in res.tables["orders"].collect()} == {1: 0, 2: 1}
    assert [x["code"] for x in res.extra["finalizations"].orderBy("seq").collect()] == [None, codes.NOT_OWNER]


def test_report_arguments():
    assert report_args(["n=10", "open_only=true", 'customers=["A"]', "fragment=rosa"]) == {
        "n": 10, "open_only": True, "customers": ["A"], "fragment": "rosa"}
