"""Plan shape: the operators SURVEY 4 expects, and none of the ones it rules out."""

import pytest

from hortus.operators import catalog as RC
from hortus.operators import orders as RO
from hortus.operators import sales as RS
from hortus.operators import supply as RU
from hortus.plans.inspect import physical_plan


def test_top_suppliers_uses_window_group_limit(tables):
    plan = physical_plan(RU.low_stock_top_suppliers(tables))
    # a partial limit before the shuffle: a popular species ships top-5 per map task
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Final" in plan


def test_low_stock_is_take_ordered(tables):
    assert "TakeOrderedAndProject" in physical_plan(RU.low_stock_species(tables, 10))


def test_year_filter_reaches_the_orders_scan(tables):
    plan = physical_plan(RS.species_monthly_sales(tables, 2000))
    assert "GreaterThanOrEqual(o_orderdate,2000-01-01" in plan


@pytest.mark.parametrize("build", [
    lambda t: RO.order_report_lines(t), lambda t: RS.species_monthly_sales(t, 2000),
    lambda t: RU.low_stock_top_suppliers(t), lambda t: RC.species_search(t, "re"), lambda t: RO.order_status(t)])
def test_no_cartesian_product(tables, build):
    plan = physical_plan(build(tables))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_as_of_join_has_no_window_on_lines(tables):
    """The windows of the as-of lookup run over prices: none has a line's quantity below it."""
    plan = physical_plan(RO.order_report_lines(tables))
    windows = [x for x in plan.splitlines() if " Window [" in x]
    assert windows and not any("quantita" in x for x in windows)


def test_projection_is_pruned(tables):
    plan = physical_plan(RO.order_species(tables))
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


