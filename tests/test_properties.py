"""Property tests (Hypothesis) of the in-batch uniqueness helpers against a greedy loop."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from hortus.functions.checks import earliest_unique, first_in_batch

T0 = dt.datetime(2021, 1, 1)

rows = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.booleans()), min_size=1, max_size=40)


def _frame(spark, rs):
    data = [(T0 + dt.timedelta(seconds=i // 2), i, a, b, ok) for i, (a, b, ok) in enumerate(rs)]
    return data, spark.createDataFrame(data, "ts timestamp_ntz, seq long, a int, b int, ok boolean")


@settings(max_examples=6, deadline=None)
@given(rs=rows)
def test_first_in_batch_is_greedy(spark, rs):
    data, df = _frame(spark, rs)
    got = {r["seq"]: r["dup"] for r in first_in_batch(df, ["a"], df.ok, "dup").collect()}
    seen, want = set(), {}
    for _, s, a, _, ok in data:
        want[s] = a in seen
        if ok:
            seen.add(a)
    assert got == want


@settings(max_examples=6, deadline=None)
@given(rs=rows)
def test_earliest_unique_is_greedy(spark, rs):
    data, df = _frame(spark, rs)
    got = {r["seq"]: r["dup"] for r in earliest_unique(df, [["a"], ["b"]], df.ok, "dup").collect()}
    held_a, held_b, want = set(), set(), {}
    for _, s, a, b, ok in data:
        want[s] = a in held_a or b in held_b
        if ok and not want[s]:
            held_a.add(a)
            held_b.add(b)
    assert got == want
