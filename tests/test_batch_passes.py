"""A batch with a few shared times is told apart without shuffling the rest of it, and tables keep their partitioning."""

import datetime as dt

from hortus.operators.jobs.base import unsequenced


def _requests(spark):
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(seconds=i), i, i % 7) for i in range(20000)]
    rows += [(rows[3][0], 3, 9), (rows[5][0], 5, 5), (None, 1, 1), (rows[8][0], None, 1)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, seq long, a int")


def test_requests_of_other_times_are_not_shuffled(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # less than the batch, more than its shared times
    try:
        fit, refused = unsequenced(_requests(spark))
        assert "SortMergeJoin" not in fit._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert fit.count() == 20000 and {(r["seq"], r["a"]) for r in fit.collect() if r["seq"] in (3, 5)} == {(3, 3), (5, 5)}
    assert sorted(r["code"] for r in refused.collect()) == ["DUPLICATE", "DUPLICATE", "INVALID", "INVALID"]


def test_derived_lines_meet_a_join_on_their_keys_as_they_are(spark, tables):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.range(5).selectExpr("cast(id as int) ordine", "cast(id as int) specie_di_pianta")
        joined = asked.join(tables["order_lines"], ["ordine", "specie_di_pianta"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the grouping's own and that of ``asked``
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
