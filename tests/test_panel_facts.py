"""What a stock-day has is joined to the panel once; session work isn't repeated to find the days."""

import __spark_entry__ as entry


def test_sessions_are_read_once(spark):
    plan = entry.queries()["causal_panel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    reads = sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines())
    assert reads == 9
