"""The panel is shuffled once, whatever is computed per code, day and slot."""

from tidemark.plans.tables import Tables


def test_one_shuffle(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = t.panel._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
