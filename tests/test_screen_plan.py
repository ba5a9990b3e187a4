"""The feature screen goes over its panel once, whatever is made of it."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["feature_ic_screen", "feature_family_summary"])
def test_panel_is_read_once(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") > 0
    assert sum("Relation [" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
