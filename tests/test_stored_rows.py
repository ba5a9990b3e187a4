"""Model jobs go over their rows many times: the panel behind them is built once, and once only."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.spread import stored
from tidemark.plans import q_models
from tidemark.plans.tables import Tables


def test_model_rows_are_read_not_computed(spark):
    rows = q_models.weighted(Tables(spark, "/root/testdata/sf0.001"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert "stored-" in rows.inputFiles()[0]


@pytest.mark.parametrize("order", [(), ("day",)])
def test_stored_keeps_every_row(spark, order):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 > 0, F.col("id") / 3).alias("x"))
    back = stored(df, *order)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
