"""Equal-count buckets put only the rows of the cells in order that an edge runs through."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.windows import quantile_bucket


def ranked(df, n):
    """The buckets by one window over all rows."""
    r, rows = F.row_number().over(Window.orderBy("v", "k")), F.count(F.lit(1)).over(Window.partitionBy())
    at = F.ceil(F.round((r - 1) * n / (rows - 1).cast("double"), 9))
    return df.select("k", "v", F.greatest(F.least(at, F.lit(n)), F.lit(1)).cast("int").alias("b"))


VALUES = {
    "spread": "sin(id * 12.9898) * 1000",
    "ties": "id % 3",
    "one value": "1.5",
    "nulls": "if(id % 4 = 0, null, cast(id % 50 as double) - 20)",
    "nan": "case when id % 5 = 0 then double('nan') when id % 7 = 0 then double('-inf') else pow(10, id % 30) end",
}


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("n", [2, 5, 7])
def test_as_one_window(spark, kind, n):
    df = spark.range(203).selectExpr("id as k", f"{VALUES[kind]} as v")
    got = quantile_bucket(df, "v", n, ["k"], "b").select("k", "b").collect()
    assert sorted(got) == sorted(ranked(df, n).select("k", "b").collect())


def test_huge_cells(spark, tiny_groups):
    df = spark.range(203).selectExpr("id as k", "id % 3 as v")
    assert sorted(quantile_bucket(df, "v", 5, ["k"], "b").select("k", "b").collect()) == sorted(ranked(df, 5).select("k", "b").collect())


def test_lone_row(spark):
    df = spark.range(1).selectExpr("id as k", "1.0 as v")
    assert [r.b for r in quantile_bucket(df, "v", 5, ["k"], "b").collect()] == [1]


def test_attribution_keeps_its_rows(spark):
    df = entry.queries()["group_attribution"](spark, "/root/testdata/sf0.001")
    assert all("stored-" in name for name in df.inputFiles())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "row_number() windowspecdefinition(p" not in plan
