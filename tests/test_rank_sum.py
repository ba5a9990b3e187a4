"""Weighted sums of section ranks: one pass over a section, equal to the ranks of Spark's windows."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.spread import percentile_ranks, rank_sum


def rows(spark):
    nan, inf = float("nan"), float("inf")
    values = [1.0, 2.0, 2.0, None, nan, nan, 0.0, -0.0, -inf, inf, 5.0]
    data = [(d, k, v, values[-1 - k]) for d in (1, 2, None) for k, v in enumerate(values)] + [(3, 0, None, None), (4, 0, 7.0, None)]
    return spark.createDataFrame(data, "day int, id int, a double, b double")


@pytest.mark.parametrize("size", [None, "7"])
def test_equals_windows(spark, size):
    if size:
        spark.conf.set("spark.tidemark.maxGroupRows", size)
    try:
        got = rank_sum(rows(spark), ["day"], {"a": 0.6, "b": 0.4}, "s", ["day", "id"]).collect()
    finally:
        spark.conf.unset("spark.tidemark.maxGroupRows")
    ranked = percentile_ranks(rows(spark), ["day"], {"x": "a", "y": "b"}, bound=100)
    want = ranked.select("day", "id", (F.coalesce("x", F.lit(0.0)) * 0.6 + F.coalesce("y", F.lit(0.0)) * 0.4).alias("s")).collect()
    read = lambda found: sorted((str(r.day), r.id, round(r.s, 12)) for r in found)
    assert read(got) == read(want) and len(got) == 35


def test_sections_are_sorted_once(spark):
    plan = entry.queries()["ensemble_combine"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [day") == 1 and "rank(" not in plan
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning(day" in line]
    assert len(shuffled) == 1
