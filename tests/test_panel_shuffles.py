"""What the end-to-end panel reads is shuffled once by code, and rows that lie by code are not shuffled to be stacked."""

import datetime as dt

import __spark_entry__ as entry
from pyspark.sql import functions as F

from tidemark.operators import joins


def nodes(plan):
    if "Adaptive" in plan.nodeName():
        plan = plan.initialPlan()
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_lines_are_shuffled_twice_at_most(spark):
    # all columns for bars and days, two for slots and stock-days; the others reuse these
    plan = entry.queries()["causal_panel"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    assert not any(n.nodeName() == "Exchange" and n.children().apply(0).nodeName() == "Union" for n in nodes(plan))
    dealt = [n for n in nodes(plan) if n.nodeName() == "Exchange" and "REPARTITION_BY_COL" in n.simpleString(9) and "l_shipdate" in n.toString()]
    assert len(dealt) == 7 and len({n.canonicalized().hashCode() for n in dealt}) == 2


def test_stacked_sides_stay_by_key(spark):
    day = F.date_add(F.to_date(F.lit("2020-01-01")), F.col("id").cast("int"))
    left = spark.range(40).select((F.col("id") % 3).cast("int").alias("code"), day.alias("day"), F.lit("x").alias("note")).repartition("code")
    right = left.select("code", F.col("day").alias("at"), F.dayofmonth("day").alias("v")).where("v % 5 = 0").repartition("code")
    out = joins.asof_join_backward(left, right, ["code"], "day", "at", ["v"])
    assert sum(n.nodeName() == "Exchange" for n in nodes(out._jdf.queryExecution().executedPlan())) == 2
    assert out.columns[:3] == ["code", "day", "note"] and out.schema["code"].dataType.typeName() == "integer"
    facts = [(r.code, r.day, r.v) for r in out.collect()]
    seen = sorted((r.code, r["at"], r.v) for r in right.collect())
    assert len(facts) == 40
    for code, at, v in facts:
        past = [x for c, d, x in seen if c == code and d <= at]
        assert v == (past[-1] if past else None)


def test_interval_on_keys_with_nulls(spark):
    d = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    left = spark.createDataFrame([(c, d(k)) for c in (1, 2, None) for k in range(9)], "code int, day date").repartition("code")
    spans = [(1, d(0), None, "a"), (1, d(2), d(5), "b"), (1, d(3), d(4), "c"), (None, d(0), d(9), "n"), (2, d(7), d(8), "e")]
    right = spark.createDataFrame(spans, "code int, lo date, hi date, g string")
    out = joins.asof_join_interval(left, right, ["code"], "day", "lo", "hi", ["g"], ["code", "day"])
    got = {(r.code, r.day): r.g for r in out.collect()}
    assert len(got) == 27
    for code, day in got:
        on = [s for s in spans if s[0] == code is not None and s[1] <= day and (s[2] is None or day < s[2])]
        assert got[code, day] == (max(on, key=lambda s: s[1])[3] if on else None)
