"""Prefix sums, selection and ranks of groups of any size against sorting."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import radix, spread, statistics

EDGE = [0.0, -0.0, 1.0, 2.0, 4.0, 1024.0, 2.0**-1074, 1e308, -1e308, float("inf"), float("-inf"), 2.0**52 + 1, math.nextafter(2.0, 0), math.nextafter(8.0, 9), 0.1, -0.1]


def data(kind, n=300, seed=2):
    rng = random.Random(seed)
    make = {
        "edges": lambda: rng.choice(EDGE), "normal": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.choice((7, 7, 7, 8))), "near": lambda: 1 + rng.randint(0, 10**6) * 2.0**-50,
        "spread": lambda: rng.choice((-1, 1)) * 10 ** rng.uniform(-300, 300), "whole": lambda: rng.randint(-5, 10**12) * 1.0,
    }[kind]
    return [(rng.choice(("a", "b", None)), make() if rng.random() > 0.1 else None, rng.randint(0, 5)) for _ in range(n)]


KINDS = ["edges", "normal", "ties", "near", "spread", "whole"]


@pytest.mark.parametrize("kind", KINDS)
def test_prefix_sums(spark, kind):
    rows = data(kind)
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(3)
    cells = df.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    got = {(r.g, r.v): (r.n_before, r.n_total, r.w_before, r.w_total) for r in radix.prefix_sums(cells, ["g"], "v", ["n", "w"]).collect()}
    want = {}
    for g in ("a", "b", None):
        own = [(v, w) for x, v, w in rows if x == g and v is not None]
        for v, _ in own:
            low = [w for x, w in own if x < v]
            want[g, v] = (len(low), len(own), sum(low), sum(w for _, w in own))
    assert got == want


@pytest.mark.parametrize("kind", [k for k in KINDS if k != "edges"])
def test_quantiles_and_weighted_ones(spark, kind):
    rows = data(kind, 257, 4)
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(3)
    qs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    for r in radix.quantiles(df, ["g"], "v", qs).collect():
        own = np.array([v for x, v, _ in rows if x == r.g and v is not None])
        for n, q in qs.items():
            assert r[n] == pytest.approx(np.quantile(own, q), rel=1e-9)
    got = {r.g: r.weighted_quantile for r in statistics.weighted_quantile(df, ["g"], "v", "w", 0.4).collect()}
    for g in ("a", "b", None):
        own = sorted((v, w) for x, v, w in rows if x == g and v is not None)
        total, seen = sum(w for _, w in own), 0
        for v, w in own:
            seen += w
            if seen >= 0.4 * total:
                assert got[g] == v
                break
    assert radix.quantiles(df.where("v IS NULL"), ["g"], "v", qs).count() == 0
    nothing = statistics.weighted_quantile(df.withColumn("w", F.lit(0)), [], "v", "w", 0.4).collect()
    assert [r.weighted_quantile for r in nothing] == [0.0]


def test_ranks_of_undeclared_groups(spark):
    rows = data("ties", 120) + data("normal", 120)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, g string, v double, w int")
    for r in spread.tie_ranks(df, ["g"], F.col("v")).collect():
        own = [v for x, v, _ in rows if x == r.g and v is not None]
        assert (r._lo, r._hi) == ((None, None) if r.v is None else (sum(v < r.v for v in own) + 1, sum(v <= r.v for v in own))) and r._n == len(own)


def test_other_kinds_keep_their_order(spark):
    rng = random.Random(6)
    rows = [(dt.date(1960, 1, 1) + dt.timedelta(days=rng.randint(0, 30000)), "".join(rng.choice("abé z") for _ in range(rng.randint(0, 9))), rng.randint(-(2**62), 2**62), rng.random() < 0.5) for _ in range(150)]
    df = spark.createDataFrame(rows, "d date, s string, i bigint, b boolean").repartition(2)
    for c in df.columns:
        got = [r.v for r in radix.prefix_sums(df.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")), [], "v", ["n"]).orderBy("n_before").collect()]
        key = (lambda x: x.encode()) if c == "s" else lambda x: x
        assert got == sorted(set(df.toPandas()[c]) if c != "d" else {r[0] for r in rows}, key=key)


def test_daily_series_are_checked(spark, monkeypatch):
    monkeypatch.setattr(spread, "CALENDAR", 5)
    days = spark.range(6).withColumn("g", F.lit(1))
    assert spread.calendar_rows(days.where("id < 5"), ["g"]).count() == 5
    with pytest.raises(Exception, match="more rows than a calendar"):
        spread.calendar_rows(days, ["g"]).collect()
