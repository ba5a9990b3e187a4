"""A candidate's session features are those of the bars it can see, picked without a candidate x bar table."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import session_features as sf

OPEN = dt.datetime(2024, 3, 4, 9, 30)


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(1)
    rows = []
    for code in ("a", "b"):
        price = 10.0
        for k in range(70):
            last, price = price, max(0.5, price * (1 + rng.choice((0, 0, rng.gauss(0, 0.01)))))
            amount = rng.choice((0.0, None, rng.uniform(1, 1e6)))
            rows.append((code, "d", OPEN + dt.timedelta(minutes=5 * k), last, max(last, price) + 0.01, min(last, price) - 0.01, price, amount, rng.uniform(1, 9)))
    return spark.createDataFrame(rows, "code string, day string, ts timestamp_ntz, open double, high double, low double, close double, amount double, vol double").cache()


def cands(spark, minutes):
    return spark.createDataFrame([(c, "d", str(m), OPEN + dt.timedelta(minutes=m), 10.0) for c in ("a", "b", "none") for m in minutes], "code string, day string, slot string, cutoff timestamp_ntz, price double")


def same(a, b):
    return a == b or (a is not None and b is not None and not isinstance(a, (str, dt.datetime)) and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(a) and math.isnan(b))))


@pytest.mark.parametrize("make", ["micro", "path"])
def test_features_see_nothing_after_the_cutoff(spark, bars, make):
    pk, minutes = ["code", "day", "slot"], [-5, 0, 3, 10, 52, 120, 215, 345, 900]

    def run(c, b):
        if make == "micro":
            return sf.minute_microstructure(c, b, pk, start="09:30", base="10:00")
        return sf.full_session_path(c, b, pk, recent=6)

    got = {(r.code, r.slot): r.asDict() for r in run(cands(spark, minutes), bars).collect()}
    assert len(got) == 3 * len(minutes)
    for m in minutes:
        alone = run(cands(spark, [m]), bars.where(F.col("ts") <= F.lit(OPEN + dt.timedelta(minutes=m)).cast("timestamp_ntz"))).collect()
        for r in alone:
            other = got[r.code, r.slot]
            assert {k for k, v in r.asDict().items() if not same(v, other[k])} == set(), (m, r.code)
    rows = "m_rows" if make == "micro" else "s_rows"
    assert got["a", "-5"][rows] == 0 and got["a", "52"][rows] == 11 and got["none", "52"][rows] == 0


def test_share_of_closes_above_what_is_known(spark, bars):
    out = sf.full_session_path(cands(spark, [50, 300]), bars, ["code", "day", "slot"], recent=6)
    for r in out.where("code <> 'none'").collect():
        seen = bars.where((F.col("code") == r.code) & (F.col("ts") <= F.lit(OPEN + dt.timedelta(minutes=int(r.slot))).cast("timestamp_ntz"))).orderBy("ts").collect()
        total = sum(x.amount or 0 for x in seen)
        vwap = sum(x.close * (x.amount or 0) for x in seen) / total
        assert r.s_above_vwap_share == pytest.approx(sum(x.close > vwap for x in seen) / len(seen))
        assert r.s_vwap_gap == pytest.approx((seen[-1].close / vwap - 1) * 100)
