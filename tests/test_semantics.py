"""Hand-computed cases for the pinned semantics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, joins, labels, policy, quality, selection, statistics, windows
from tidemark.operators.labels import Execution


def d(n):
    return dt.date(2024, 1, n)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_asof_takes_equal_time_and_never_later(spark):
    left = spark.createDataFrame([("a", d(3), 1), ("a", d(1), 2), ("b", d(9), 3)], "k string, t date, i int")
    right = spark.createDataFrame([("a", d(2), 20), ("a", d(3), 30), ("a", d(4), 40)], "k string, t date, v int")
    left, right = (x.withColumn("t", F.col("t").cast("timestamp")) for x in (left, right))
    out = joins.asof_join_backward(left, right, ["k"], "t", "t", ["v"])
    assert rows(out.na.fill(-1, ["v"]), "i", "v") == [(1, 30), (2, -1), (3, -1)]


def test_interval_end_is_a_parameter(spark):
    left = spark.createDataFrame([("a", d(5))], "k string, day date")
    spans = spark.createDataFrame([("a", d(1), d(5), "x"), ("a", d(2), None, "y")], "k string, f date, t date, g string")
    closed = spans.filter("g = 'x'")
    for inclusive, want in ((True, "x"), (False, None)):
        out = joins.asof_join_interval(left, closed, ["k"], "day", "f", "t", ["g"], ["k", "day"], inclusive)
        assert out.first()["g"] == want
    both = joins.asof_join_interval(left, spans, ["k"], "day", "f", "t", ["g"], ["k", "day"], True)
    assert both.first()["g"] == "y"  # later start wins


def test_outcomes_pending_miss_and_failed_exit(spark):
    data = [
        ("fill", 10.0, 10.0, 11.0, True, True, True), ("miss", 10.0, None, None, False, False, False),
        ("stuck", 10.0, 10.0, None, True, False, True), ("pending", 10.0, 10.0, None, True, False, False),
    ]
    df = spark.createDataFrame(data, "c string, price double, entry_ref double, exit_price double, entry_ok boolean, exit_ok boolean, truth boolean")
    df = df.withColumns({"eligible": F.lit(True), "day": F.lit(1)})
    out = {r["c"]: r for r in labels.supervised_labels(df, ["day"], Execution(), truth="truth").collect()}
    assert out["fill"]["net_return"] == pytest.approx((11 / 10.01 - 1) * 100 - 0.25)
    assert (out["miss"]["net_return"], out["miss"]["target_positive"]) == (0.0, 0)
    assert (out["stuck"]["net_return"], out["stuck"]["target_severe"]) == (-10.0, 1)
    assert out["pending"]["net_return"] is None and out["pending"]["target_positive"] is None


def test_threshold_without_eligible_day_selects_nothing(spark):
    totals = spark.createDataFrame([(1, 4), (2, 4)], "fold int, total_days int")
    hits = spark.createDataFrame([(1, d(1), 0.9), (1, d(2), 0.7), (1, d(3), 0.8)], "fold int, day date, s double")
    out = selection.nth_threshold(hits, ["fold"], "day", "s", 0.5, totals)
    assert rows(out, "fold", "threshold") == [(1, 0.8), (2, math.inf)]


def test_leave_one_out_of_single_member(spark):
    u = spark.createDataFrame([(1, "g", "a", 1.0, 1.0, 5.0), (1, "g", "b", 3.0, 2.0, 7.0), (1, "h", "c", 9.0, 1.0, 1.0)],
                              "day int, grp string, code string, ret double, tail_ret double, amount double")
    out = {r["code"]: r for r in features.loo_peer_features(u, u, ["day"], "grp", "code").collect()}
    assert out["a"]["peer_return_median"] == 3.0 and out["b"]["peer_return_median"] == 1.0
    assert out["c"]["peer_count"] == 0 and out["c"]["peer_return_median"] is None
    assert out["a"]["peer_return_dispersion"] == 0.0 and out["b"]["peer_own_percentile"] == 1.0


def test_shrinkage_falls_back(spark):
    df = spark.createDataFrame([(6, 20, 1.0, 3.0), (0, 20, None, 3.0), (0, 0, None, None)],
                               "fine_count int, coarse_count int, fine_m double, coarse_m double")
    out = features.hierarchical_shrinkage(df, ["m"])
    assert [r["shrunk_m"] for r in out.collect()] == [2.0, 3.0, 0.0]


def test_student_and_normal_tails(spark):
    assert statistics.t_upper_tail(2.0, 10) == pytest.approx(0.03669401738537018)
    assert statistics.t_upper_tail(-1.0, 3) == pytest.approx(0.8044988905221148)
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    z = statistics.z_mean_test(df, [], "v").first()
    assert z["p_value"] == pytest.approx(math.erfc(abs(2.5 / (math.sqrt(5 / 3) / 2)) / math.sqrt(2)))


def test_profit_factor_conventions(spark):
    df = spark.createDataFrame([("w", 1.0), ("n", 0.0), ("m", 2.0), ("m", -1.0)], "g string, r double")
    assert rows(statistics.profit_factor(df, ["g"], "r"), "g", "profit_factor") == [("m", 2.0), ("n", 0.0), ("w", math.inf)]


def test_future_rows_do_not_change_the_past(spark):
    full = spark.createDataFrame([("a", d(i), float(i * i)) for i in range(1, 29)], "k string, day date, px double")
    part = full.filter(F.col("day") <= d(20))
    new, old = (windows.lagged_returns(x, ["k"], ["day"], "px").filter(F.col("day") <= d(20)) for x in (full, part))
    assert rows(new.select("day", "ret_5"), "day") == rows(old.select("day", "ret_5"), "day")
    assert sorted(map(str, new.collect())) == sorted(map(str, old.collect()))


def test_null_fails_every_gate(spark):
    df = spark.createDataFrame([(None,), (0.7,)], "p double")
    assert sorted(r["passes"] for r in policy.apply_thresholds(df, {"g": ("p", ">=", 0.5)}).collect()) == [False, True]


def test_contract_checks_raise(spark):
    twice = spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    once = spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup
    before = len(jobs())
    joined = joins.left_join_checked(once, twice, ["k"])
    assert len(jobs()) == before  # nothing runs before the result is read
    with pytest.raises(Exception, match="right side has 2 rows for 1"):
        joined.collect()
    assert joins.left_join_checked(twice, once, ["k"]).count() == 2
    with pytest.raises(Exception, match="left side has 2 rows for 1"):
        joins.left_join_checked(twice, once, ["k"], "1:1").collect()
    assert joins.inner_join_identities(twice, once.where("k = 1"), ["k"]).columns == ["k", "v"]
    with pytest.raises(Exception, match="missing identity 2"):
        joins.inner_join_identities(twice, once, ["k"]).collect()
    with pytest.raises(ValueError):
        quality.assert_outcome_blind(spark.createDataFrame([(1,)], "net_return_pct int"))


def test_erfc_column(spark):
    import math

    from tidemark.functions import erfc

    xs = [0.0, 1e-9, 0.3, 1.0, 2.4999, 2.5, 3.7, 6.0, 12.0]
    rows = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    assert rows[-1].y is None
    for r in rows[:-1]:
        assert abs(r.y - math.erfc(r.x)) <= 1e-11 * math.erfc(r.x)
