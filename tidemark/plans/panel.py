"""End-to-end point-in-time panel and the study built on it; the study keeps the rows it selects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, joins, labels, policy, selection, statistics, windows
from ..operators.spread import measured_once, percentile_ranks, stored


@dataclass
class Sources:
    """Inputs of the panel; all keyed by ``code`` and ``day``.

    daily: OHLC, vol, amount, adj, pre_close. bars: stamped session bars. slots: one row per
    identity with its ``cutoff``. limits: up_limit, down_limit. membership: fine, coarse with
    valid_from and valid_to. calendar: day, idx.
    """

    daily: DataFrame
    bars: DataFrame
    slots: DataFrame
    limits: DataFrame
    membership: DataFrame
    calendar: DataFrame


def daily_history(daily: DataFrame) -> DataFrame:
    """Lagged features of each stock's own history: one shuffle on ``code``."""
    key, order = ["code"], ["day"]
    df = daily.withColumn("px", F.col("close") * F.col("adj"))
    df = windows.lagged_returns(df, key, order, "px", ks=(1, 5, 20))
    df = windows.rolling_volatility(df, key, order, "ret_1")
    df = windows.rolling_amount_ratio(df, key, order, "amount")
    return df.select(
        "code", "day", "pre_close", "adj", F.col("open").alias("day_open"), F.col("ret_5").alias("prev_5d_return"),
        F.col("ret_20").alias("prev_20d_return"), F.col("volatility").alias("prev_20d_volatility"), "prev_amount", "amount_ratio",
    )


def daily_facts(src: Sources) -> DataFrame:
    """History, limits, group and next day's truth of a stock-day: one row a day, before slots multiply it."""
    df = daily_history(src.daily).join(src.limits, ["code", "day"], "left")
    stock_days = src.daily.select("code", "day").distinct()
    groups = joins.asof_join_interval(
        stock_days, src.membership, ["code"], "day", "valid_from", "valid_to", ["coarse"], ["code", "day"]
    )
    df = df.join(groups.select("code", "day", F.col("coarse").alias("industry")), ["code", "day"], "left")
    truth = src.daily.select("code", "day", F.col("close").alias("t1_close"), F.col("vol").alias("t1_vol"), F.col("adj").alias("t1_adj"))
    return joins.next_period_join(df, truth, src.calendar, ["code"])


@measured_once
def causal_panel(src: Sources, cfg: labels.Execution) -> DataFrame:
    """One row per (day, slot, code) with features visible at the slot and outcome labels.

    Work is grouped by partitioning: (code) for history, (code, day) for the session,
    (day, slot) for the cross-section and labels. What a stock-day has is joined once.
    """
    pk, cs = ["day", "slot", "code"], ["day", "slot"]
    path = windows.expanding_path(src.bars, ["code", "day"], ["ts"])
    shape = ["close", "path_return", "path_max_drawdown", "path_amount"]
    df = joins.asof_join_backward(src.slots, path, ["code", "day"], "cutoff", "ts", shape)
    df = df.filter("asof_time is not null").withColumnRenamed("close", "price")
    df = df.join(daily_facts(src), ["code", "day"])
    df = features.slot_price_features(df, prev="pre_close")
    # flags and prices of a row come first: sections are shuffled without what those are made of
    df = df.withColumns(
        {
            "eligible": F.coalesce((F.col("path_amount") >= cfg.min_amount) & (F.col("adj") > 0), F.lit(False)),
            "entry_ok": F.coalesce(F.col("distance_to_up_limit") >= cfg.min_dist_up, F.lit(False)),
            "t1_down_limit": F.col("down_limit") * F.lit(0.9),
            "truth": F.col("source_day").isNotNull(),
        }
    )
    df = labels.exit_fillable(df)
    df = features.total_return_price(df, "t1_close", "adj", "t1_adj", "exit_price")
    df = windows.market_context(df, cs, "ret_from_prev_close")
    df = windows.industry_context(df, cs, "industry", "ret_from_prev_close")
    df = percentile_ranks(df, cs, {"return_rank": "ret_from_prev_close", "amount_rank": "path_amount"})
    df = labels.supervised_labels(df, cs, cfg, entry_ref="price", truth="truth")
    return df.select(
        *pk, "price", "ret_from_prev_close", "gap_open", "prev_5d_return", "prev_20d_volatility", "amount_ratio", "path_return", "path_max_drawdown",
        "industry", "market_return", "market_breadth_0", "industry_return", "return_rank", "amount_rank", "entry_ok", "exit_ok",
        "label_available", "net_return", "target_positive", "target_severe", "net_rank",
    )


STUDY_GATES = {"rank": ("return_rank", ">=", 0.5), "breadth": ("market_breadth_0", ">=", 0.3), "amount": ("amount_rank", ">=", 0.3)}


def signal_study(panel: DataFrame) -> DataFrame:
    """Gates, first crossing per stock-day and the performance of the selected rows."""
    passed = policy.apply_thresholds(panel.filter("label_available"), STUDY_GATES)
    chosen = selection.first_crossing(passed, F.col("passes"), ["day"], ["code"], [F.col("slot")])
    # the summary goes over its rows several times: one narrow row a stock-day at most, kept once
    chosen = stored(chosen.select("day", "slot", "net_return", "entry_ok", "exit_ok"))
    return statistics.performance_summary(chosen, ["slot"], "day", "net_return")
