"""Grouped rollups and score-quality aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import holds, ratio, share
from . import radix
from .spread import best_rows, group_table, position



def _count():
    return F.count(F.lit(1))


def dealer_list_rollup(df, key, reason, sums, biggest) -> DataFrame:
    """Rows, distinct reasons, NULL-as-zero sums and the largest value per key-day."""
    return df.groupBy(*key).agg(
        _count().alias("entries"),
        F.countDistinct(reason).alias("reasons"),
        *[F.sum(F.coalesce(F.col(c), F.lit(0.0))).alias(f"{c}_sum") for c in sums],
        F.max(F.coalesce(F.col(biggest), F.lit(0.0))).alias(f"{biggest}_max"),
    )


def pair_quality_rollup(bars, pairs, on, valid: Column, clock, close_clock, min_bars) -> DataFrame:
    """Bar quality of each required pair; a pair without bars gets zeros."""
    seen = bars.groupBy(*on).agg(
        _count().alias("bars"), F.sum(share(valid)).cast("bigint").alias("valid_bars"),
        F.min(clock).alias("first_bar"), F.max(clock).alias("last_bar"),
    )
    out = pairs.select(*on).distinct().join(seen, on, "left").na.fill(0, ["bars", "valid_bars"])
    out = out.withColumn("has_close", holds(F.col("last_bar") == close_clock))
    return out.withColumn("covered", F.col("has_close") & (F.col("valid_bars") >= min_bars))


def first_event_times(df, key, time, tag_rules: dict[str, Column]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.min(F.when(c, F.col(time))).alias(f"first_{n}") for n, c in tag_rules.items()])


def expert_aggregate(long, pk, expert="expert", p="p_positive", ret="expected", risk="p_severe", score="score") -> DataFrame:
    """Consensus over experts; the id list is built from distinct ids of one identity."""
    out = group_table(
        long, pk,
        {
            "experts": F.countDistinct(expert),
            "p_median": ("quantile", p, 0.5), "p_min": F.min(p), "p_max": F.max(p),
            "ret_median": ("quantile", ret, 0.5), "ret_min": F.min(ret), "_sd": F.stddev_samp(ret),
            "risk_max": F.max(risk), "score_median": ("quantile", score, 0.5),
            "expert_ids": F.array_join(F.sort_array(F.collect_set(F.col(expert).cast("string"))), ","),
        },
    )
    return out.withColumns(
        {
            "p_spread": F.col("p_max") - F.col("p_min"),
            "ret_lower": F.col("ret_min") - 0.5 * F.coalesce("_sd", F.lit(0.0)),
        }
    ).drop("_sd")


def daily_equal_weight(df, day, value, by=()) -> DataFrame:
    daily = df.groupBy(*by, day).agg(F.avg(value).alias("_m")).filter("_m is not null")
    return daily.groupBy(*by).agg(
        _count().alias("days"), F.avg("_m").alias("day_equal_mean"), F.avg(share(F.col("_m") > 0)).alias("day_win_rate")
    )


def rejection_reason_counts(df, name, sep="|") -> DataFrame:
    reasons = df.select(F.explode(F.split(name, f"[{sep}]")).alias("reason"))
    return reasons.filter(F.trim("reason") != "").groupBy(F.trim("reason").alias("reason")).agg(_count().alias("n"))


def rejection_summary(df, stage, day, code) -> DataFrame:
    return df.groupBy(stage).agg(
        _count().alias("rows"), F.countDistinct(day).alias("days"), F.countDistinct(code).alias("codes")
    )


def stock_day_rollup(df, day, code, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*day, *code).agg(*[c.alias(n) for n, c in aggs.items()])


def basket_rollup(df, cs, code, medians, iqrs, breadth: dict, net, min_members, n, margin=0.5, severe=-2.0) -> DataFrame:
    """Features and labels of baskets of at most n rows; incomplete labels stay NULL."""
    aggs: dict = {"members": _count(), "member_list": F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", F.col(code).cast("string").alias("c")))), lambda x: x["c"]), "|")}
    aggs |= {f"{c}_median": F.percentile(c, 0.5) for c in medians}
    aggs |= {f"{c}_iqr": F.percentile(c, 0.75) - F.percentile(c, 0.25) for c in iqrs}
    aggs |= {f"{k}_breadth": F.avg(share(F.col(c) > x)) for k, (c, x) in breadth.items()}
    aggs |= {"_known": F.count(net), "_mean": F.avg(net), "_min": F.min(net), "_pos": F.avg(share(F.col(net) > 0))}
    out = df.groupBy(*cs).agg(*[a.alias(k) for k, a in aggs.items()])
    out = out.filter(F.col("members") >= min_members)
    full = F.col("_known") == F.col("members")
    mean, pos = F.col("_mean"), F.col("_pos")
    return out.withColumns(
        {
            "basket_mean": F.when(full, mean),
            "basket_min": F.when(full, F.col("_min")),
            "positive_share": F.when(full, pos),
            "target_good": F.when(full, ((mean > 0) & (pos > 0.5)).cast("int")),
            "target_margin": F.when(full, ((mean > margin) & (pos > 0.5)).cast("int")),
            "target_severe": F.when(full, (F.col("_min") <= severe).cast("int")),
        }
    ).drop("_known", "_mean", "_min", "_pos")


def group_member_counts(df, group, code) -> DataFrame:
    return df.groupBy(*group).agg(F.countDistinct(code).alias("members"))


def peer_group_count(df, by, group, code, n) -> DataFrame:
    """How many groups of each cross-section have at least n members."""
    sizes = df.groupBy(*by, group).agg(F.countDistinct(code).alias("_n"))
    return sizes.groupBy(*by).agg(
        F.sum(share(F.col("_n") >= n)).cast("bigint").alias("large_groups"), _count().alias("groups")
    )


def _score_cells(df, label, score, by):
    """Positives and rows per distinct score, the input of rank metrics."""
    return (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("_s"))
        .agg(F.sum(F.col(label).cast("int")).alias("_pos"), _count().alias("_n"))
    )


def binary_rank_auc(df, label, score, by=()) -> DataFrame:
    """Mann-Whitney AUC from average ranks; NULL when a class is missing."""
    by = list(by)
    cells = radix.prefix_sums(_score_cells(df, label, score, by), by, "_s", ["_n"])
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2
    t = cells.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.sum("_pos").alias("positives"), F.sum(rank * F.col("_pos")).alias("_r")
    )
    p = F.col("positives").cast("double")
    return t.withColumn("auc", ratio(F.col("_r") - p * (p + 1) / 2, p * (F.col("rows") - p))).drop("_r")


def average_precision(df, label, score, by=()) -> DataFrame:
    """Precision at each distinct score weighted by the recall it adds."""
    by = list(by)
    cells = radix.prefix_sums(_score_cells(df, label, score, by), by, "_s", ["_pos", "_n"])
    cells = cells.withColumns({f"_{a}": F.col(f"{c}_total") - F.col(f"{c}_before") for a, c in (("tp", "_pos"), ("all", "_n"))})
    t = cells.groupBy(*by).agg(F.sum("_pos").alias("positives"), F.sum(F.col("_pos") * F.col("_tp") / F.col("_all")).alias("_a"))
    return t.withColumn("average_precision", ratio("_a", "positives")).drop("_a")


def brier_logloss(df, label, p, by=(), eps=1e-6) -> DataFrame:
    y = F.col(label).cast("double")
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    clean = df.filter(F.col(label).isNotNull() & F.col(p).isNotNull())
    return clean.groupBy(*by).agg(
        _count().alias("rows"), F.avg((q - y) * (q - y)).alias("brier"),
        F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
    )


def loss_concentration(df, value, ns=(10, 20), by=()) -> DataFrame:
    """Share of the total loss in the worst n rows of each group.

    Only the worst max(ns) losses are ranked; the total is a plain aggregate.
    """
    by = list(by)
    loss = df.withColumn("_loss", F.when(F.col(value) < 0, -F.col(value)))
    total = loss.groupBy(*by).agg(F.coalesce(F.sum("_loss"), F.lit(0.0)).alias("total_loss"))
    worst = best_rows(loss.filter("_loss is not null").select(*by, "_loss"), by, [F.col("_loss").desc()], max(ns))
    worst = position(worst, by, [F.col("_loss").desc()], "_r", bound=max(ns))
    tops = worst.groupBy(*by).agg(*[F.sum(F.when(F.col("_r") <= n, F.col("_loss"))).alias(f"top_{n}") for n in ns])
    joined = total.join(tops, by, "left") if by else total.withColumn("_k", F.lit(1)).join(tops.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    return joined.select(
        *by, "total_loss", *[F.coalesce(ratio(f"top_{n}", "total_loss"), F.lit(0.0)).alias(f"top_{n}_share") for n in ns]
    )


def score_quantile_summary(df, cols, qs=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """One row per score column: count, min, quantiles, max."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("score"), F.col(c).cast("double").alias("v")) for c in cols])))
    aggs: dict = {"n": F.count("v"), "min": F.min("v")}
    aggs |= {f"q{int(q * 100):02d}": ("quantile", "v", q) for q in qs}
    aggs |= {"max": F.max("v")}
    return group_table(long, ["score"], aggs)


def put_call_ratios(df, by, side, cols) -> DataFrame:
    """(puts + 1) / (calls + 1) per column; negative values count as 0."""
    def total(c, s):
        return F.coalesce(F.sum(F.when(F.col(side) == s, F.greatest(F.col(c), F.lit(0)))), F.lit(0)) + 1

    return df.groupBy(*by).agg(*[ratio(total(c, "put"), total(c, "call")).alias(f"put_call_{c}") for c in cols])


def topn_concentration(df, by, value, n=5, out="concentration") -> DataFrame:
    """Sum of the n largest values over the total."""
    total = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    top = best_rows(df.filter(F.col(value).isNotNull()), by, [F.col(value).desc()], n).groupBy(*by).agg(F.sum(value).alias("_top"))
    return total.join(top, by, "left").select(*by, ratio("_top", "_total").alias(out))


def atm_strike_pick(df, by, spot, lo_dte=7, hi_dte=45, side="side", strike="strike", dte="dte", close="close", min_side=5) -> DataFrame:
    """At-the-money straddle of the nearest expiry inside the day window.

    Needs at least ``min_side`` calls and puts in the whole chain, as thin chains carry no
    reading. A strike counts when both sides are quoted.
    """
    side_n = df.groupBy(*by).agg(
        F.sum(share(F.col(side) == "call")).alias("_c"), F.sum(share(F.col(side) == "put")).alias("_p")
    ).filter((F.col("_c") >= min_side) & (F.col("_p") >= min_side)).select(*by)
    inside = df.filter(F.col(dte).between(lo_dte, hi_dte)).join(side_n, by, "left_semi")
    nearest = inside.groupBy(*by).agg(F.min(dte).alias(dte))
    near = inside.join(nearest, [*by, dte], "left_semi")
    paired = near.groupBy(*by, dte, strike, spot).agg(
        F.max(F.when(F.col(side) == "call", F.col(close))).alias("call"),
        F.max(F.when(F.col(side) == "put", F.col(close))).alias("put"),
    ).filter("call is not null and put is not null")
    gap = F.abs(F.col(strike) - F.col(spot))
    pick = paired.groupBy(*by).agg(F.min_by(F.struct(dte, strike, spot, "call", "put"), F.struct(gap, F.col(strike))).alias("_a"))
    return pick.select(*by, "_a.*").withColumns(
        {"straddle_pct": ratio(F.col("call") + F.col("put"), spot) * 100, "premium_ratio": ratio("put", "call")}
    )


def period_rollup(df, date, slot, ret) -> DataFrame:
    """The same metrics at slot, day, month, year and total level in one pass."""
    base = df.filter(F.col(ret).isNotNull()).select(
        F.year(date).alias("year"), F.date_format(date, "yyyyMM").alias("month"),
        F.col(date).cast("string").alias("day"), F.col(slot).alias("slot"), F.col(ret).alias("_r"),
    )
    keys = ["year", "month", "day", "slot"]
    y, m, d, s = (F.col(k) for k in keys)
    out = base.groupingSets([[y, m, d, s], [y, m, d], [y, m], [y], [s], []], y, m, d, s).agg(
        _count().alias("trades"), F.sum(share(F.col("_r") > 0)).alias("wins"), F.avg("_r").alias("mean_net"),
        F.min("_r").alias("worst"), F.grouping_id().alias("_g"),
    )
    # fixed values: grouping bit masks over (year, month, day, slot)
    level = (
        F.when(F.col("_g") == 0, "day_slot").when(F.col("_g") == 1, "day").when(F.col("_g") == 3, "month")
        .when(F.col("_g") == 7, "year").when(F.col("_g") == 14, "slot").otherwise("total")
    )
    return out.withColumn("level", level).withColumn("win_rate", ratio("wins", "trades")).drop("_g")
