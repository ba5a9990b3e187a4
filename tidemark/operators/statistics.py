"""Performance, intervals, tests, calibration and rank evidence."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import clip, erfc, hash_int, ratio, share
from . import radix
from .spread import (
    CALENDAR,
    average_ranks,
    calendar_rows,
    group_table,
    group_values,
    measured_once,
    nearby,
    percentile_ranks,
    position,
    running,
    stored,
)

Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile
INF = float("inf")


def _count():
    return F.count(F.lit(1))


# ---- closed forms ----------------------------------------------------------


def wilson_bounds(wins, n, z=Z95) -> tuple[Column, Column]:
    """Score interval of a proportion; (0, 0) without observations."""
    w, n = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (wins, n))
    p = ratio(w, n)
    base = 1 + z * z / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo = F.when(n > 0, F.greatest((mid - half) / base, F.lit(0.0))).otherwise(0.0)
    hi = F.when(n > 0, F.least((mid + half) / base, F.lit(1.0))).otherwise(0.0)
    return lo, hi


def wilson_interval(df, wins, n, z=Z95) -> DataFrame:
    lo, hi = wilson_bounds(wins, n, z)
    return df.withColumns({"wilson_lower": lo, "wilson_upper": hi})


def profit_factor_of(ret, no_loss=INF) -> Column:
    """Gains over losses: ``no_loss`` without losses, 0 without any gain or trade."""
    gain = F.coalesce(F.sum(F.when(F.col(ret) > 0, F.col(ret))), F.lit(0.0))
    loss = F.coalesce(-F.sum(F.when(F.col(ret) < 0, F.col(ret))), F.lit(0.0))
    return F.when(loss > 0, F.try_divide(gain, loss)).when(gain > 0, F.lit(no_loss)).otherwise(0.0)


def profit_factor(df, by, ret, no_loss=INF) -> DataFrame:
    return df.groupBy(*by).agg(profit_factor_of(ret, no_loss).alias("profit_factor"))


def cost_stress(df, by, ret, entered, bps, base=35.0) -> DataFrame:
    """Returns after extra cost per level, one row per (group, level).

    Only entered rows pay, and only what exceeds ``base``; ``entered=None`` charges every
    row the full level. Levels are columns of one aggregate, so rows are not multiplied.
    """
    aggs = []
    for level in bps:
        if entered is None:
            net = F.col(ret) - level / 100
        else:
            net = F.col(ret) - F.lit((level - base) / 100) * share(F.col(entered))
        aggs.append(
            F.struct(
                F.lit(float(level)).alias("cost_bps"), F.avg(net).alias("mean_net"),
                F.avg(share(net > 0)).alias("win_rate"), (F.sum(net) > 0).alias("positive_total"),
            )
        )
    clean = df.filter(F.col(ret).isNotNull())
    return clean.groupBy(*by).agg(F.array(*aggs).alias("_a")).select(*by, F.inline("_a"))


def economic_metrics(df, by, ret, hit=0.5, tail=-2.0) -> DataFrame:
    clean = df.filter(F.col(ret).isNotNull())
    return clean.groupBy(*by).agg(
        _count().alias("events"), F.avg(share(F.col(ret) > hit)).alias("hit_rate"),
        F.avg(share(F.col(ret) <= tail)).alias("tail_rate"), F.avg(ret).alias("mean_net"),
    )


def performance_summary(df, by, day, ret, entered="entry_ok", left="exit_ok", severe=-2.0, stress=(50.0,), base=35.0) -> DataFrame:
    """Event-level and day-level metrics per group, joined on the group."""
    by = list(by)
    clean = df.filter(F.col(ret).isNotNull())
    r = F.col(ret)
    aggs: dict = {
        "events": _count(), "trade_days": F.countDistinct(day), "wins": F.sum(share(r > 0)).cast("bigint"),
        "mean_net": F.avg(ret), "median_net": ("quantile", ret, 0.5), "worst_net": F.min(ret), "best_net": F.max(ret),
        "severe_rate": F.avg(share(r <= severe)), "profit_factor": profit_factor_of(ret),
        "entry_fill_rate": F.avg(share(F.col(entered))),
        "_both": F.sum(share(F.col(entered) & F.col(left))), "_in": F.sum(share(F.col(entered))),
    }
    aggs |= {f"stress_{int(b)}": F.avg(r - F.lit((b - base) / 100) * share(F.col(entered))) for b in stress}
    events = group_table(clean, by, aggs)
    lo, hi = wilson_bounds("wins", "events")
    events = events.withColumns(
        {
            "win_rate": ratio("wins", "events"), "wilson_lower": lo, "wilson_upper": hi,
            "exit_fill_rate": F.coalesce(ratio("_both", "_in"), F.lit(0.0)),
        }
    ).drop("_both", "_in")
    from .windows import cumulative_equity_drawdown

    daily = clean.groupBy(*by, day).agg(F.avg(ret).alias("_m"))
    path = cumulative_equity_drawdown(daily, by, day, "_m").groupBy(*by).agg(
        F.avg("_m").alias("day_equal_mean"), F.avg(share(F.col("_m") > 0)).alias("day_win_rate"),
        (F.max_by("equity", day) - 1).alias("compounded"), F.min("drawdown").alias("max_drawdown"),
    )
    return events.join(path, by)


# ---- resampling ------------------------------------------------------------


def _indexed_days(df, by, day, aggs: dict[str, Column]) -> DataFrame:
    """One row per (group, day) with a 0-based index and the number of days."""
    days = df.groupBy(*by, day).agg(*[c.alias(n) for n, c in aggs.items()])
    days = position(calendar_rows(days, by), by, [F.col(day)], "_i", bound=CALENDAR)
    return group_values(days, by, {"_days": _count()}, bound=CALENDAR).withColumn("_i", F.col("_i") - 1)


def _block_draws(days, by, sums: list[str], samples, block, seed) -> DataFrame:
    """Circular block bootstrap sums, one row per (group, sample).

    Block totals of every start day are built once, so a draw is one lookup per block and
    not per day. Starts come from md5, so they do not depend on partitioning.
    """
    length = F.least(F.lit(block), F.col("_days"))
    blocks = F.ceil(F.col("_days") / length)
    rest = F.col("_days") - (blocks - 1) * length
    spread = days.select("*", length.alias("_len"), blocks.alias("_blocks"), rest.alias("_rest"))
    parts = spread.withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)))
    parts = parts.withColumn("_start", F.pmod(F.col("_i") - F.col("_off"), F.col("_days")))
    table = parts.groupBy(*by, "_start").agg(
        *[F.sum(s).alias(f"{s}_full") for s in sums],
        *[F.sum(F.when(F.col("_off") < F.col("_rest"), F.col(s))).alias(f"{s}_rest") for s in sums],
    )
    groups = spread.select(*by, "_days", "_blocks").distinct()
    draws = groups.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    draws = draws.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    draws = draws.withColumn("_start", hash_int(F.lit(seed), "sample", "_b") % F.col("_days"))
    picked = draws.join(table, [*by, "_start"])
    last = F.col("_b") == F.col("_blocks") - 1
    return picked.groupBy(*by, "sample").agg(
        *[F.sum(F.when(last, F.col(f"{s}_rest")).otherwise(F.col(f"{s}_full"))).alias(s) for s in sums]
    )


def block_bootstrap_days(df, by, day, ret, samples=4000, block=5, seed=20260727) -> DataFrame:
    """95 % intervals of win rate and mean return under day-block resampling."""
    by = list(by)
    clean = df.filter(F.col(ret).isNotNull())
    days = _indexed_days(
        clean, by, day,
        {"wins": F.sum(share(F.col(ret) > 0)), "obs": _count(), "total": F.sum(ret)},
    )
    draws = _block_draws(days, by, ["wins", "obs", "total"], samples, block, seed)
    rates = draws.withColumns({"_w": ratio("wins", "obs"), "_m": ratio("total", "obs")})
    ci = rates.groupBy(*by).agg(
        *[F.percentile(c, q).alias(n) for n, c, q in (
            ("win_rate_lower", "_w", 0.025), ("win_rate_upper", "_w", 0.975),
            ("mean_lower", "_m", 0.025), ("mean_upper", "_m", 0.975))]
    )
    size = days.groupBy(*by).agg(_count().alias("days"), F.sum("obs").alias("observations"))
    return size.join(ci, by)


def iid_day_bootstrap(df, by, day, value, samples=2000, seed=0, qs=(0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles of the mean of daily means under independent day resampling."""
    by = list(by)
    days = _indexed_days(df.filter(F.col(value).isNotNull()), by, day, {"_m": F.avg(value)})
    draws = _block_draws(days, by, ["_m"], samples, 1, seed)
    n = days.groupBy(*by).agg(_count().alias("days"))
    means = draws.join(n, by).withColumn("_m", F.col("_m") / F.col("days"))
    return means.groupBy(*by).agg(
        F.max("days").alias("days"), *[F.percentile("_m", q).alias(f"q{int(q * 100):02d}") for q in qs]
    )


# ---- tests -----------------------------------------------------------------


def _beta_fraction(a, b, x):
    """Lentz evaluation of the incomplete-beta continued fraction."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + top * d
            c = 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def t_upper_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    x, a = df / (df + t * t), df / 2
    if x in (0.0, 1.0):
        tail = x / 2
    else:
        front = math.exp(
            math.lgamma(a + 0.5) - math.lgamma(a) - math.lgamma(0.5) + a * math.log(x) + 0.5 * math.log1p(-x)
        )
        inc = front * _beta_fraction(a, 0.5, x) / a if x < (a + 1) / (a + 2.5) else 1 - front * _beta_fraction(0.5, a, 1 - x) / 0.5
        tail = inc / 2
    return tail if t > 0 else 1 - tail


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or b < 1 else t_upper_tail(a, b) for a, b in zip(t, df)], dtype="float64")


@measured_once
def hac_mean_test(df, by, day, ret, max_lag=5) -> DataFrame:
    """One-sided Newey-West test that the mean daily return is positive.

    Input is reduced to one row per day first; the p-value step sees one row per group.
    """
    by = list(by)
    days = df.filter(F.col(ret).isNotNull()).groupBy(*by, day).agg(F.avg(ret).alias("_m"))
    days = group_values(calendar_rows(days, by), by, {"_mean": F.avg("_m"), "_n": _count()}, bound=CALENDAR)
    days = days.withColumn("_c", F.col("_m") - F.col("_mean"))
    days = nearby(
        days, by, [F.col(day)],
        lambda w: {f"_x{k}": F.col("_c") * F.lag("_c", k).over(w) for k in range(1, max_lag + 1)}, back=max_lag, bound=CALENDAR,
    )
    lags = F.least(F.lit(max_lag), F.col("n") - 1)
    t = days.groupBy(*by).agg(
        _count().alias("n"), F.avg("_m").alias("mean"), F.avg(F.col("_c") * F.col("_c")).alias("_g0"),
        *[F.coalesce(F.sum(f"_x{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(1, max_lag + 1)],
    )
    var = F.col("_g0")
    for k in range(1, max_lag + 1):
        weight = 1 - F.lit(float(k)) / (lags + 1)
        var = var + F.when(lags >= k, 2 * weight * F.col(f"_g{k}") / F.col("n")).otherwise(0.0)
    t = t.withColumns({"lags": lags, "se": F.sqrt(F.greatest(var, F.lit(0.0)) / F.col("n"))})
    flat = F.abs(F.col("se")) <= 1e-8
    t = t.withColumn("t_stat", F.when(~flat & (F.col("n") >= 2), ratio("mean", "se")))
    tail = _t_tail(F.col("t_stat"), (F.col("n") - 1).cast("double"))
    exact = F.when(F.col("mean") > 0, F.greatest(F.pow(F.lit(0.5), F.col("n")), F.lit(2.2250738585072014e-308))).otherwise(1.0)
    p = F.when(F.col("n") < 2, 1.0).when(flat, exact).otherwise(F.coalesce(tail, F.lit(1.0)))
    return t.withColumn("p_value", p).drop(*[f"_g{k}" for k in range(max_lag + 1)])


def z_mean_test(df, by, value, also=()) -> DataFrame:
    """Two-sided normal test of mean zero; fewer than three values give p = 1.

    ``also`` are further aggregates of the tested rows, made in the same pass.
    """
    t = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        _count().alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"), *also
    )
    se = F.col("_sd") / F.sqrt(F.col("n"))
    t = t.withColumn("z", F.when(F.col("n") >= 3, ratio(F.abs("mean"), se)))
    flat = F.when((F.col("n") >= 3) & (F.col("mean") != 0), 0.0).otherwise(1.0)
    return t.withColumn("p_value", F.coalesce(erfc(F.col("z") / math.sqrt(2)), flat)).drop("_sd")


@measured_once
def benjamini_hochberg(df, p, tie, by=(), out="q_value", bound=None) -> DataFrame:
    """False-discovery q-values; a missing p counts as 1. ``bound`` is the largest number of tests, where known."""
    by = list(by)
    df = df.withColumn("_p", F.when(F.isnan(p) | F.col(p).isNull(), 1.0).otherwise(F.col(p)))
    order = [F.col("_p"), *[F.col(c) for c in tie]]
    df = position(df, by, order, "_r", bound)
    df = group_values(df, by, {"_m": _count()}, bound)
    df = df.withColumn("_a", F.col("_p") * F.col("_m") / F.col("_r"))
    df = running(df, by, [F.col("_r").desc()], {"_q": ("min", F.col("_a"))}, bound)
    return df.withColumn(out, clip("_q", 0.0, 1.0)).drop("_p", "_r", "_m", "_a", "_q")


# ---- calibration -----------------------------------------------------------


def _bin(p, bins):
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")


def expected_calibration_error(df, by, y, p, bins=10, closed="left") -> DataFrame:
    """Bin-weighted gap of hit rate and mean probability.

    ``closed="both"`` counts a value on an inner edge in both neighbouring bins.
    """
    by = list(by)
    clean = df.filter(F.col(y).isNotNull() & F.col(p).between(0, 1))
    home = _bin(p, bins)
    if closed == "both":
        at = F.col(p) * bins
        edge = (at == F.floor(at)) & (at > 0) & (at < bins)
        clean = clean.withColumn("_bin", F.explode(F.array_compact(F.array(home, F.when(edge, home - 1)))))
    else:
        clean = clean.withColumn("_bin", home)
    cells = clean.groupBy(*by, "_bin").agg(
        _count().alias("_n"), F.avg(F.col(y).cast("int")).alias("_y"), F.avg(p).alias("_p")
    )
    size = df.filter(F.col(y).isNotNull() & F.col(p).between(0, 1)).groupBy(*by).agg(_count().alias("rows"))
    gap = F.sum(F.col("_n") * F.abs(F.col("_y") - F.col("_p")))
    t = cells.groupBy(*by).agg(gap.alias("_g")).join(size, by)
    return t.withColumn("ece", ratio("_g", "rows")).drop("_g")


def calibration_table(df, y, p, day, bins=10, samples=500, seed=0) -> DataFrame:
    """Per probability bin: rows, days, hit rate, Wilson and day-clustered lower bounds."""
    clean = df.filter(F.col(y).isNotNull() & F.col(p).between(0, 1)).withColumn("bin", _bin(p, bins))
    t = clean.groupBy("bin").agg(
        _count().alias("rows"), F.countDistinct(day).alias("days"), F.sum(F.col(y).cast("int")).alias("wins")
    )
    lo, _ = wilson_bounds("wins", "rows")
    t = t.withColumns({"win_rate": ratio("wins", "rows"), "wilson_lower": lo, "bin_left": F.col("bin") / bins})
    hits = clean.withColumn("_y", F.col(y).cast("int").cast("double"))
    boot = block_bootstrap_days(hits, ["bin"], day, "_y", samples, 1, seed)
    return t.join(boot.select("bin", F.col("win_rate_lower").alias("clustered_lower")), "bin")


# ---- rank evidence ---------------------------------------------------------


@measured_once
def rank_ic_sections(df, cs, score, ret, tie, min_n=2) -> DataFrame:
    """Spearman correlation and best-minus-worst return of each cross-section."""
    clean = df.filter(F.col(score).isNotNull() & F.col(ret).isNotNull())
    clean = average_ranks(clean, cs, {"_rs": score, "_rr": ret})
    t = clean.groupBy(*cs).agg(
        _count().alias("n"), F.covar_pop("_rs", "_rr").alias("_cov"),
        F.stddev_pop("_rs").alias("_a"), F.stddev_pop("_rr").alias("_b"),
        F.max_by(ret, F.struct(F.col(score), -F.col(tie))).alias("_top"),
        F.min_by(ret, F.struct(F.col(score), -F.col(tie))).alias("_low"),
    )
    ic = F.coalesce(ratio("_cov", F.col("_a") * F.col("_b")), F.lit(0.0))
    return t.filter(F.col("n") >= min_n).select(*cs, "n", ic.alias("ic"), (F.col("_top") - F.col("_low")).alias("spread"))


def rank_ic(df, cs, day, score, ret, tie, min_n=2, by=()) -> DataFrame:
    """Cross-section rank correlation averaged to days and then overall."""
    by = list(by)
    sections = rank_ic_sections(df, [*by, *cs], score, ret, tie, min_n)
    daily = sections.groupBy(*by, day).agg(F.avg("ic").alias("ic"), F.avg("spread").alias("spread"), _count().alias("_s"))
    return daily.groupBy(*by).agg(
        F.sum("_s").alias("sections"), _count().alias("days"), F.avg("ic").alias("mean_ic"),
        F.avg("spread").alias("mean_spread"), F.avg(share(F.col("ic") > 0)).alias("positive_days"),
    )


def _long(df, features, keep):
    """Feature columns as (feature, value) rows."""
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(items)).filter("value is not null")


def feature_ic_screen(df, cs, day, features, ret, tie, min_n=4, min_sections=20, min_ic=0.05, max_q=0.1) -> DataFrame:
    """Rank evidence of every feature with FDR control and a yearly stability rule.

    Rows are shuffled once by cross-section, before they are copied to features, and gone through
    once: years are a window over daily values, and one aggregate a feature takes all the rest.
    """
    rows = df.select(*dict.fromkeys([*cs, ret, tie, *features])).repartition(*cs)
    long = _long(rows, features, [*cs, ret, tie])
    sections = rank_ic_sections(long, ["feature", *cs], "value", ret, tie, min_n)
    daily = sections.groupBy("feature", day).agg(F.avg("ic").alias("ic"), F.avg("spread").alias("spread"), _count().alias("_s"))
    daily = daily.withColumn("_year", F.year(day))
    daily = daily.withColumn("_y", F.avg("ic").over(Window.partitionBy("feature", "_year")))
    also = [
        F.sum("_s").alias("sections"), F.avg("spread").alias("mean_spread"), F.avg(share(F.col("ic") > 0)).alias("positive_days"),
        F.count_distinct(F.when(F.col("_y") > 0, F.col("_year"))).cast("int").alias("positive_years"), F.min("_y").alias("min_year_ic"),
    ]
    test = z_mean_test(daily, ["feature"], "ic", also).withColumnRenamed("mean", "mean_ic").withColumnRenamed("n", "days")
    t = benjamini_hochberg(test, "p_value", ["feature"], bound=len(features))
    ok = (
        (F.col("sections") >= min_sections) & (F.col("mean_ic") >= min_ic) & (F.col("q_value") <= max_q)
        & (F.col("positive_years") >= 3) & (F.col("min_year_ic") > -0.02)
    )
    return t.withColumn("stable", ok)


def feature_family_summary(df, family, strength, feature="feature") -> DataFrame:
    """Best feature of each family by strength; equal strength takes the later name."""
    return df.groupBy(family).agg(
        _count().alias("features"), F.max(F.struct(F.col(strength), F.col(feature))).alias("_b")
    ).select(family, "features", F.col(f"_b.{feature}").alias("best_feature"), F.col(f"_b.{strength}").alias("best_strength"))


@measured_once
def composite_rank(df, cs, weights: dict[str, float], out="composite") -> DataFrame:
    """Weighted sum of cross-section percentile ranks; a negative weight ranks descending."""
    df = percentile_ranks(df, cs, {f"_w{i}": (c, w < 0) for i, (c, w) in enumerate(weights.items())})
    total = sum((abs(w) * F.col(f"_w{i}") for i, w in enumerate(weights.values())), F.lit(0.0))
    return df.withColumn(out, total).drop(*[f"_w{i}" for i in range(len(weights))])


def group_attribution(df, dims, buckets: dict[str, int], ret, day, tie) -> DataFrame:
    """Return metrics per value of each dimension; numeric ones in equal-count buckets.

    Buckets go over the rows several times: what they and the metrics need is kept once.
    """
    from .windows import quantile_bucket

    if buckets:
        df = stored(df.select(*dict.fromkeys([day, ret, *dims, *buckets, *tie])))
    for c, n in buckets.items():
        df = quantile_bucket(df, c, n, tie, f"_q_{c}")
    pairs = [(d, F.col(d).cast("string")) for d in dims]
    pairs += [(c, F.concat(F.lit("Q"), F.col(f"_q_{c}").cast("string"))) for c in buckets]
    long = df.select(
        day, ret, F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("bucket")) for d, v in pairs]))
    )
    return long.filter(F.col(ret).isNotNull()).groupBy("dimension", "bucket").agg(
        _count().alias("events"), F.countDistinct(day).alias("days"), F.avg(share(F.col(ret) > 0)).alias("win_rate"),
        F.avg(ret).alias("mean_net"), profit_factor_of(ret).alias("profit_factor"),
    )


def rank_monotonicity(df, day, rank, ret, n=5, samples=2000, seed=0, block=5) -> DataFrame:
    """Does return fall with rank? Ordered pairs, daily slope and its block interval."""
    means = df.filter(F.col(rank).between(1, n)).groupBy(rank).agg(F.avg(ret).alias("_m"))
    one = means.groupBy().agg(*[F.max(F.when(F.col(rank) == k, F.col("_m"))).alias(f"mean_{k}") for k in range(1, n + 1)])
    pairs = sum((F.coalesce((F.col(f"mean_{k}") >= F.col(f"mean_{k + 1}")).cast("int"), F.lit(0)) for k in range(1, n)), F.lit(0))
    wide = df.filter(F.col(rank).between(1, n)).groupBy(day).agg(
        *[F.max(F.when(F.col(rank) == k, F.col(ret))).alias(f"_r{k}") for k in range(1, n + 1)]
    ).dropna()
    mid = (n + 1) / 2
    norm = sum((k - mid) ** 2 for k in range(1, n + 1))
    slope = sum((F.col(f"_r{k}") * ((k - mid) / norm) for k in range(1, n + 1)), F.lit(0.0))
    daily = wide.select(day, slope.alias("_slope"), (F.col("_r1") - F.col(f"_r{n}")).alias("_spread"), F.lit(1).alias("_g"))
    days = _indexed_days(daily, ["_g"], day, {"slope": F.first("_slope"), "spread": F.first("_spread")})
    size = days.groupBy("_g").agg(_count().alias("complete_days"), F.avg("slope").alias("slope_mean"), F.avg("spread").alias("spread_mean"))
    draws = _block_draws(days, ["_g"], ["slope", "spread"], samples, block, seed).join(size, "_g")
    ci = draws.withColumns({c: F.col(c) / F.col("complete_days") for c in ("slope", "spread")}).groupBy("_g").agg(
        F.percentile("slope", 0.025).alias("slope_lower"), F.percentile("slope", 0.975).alias("slope_upper"),
        F.avg(share(F.col("slope") < 0)).alias("p_slope_negative"),
    )
    head = one.select(F.lit(1).alias("_g"), pairs.alias("ordered_pairs"), *[f"mean_{k}" for k in range(1, n + 1)])
    return head.join(size, "_g", "left").join(ci, "_g", "left").drop("_g")


def policy_overfit_probability(df, fold, day, code, slot, grid: list[float], score, ret, min_events=5) -> DataFrame:
    """Share of chronological splits whose in-sample best ends below the later median.

    Events are reduced to one row per (fold, threshold) of sums first; the splits then
    combine that small table.
    """
    spec = F.array(*[F.lit(float(g)) for g in grid])
    hits = df.withColumn("_g", F.explode(F.filter(spec, lambda g: g <= F.col(score))))
    from .spread import best_rows

    first = best_rows(hits, ["_g", day, *code], [F.col(slot)], 1).filter(F.col(ret).isNotNull())
    neg = F.when(F.col(ret) < 0, F.col(ret))
    cells = first.groupBy(fold, "_g").agg(
        F.sum(ret).alias("_s"), _count().alias("_n"), F.sum(neg).alias("_ls"), F.count(neg).alias("_ln")
    )
    folds = df.select(fold).distinct()
    index = position(calendar_rows(folds, []), [], [F.col(fold)], "_f", bound=CALENDAR)
    index = group_values(index, [], {"_k": _count()}, bound=CALENDAR)
    cells = cells.join(index, fold)
    cells = cells.withColumn("_split", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_k") - 1)))
    side = F.when(F.col("_f") <= F.col("_split"), "in").otherwise("out")
    t = cells.groupBy("_split", "_g", side.alias("_side")).agg(*[F.sum(c).alias(c) for c in ("_s", "_n", "_ls", "_ln")])
    down = F.when(F.col("_ln") > 0, F.abs(F.col("_ls") / F.col("_ln"))).otherwise(0.01)
    value = F.when(F.col("_n") >= min_events, (F.col("_s") / F.col("_n")) / F.greatest(down, F.lit(0.01))).otherwise(-999.0)
    wide = t.withColumn("_v", value).groupBy("_split", "_g").agg(
        F.max(F.when(F.col("_side") == "in", F.col("_v"))).alias("_in"), F.max(F.when(F.col("_side") == "out", F.col("_v"))).alias("_out")
    ).na.fill(-999.0)
    judged = wide.groupBy("_split").agg(
        F.max_by("_out", F.struct("_in", -F.col("_g"))).alias("_best"), F.percentile("_out", 0.5).alias("_median")
    )
    return judged.agg(_count().alias("splits"), F.avg(share(F.col("_best") < F.col("_median"))).alias("overfit_probability"))


def benchmark_cohorts(df, conds: dict[str, Column], ret) -> DataFrame:
    """Baseline cohorts as conditional aggregates of one scan."""
    stats = []
    for name, c in conds.items():
        inside = F.when(c & F.col(ret).isNotNull(), F.col(ret))
        stats.append(F.struct(
            F.lit(name).alias("cohort"), F.count(inside).alias("events"), F.avg((inside > 0).cast("int")).alias("win_rate"), F.avg(inside).alias("mean_net")))
    return df.agg(F.array(*stats).alias("_a")).select(F.inline("_a"))


def one_sided_residual_quantile(df, slot, resid, q=0.1, min_n=100) -> DataFrame:
    """Low residual quantile per slot, never above 0; thin slots use the overall one."""
    clean = df.filter(F.col(resid).isNotNull()).withColumn("_all", F.lit(1))
    every = group_table(clean, ["_all"], {"_global": ("quantile", resid, q)})
    slots = group_table(clean, [slot, "_all"], {"n": _count(), "_own": ("quantile", resid, q)})
    t = slots.join(every, "_all")
    value = F.when(F.col("n") >= min_n, F.col("_own")).otherwise(F.col("_global"))
    return t.select(slot, "n", F.least(value, F.lit(0.0)).alias("adjustment"))


@measured_once
def weighted_quantile(df, by, value, weight, q) -> DataFrame:
    """Smallest value whose cumulative weight reaches q of the total; 0 without weight."""
    by = list(by)
    found = radix.select_values(df, by, F.col(value), F.col(weight), {"_q": lambda total: F.lit(q) * total})
    groups = df.filter(F.col(value).isNotNull()).select(*by, F.lit(0).alias("_every")).distinct()
    same = F.lit(True)
    for k in (*by, "_every"):
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = groups.alias("a").join(found.withColumn("_every", F.lit(0)).alias("b"), same, "left")
    return joined.select(*[F.col(f"a.{b}") for b in by], F.coalesce("b._q", F.lit(0.0)).alias("weighted_quantile"))


def compounded_return(df, by, day, ret, complete) -> DataFrame:
    """Compounded day-equal return over days whose rows are all verified."""
    done = share(F.col(complete) & F.col(ret).isNotNull())
    days = df.groupBy(*by, day).agg(F.min(done).alias("_ok"), F.avg(ret).alias("_m")).filter("_ok = 1")
    return days.groupBy(*by).agg(
        _count().alias("complete_days"), ((F.product(1 + F.col("_m") / 100) - 1) * 100).alias("compounded")
    )


def cohort_validation_view(df, month, contract, day, ret, verified) -> DataFrame:
    """Month x contract x day: counts, wins, day return and whether truth is complete."""
    ok = F.col(verified) & F.col(ret).isNotNull()
    t = df.groupBy(month, contract, day).agg(
        _count().alias("candidates"), F.sum(share(ok)).cast("bigint").alias("verified_count"),
        F.sum(share(ok & (F.col(ret) > 0))).cast("bigint").alias("wins"), F.avg(F.when(ok, F.col(ret))).alias("_m"),
    )
    full = F.col("verified_count") == F.col("candidates")
    state = F.when(full, "verified").when(F.col("verified_count") > 0, "partial").otherwise("pending")
    return t.withColumns({"portfolio_return": F.when(full, F.col("_m")), "state": state}).drop("_m")
