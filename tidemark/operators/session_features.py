"""Features of bars inside a session: microstructure, full path, confirmation, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import all_of, clip, holds, pct, ratio, share
from .joins import bounded_array, interval_micros, micros, unique_rows
from .spread import average_ranks, best_rows, group_values, measured_once, nearby, position, running

#: Bars of one session at most: one a minute for a whole day.
SESSION_BARS = 1440
INTRADAY = ("open", "high", "low", "close", "amount", "vol")


def _session(bars, by, start=None, time="ts") -> DataFrame:
    """Bars of each stock-day from ``start`` on, with floored amounts."""
    b = bars.select(*by, F.col(time).alias("_ts"), *[c for c in INTRADAY if c in bars.columns])
    if start is not None:
        b = b.filter(F.date_format("_ts", "HH:mm") >= start)
    floored = {c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)) for c in ("amount", "vol") if c in b.columns}
    return b.withColumns(floored)


class _Upto:
    """Values of a session up to a bar: running aggregates, bars back, and spans counted from it."""

    def __init__(self, by: list[str]):
        self.order = Window.partitionBy(*by).orderBy("_ts")
        self.run = self.order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def __call__(self, value: Column) -> Column:
        return value.over(self.run)

    def back(self, name: str, k: int) -> Column:
        return F.lag(name, k).over(self.order)

    def span(self, value: Column, lo: int, hi: int | None) -> Column:
        """Over bars ``lo .. hi - 1`` counted back from this one; to the session's start without ``hi``."""
        return value.over(self.order.rowsBetween(Window.unboundedPreceding if hi is None else 1 - hi, -lo))

    def pearson(self, a: Column, b: Column) -> Column:
        return F.try_divide(self(F.covar_pop(a, b)), self(F.stddev_pop(a)) * self(F.stddev_pop(b)))


def _asked(bars, cands, by, cutoff) -> DataFrame:
    """Bars with ``_asks``, the candidates (as structs) that see the bar as their last one.

    Only bars and keys as they came are stacked and sorted: the features of a bar, many times as
    wide, are neither shuffled nor sorted, and those of bars that nobody asks for are dropped where
    they arise. A candidate that sees no bar waits (``_seen`` false) on the session's first row,
    which has no bar if the session has none.
    """
    names = [c for c in bars.columns if c not in by]
    side = bars.dropna(subset=list(by)).select(*by, F.col("_ts").alias("_t"), F.lit(0).alias("_side"), F.struct(*names).alias("_bar"))
    asks = cands.select(*by, F.col(cutoff).alias("_t"), F.lit(1).alias("_side"), F.struct(*cands.columns).alias("_row"))
    w = Window.partitionBy(*by).orderBy("_t", "_side")
    at = F.count("_bar").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = side.unionByName(asks, allowMissingColumns=True).withColumn("_at", at)
    ask = F.when(F.col("_row").isNotNull(), F.struct("_row", (F.col("_at") > 0).alias("_seen")))
    rows = rows.select(*by, F.greatest("_at", F.lit(1)).alias("_at"), "_bar", ask.alias("_ask"))
    return rows.groupBy(*by, "_at").agg(F.max("_bar").alias("_bar"), F.collect_list("_ask").alias("_asks")).select(*by, "_bar.*", "_asks")


def _picked(session, aggs) -> DataFrame:
    """Each candidate with the values of its last visible bar; NULL where it sees none."""
    rows = session.select("_asks", F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("_v")).where(F.size("_asks") > 0)
    rows = rows.select(F.inline("_asks"), "_v")
    return rows.select("_row.*", *[F.when(F.col("_seen"), F.col(f"_v.{k}")).alias(k) for k in aggs])


def _last(value, k=0) -> Column:
    """Value of the k-th bar from the end."""
    return F.max(F.when(F.col("_n") - F.col("_i") == k, value if isinstance(value, Column) else F.col(value)))


def _pearson(a: Column, b: Column) -> Column:
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


@measured_once
def _numbered(df, by) -> DataFrame:
    order = [F.col("_ts")]
    df = position(df, by, order, "_i")
    df = nearby(df, by, order, lambda w: {"_pc": F.lag("close").over(w)})
    df = df.withColumn("_r", ratio("close", "_pc") - 1)
    return nearby(df, by, order, lambda w: {"_pr": F.lag("_r").over(w)})


@measured_once
def _with_streaks(df, by) -> DataFrame:
    order = [F.col("_ts")]
    df = running(
        df, by, order,
        {
            "_peak": ("max", F.col("close")),
            "_not_up": ("max", F.when(~holds(F.col("_r") > 0), F.col("_i"))),
            "_not_down": ("max", F.when(~holds(F.col("_r") < 0), F.col("_i"))),
        },
    )
    return running(df, by, order, {"_ph": ("max", F.col("high")), "_pl": ("min", F.col("low"))}, current=False)


def minute_microstructure(cands, bars, pk, by=("code", "day"), cutoff="cutoff", start="13:55", base="14:00") -> DataFrame:
    """Shape of the minute bars from ``start`` to the cutoff, one row per candidate.

    What a candidate sees is the session up to one bar, so every feature is a running value of
    the session, kept bar by bar, and a candidate picks the row of its last visible bar.
    """
    by = list(by)
    session = _with_streaks(_numbered(_asked(_session(bars, by, start), cands.select(*pk, cutoff), by, cutoff), by), by)
    see = _Upto(by)
    r, amount, close = F.col("_r"), F.col("amount"), F.col("close")
    n, total, volume = see(F.count(F.lit(1))), see(F.sum("amount")), see(F.sum("vol"))
    low, high = see(F.min("low")), see(F.max("high"))
    both = F.col("_pr").isNotNull() & r.isNotNull()
    lost = F.when(r < 0, r)
    m = see(F.count(r))
    move = F.abs(close - F.col("_pc"))
    aggs = {
        "m_rows": n,
        "m_zero_amount_share": see(F.avg(share(amount <= 0))),
        **{f"m_ret_{k}": pct(close, see.back("close", k)) for k in (1, 3, 5, 10)},
        "m_ret_from_base": pct(close, see(F.max(F.when(F.date_format("_ts", "HH:mm") == base, close)))),
        "m_volatility": see(F.stddev_pop(r)) * 100,
        "m_downside_volatility": F.when(see(F.count(lost)) >= 2, see(F.stddev_pop(lost)) * 100).otherwise(0.0),
        "m_skew": F.when(m >= 3, F.when(see(F.stddev_pop(r)) > 0, see(F.skewness(r)) * F.sqrt(m * (m - 1)) / (m - 2)).otherwise(0.0)),
        "m_autocorr": F.when(m >= 4, see.pearson(F.when(both, r), F.when(both, F.col("_pr")))),
        "m_efficiency": F.coalesce(ratio(close - see(F.max(F.when(F.col("_i") == 1, close))), see(F.sum(move))), F.lit(0.0)),
        "m_max_drawdown": see(F.min(pct("close", "_peak"))),
        "m_rebound": F.when(low > 0, pct(close, low)),
        "m_reversal": F.when(high > 0, pct(close, high)),
        "m_up_share": see(F.avg(F.when(r.isNotNull(), share(r > 0)))),
        "m_down_share": see(F.avg(F.when(r.isNotNull(), share(r < 0)))),
        "m_max_up_streak": F.coalesce(see(F.max(F.when(r > 0, F.col("_i") - F.coalesce("_not_up", F.lit(0))))), F.lit(0)),
        "m_max_down_streak": F.coalesce(see(F.max(F.when(r < 0, F.col("_i") - F.coalesce("_not_down", F.lit(0))))), F.lit(0)),
        "m_imbalance": F.when(total > 0, ratio(see(F.sum(F.signum(F.coalesce(r, F.lit(0.0))) * amount)), total)),
        "m_amihud": see(F.avg(ratio(F.abs(r), amount))) * 1e8,
        "m_concentration": F.coalesce(ratio(see(F.sum(amount * amount)), total * total), F.lit(0.0)),
        **{f"m_last{k}_share": F.coalesce(ratio(see.span(F.sum("amount"), 0, k), total), F.lit(0.0)) for k in (3, 5)},
        "m_acceleration": F.when(n >= 10, F.when(see.span(F.avg("amount"), 5, 10) > 0, ratio(see.span(F.avg("amount"), 0, 5), see.span(F.avg("amount"), 5, 10)))),
        "m_vwap_gap": pct(close, F.when(volume > 0, ratio(see(F.sum(close * F.col("vol"))), volume)).otherwise(see(F.avg("close")))),
        "m_close_position": F.when(high - low > 0, ratio(close - low, high - low)).otherwise(0.5),
        "m_upper_wick": see(F.avg(ratio(F.col("high") - F.greatest("open", "close"), F.abs("close")))) * 100,
        "m_lower_wick": see(F.avg(ratio(F.least("open", "close") - F.col("low"), F.abs("close")))) * 100,
        "m_high_breaks": see(F.sum(share(F.col("high") > F.col("_ph")))),
        "m_low_breaks": see(F.sum(share(F.col("low") < F.col("_pl")))),
        "m_last5_vs_prior5": F.when(n >= 11, (ratio(close, see.back("close", 5)) - ratio(see.back("close", 5), see.back("close", 10))) * 100),
        "m_latest_time": F.col("_ts"),
    }
    return _picked(session, aggs).drop(cutoff).na.fill(0, ["m_rows"])


def _gain(a, b) -> Column:
    """Percent return with 0 for anything undefined."""
    return F.coalesce(F.when(b > 0, pct(a, b)), F.lit(0.0))


@measured_once
def _segments(df, by, lunch, opening, late) -> DataFrame:
    """Segment flags, the return inside each segment, the running peak and the prior return."""
    order, clock = [F.col("_ts")], F.date_format("_ts", "HH:mm")
    df = df.withColumns(
        {"_am": clock <= lunch[0], "_pm": clock >= lunch[1], "_op": clock <= opening, "_late": clock >= late, "_r": F.coalesce("_r", F.lit(0.0))}
    )

    def build(w):
        out = {"_pr": F.lag("_r").over(w)}
        for s in ("am", "pm", "late"):
            inside = F.when(F.lag(f"_{s}").over(w), F.col("_r")).otherwise(0.0)
            out[f"_r_{s}"] = F.when(F.col(f"_{s}"), inside)
        return out

    df = nearby(df, by, order, build)
    return running(df, by, order, {"_peak": ("max", F.col("close"))})


def full_session_path(cands, bars, pk, by=("code", "day"), cutoff="cutoff", expected=None, min_coverage=0.9, max_bps=50.0, price="price", lunch=("11:30", "13:00"), opening="10:00", late="14:00", recent=30) -> DataFrame:
    """Path of the whole session up to the cutoff with completeness and price parity.

    ``expected`` names a column with the number of bars a complete path has. Missing
    statistics read 0, so the family is never NULL.
    """
    pk = list(pk)
    keep = [c for c in (price, expected) if c is not None]
    asks = cands.select(*dict.fromkeys([*pk, *keep, cutoff]))
    session = _segments(_numbered(_asked(_session(bars, list(by)), asks, list(by), cutoff), list(by)), list(by), lunch, opening, late)
    see = _Upto(list(by))
    r, amount, zero, close = F.col("_r"), F.col("amount"), F.lit(0.0), F.col("close")
    n, total = F.col("_i"), see(F.sum("amount"))
    vwap = F.when(total > 0, ratio(see(F.sum(close * amount)), total)).otherwise(see(F.avg("close")))
    first_open, hi, lo = see(F.max(F.when(F.col("_i") == 1, F.col("open")))), see(F.max("high")), see(F.min("low"))

    def inside(flag, value):
        return F.when(F.col(flag), value if isinstance(value, Column) else F.col(value))

    def seg_ret(flag):
        return _gain(see(F.max_by(inside(flag, "close"), inside(flag, "_i"))), see(F.min_by(inside(flag, "open"), inside(flag, "_i"))))

    def seg_imb(s):
        signed = see(F.sum(F.signum(F.col(f"_r_{s}")) * amount))
        return F.coalesce(ratio(signed, see(F.sum(inside(f"_{s}", "amount")))), zero)

    def dev(value, lo=0, hi=None):
        return F.when(see.span(F.count(value), lo, hi) >= 2, see.span(F.stddev_pop(value), lo, hi)).otherwise(zero)

    recent_sd = dev(r, 0, recent)
    prior_sd = F.when(n >= 2 * recent, dev(r, recent, 2 * recent)).otherwise(dev(r, recent))
    half = recent // 2
    amt_recent, amt_prior = see.span(F.sum("amount"), 0, half), F.when(n >= recent, see.span(F.sum("amount"), half, recent)).otherwise(zero)
    hi_at = see(F.min_by(F.col("_i"), F.struct(-F.col("high"), F.col("_i")))) - 1
    lo_at = see(F.min_by(F.col("_i"), F.struct(F.col("low"), F.col("_i")))) - 1
    span = F.greatest(n - 1, F.lit(1))
    both = F.when(F.col("_i") > 1, r)
    lagged = F.when(F.col("_i") > 1, F.col("_pr"))
    am, pm = seg_imb("am"), seg_imb("pm")
    am_close = see(F.max_by(inside("_am", "close"), inside("_am", "_i")))
    pm_open = see(F.min_by(inside("_pm", "open"), inside("_pm", "_i")))
    aggs = {
        "s_rows": n,
        "s_return": _gain(close, first_open),
        "s_opening_return": seg_ret("_op"),
        "s_morning_return": seg_ret("_am"),
        "s_afternoon_return": seg_ret("_pm"),
        "s_lunch_gap": _gain(pm_open, am_close),
        "s_late_return": seg_ret("_late"),
        "s_morning_range": _gain(see(F.max(inside("_am", "high"))), see(F.min(inside("_am", "low")))),
        "s_afternoon_range": _gain(see(F.max(inside("_pm", "high"))), see(F.min(inside("_pm", "low")))),
        "s_volatility": dev(r) * 100,
        "s_downside_volatility": dev(F.when(r < 0, r)) * 100,
        "s_efficiency": F.when(first_open > 0, F.coalesce(ratio(F.abs(ratio(close, first_open) - 1), see(F.sum(F.abs(r)))), zero)).otherwise(zero),
        "s_max_drawdown": see(F.min(pct("close", "_peak"))),
        "s_rebound": _gain(close, lo),
        "s_reversal": _gain(close, hi),
        "s_vwap_gap": _gain(close, vwap),
        "s_close_position": F.when(hi - lo > 0, clip(ratio(close - lo, hi - lo), 0.0, 1.0)).otherwise(0.5),
        "s_opening_share": F.coalesce(ratio(see(F.sum(inside("_op", "amount"))), total), zero),
        "s_morning_share": F.coalesce(ratio(see(F.sum(inside("_am", "amount"))), total), zero),
        "s_recent_share": F.coalesce(ratio(see.span(F.sum("amount"), 0, recent), total), zero),
        "s_acceleration": F.when(amt_prior > 0, ratio(amt_recent, amt_prior) - 1).otherwise(zero),
        "s_imbalance": F.coalesce(ratio(see(F.sum(F.signum(r) * amount)), total), zero),
        "s_morning_imbalance": am,
        "s_afternoon_imbalance": pm,
        "s_late_imbalance": seg_imb("late"),
        "s_flow_agreement": F.signum(am) * F.signum(pm),
        "s_price_amount_corr": F.when(n >= 3, F.coalesce(see.pearson(r, amount), zero)).otherwise(zero),
        "s_amihud": see(F.avg(F.coalesce(ratio(F.abs(r), amount), zero))) * 1e6,
        "s_high_time": ratio(hi_at, span),
        "s_low_time": ratio(lo_at, span),
        "s_since_high": ratio(n - 1 - hi_at, span),
        "s_since_low": ratio(n - 1 - lo_at, span),
        "s_zero_amount_share": see(F.avg(share(amount <= 0))),
        "s_autocorr": F.when(n >= 3, F.coalesce(see.pearson(both, lagged), zero)).otherwise(zero),
        "s_volatility_ratio": F.when(prior_sd > 0, ratio(recent_sd, prior_sd)).otherwise(zero),
        "s_last_close": close,
        "_vwap": vwap,
        "_closes": see(F.collect_list("close")),
    }
    # the one statistic that looks at earlier bars again: how many closed above what is known at the cutoff
    seen = bounded_array(F.col("_closes"), SESSION_BARS)
    above = F.try_divide(F.size(F.filter(seen, lambda x: x > F.col("_vwap"))), F.col("s_rows"))
    feats = _picked(session, aggs).withColumn("s_above_vwap_share", above).drop("_closes", "_vwap")
    names = [c for c in (*aggs, "s_above_vwap_share") if c not in ("s_last_close", "_vwap", "_closes")]
    out = feats.drop(cutoff).na.fill(0, names)
    checks = [F.col("s_rows") > 0, F.abs(ratio("s_last_close", price) - 1) * 10_000 <= max_bps]
    if expected is not None:
        out = out.withColumn("s_coverage", F.least(F.coalesce(ratio("s_rows", expected), F.lit(0.0)), F.lit(1.0)))
        checks.append(F.col("s_coverage") >= min_coverage)
    return out.withColumn("s_complete", all_of(checks))


def post_alert_confirmation(cands, bars, pk, by=("code", "day"), time="ts", delay="5 minutes", entry_delay="10 minutes", prior_n=20, expected=5, slippage_bps=10.0, max_bps=1.0, price="price", entry="entry_price") -> DataFrame:
    """Behaviour of (t, t + delay] after an alert against the bars before it."""
    pk, by = list(pk), list(by)
    b = bars.dropna(subset=by).select(*by, F.col(time).alias("_ts"), "high", "low", "close", F.greatest(F.col("amount"), F.lit(0.0)).alias("amount"))
    # what lies before an alert is a running value of the bars, what follows it a short range of them: no pairs are joined
    back = Window.partitionBy(*by).orderBy("_ts").rowsBetween(1 - prior_n, 0)
    b = b.withColumn("_pm", F.struct(F.avg("amount").over(back).alias("v")))
    c = cands.select(*pk, F.col(time).alias("_t"), F.col(price).alias("_p"), F.col(entry).alias("_e"))
    rows = b.select(*by, micros("_ts").alias("_o"), F.struct("_ts", "high", "low", "close", "amount").alias("_bar"), "_pm").unionByName(
        c.select(*by, micros("_t").alias("_o"), F.struct(*c.columns).alias("_row")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy("_o")
    rows = rows.withColumns({
        "_pm": F.last("_pm", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))["v"],
        "_near": F.collect_list("_bar").over(w.rangeBetween(0, interval_micros(cands.sparkSession, entry_delay))),
    }).where("_row IS NOT NULL").select(*by, *[f"_row.{k}" for k in c.columns if k not in by], "_pm", "_near")
    entry_bar = F.filter("_near", lambda x: x["_ts"] == F.expr(f"_t + interval {entry_delay}"))
    after = F.filter("_near", lambda x: (x["_ts"] > F.col("_t")) & (x["_ts"] <= F.expr(f"_t + interval {delay}")))
    rows = rows.withColumns({"_near": F.sort_array(after), "_en": F.size(entry_bar), "_ec": F.get(F.array_sort(entry_bar), F.lit(0))["close"]})

    def numbered(x, i):
        before = F.when(i > 0, F.get("_near", i - 1)["close"])
        return F.struct(x.alias("_b"), (i + 1).alias("_i"), F.size("_near").alias("_n"), F.coalesce(before, F.col("_p")).alias("_pc"))

    asked = ["_t", "_p", "_e", "_pm", "_en", "_ec"]
    df = rows.select(*pk, *asked, F.inline_outer(F.transform("_near", numbered))).select(*pk, *asked, "_b.*", "_i", "_n", "_pc")
    step = ratio("close", "_pc") - 1
    n, total = F.count("_ts"), F.sum("amount")
    close, hi, lo, p = _last("close"), F.max("high"), F.min("low"), F.max("_p")

    def ends(lo_i, hi_i):
        return F.avg(F.when((F.col("_i") >= lo_i) & (F.col("_i") <= hi_i), F.col("amount")))

    first_half = F.when(n >= 2, ends(F.lit(1), F.lit(2)))
    second_half = F.when(n >= 2, ends(F.col("_n") - 1, F.col("_n")))
    two_back = F.when(n >= 3, _last("close", 2)).when(n == 2, p)
    aggs = {
        "c_rows": n, "c_latest": F.max("_ts"), "c_public_price": close,
        "c_return": pct(close, p), "c_range": pct(hi, lo), "c_extension": pct(hi, p), "c_drawdown": pct(lo, p),
        "c_rebound": pct(close, lo), "c_reversal": pct(close, hi),
        "c_close_position": F.when(hi - lo > 0, ratio(close - lo, hi - lo)).otherwise(0.5),
        "c_vwap_gap": pct(close, F.when(total > 0, ratio(F.sum(F.col("close") * F.col("amount")), total)).otherwise(F.avg("close"))),
        "c_up_share": F.avg(share(step > 0)),
        "c_efficiency": F.coalesce(ratio(close - p, F.sum(F.abs(F.col("close") - F.col("_pc")))), F.lit(0.0)),
        "c_imbalance": F.when(total > 0, ratio(F.sum(F.signum(step) * F.col("amount")), total)),
        "_mean": F.avg("amount"),
        "c_acceleration": F.when(first_half > 0, ratio(second_half, first_half)),
        "c_last2_return": pct(close, two_back),
        "c_zero_amount_share": F.avg(share(F.col("amount") <= 0)),
    }
    # an alert without bars after it has no values, only their number
    out = df.groupBy(*pk).agg(*[F.max(k).alias(k) for k in asked if k != "_p"], *[(x if k == "c_rows" else F.when(n > 0, x)).alias(k) for k, x in aggs.items()])
    paid = F.col("_ec") * (1 + slippage_bps / 10_000)
    error = F.abs(ratio(paid, "_e") - 1) * 10_000
    out = out.withColumns({"c_amount_ratio": F.when(F.col("_pm") > 0, ratio("_mean", "_pm")), "c_entry_error_bps": error})
    names = [k for k in aggs if k.startswith("c_") and k not in ("c_rows", "c_latest")] + ["c_amount_ratio"]
    full = all_of([
        F.col("c_rows") == expected, F.col("c_latest") == F.expr(f"_t + interval {delay}"), F.col("_en") == 1,
        F.col("c_entry_error_bps") <= max_bps, *[F.col(k).isNotNull() for k in names],
    ])
    return out.withColumn("c_complete", full).drop("_t", "_e", "_mean", "_pm", "_en", "_ec")


# ---- pairs and derivatives -------------------------------------------------


def pair_spread_features(etf, fut, slots, keys, window=20) -> DataFrame:
    """Fund against future per (pair, day, slot): returns, spread, open interest, tracking.

    ``slots`` holds the keys and a ``cutoff`` stamp; both series need the keys but the
    slot, ``ts``, ``close`` and ``amount``, the future also ``oi``. Window returns reach
    ``window`` minutes back from the last visible bar, amount shares ``window`` bars.
    """
    keys = list(keys)
    by = [k for k in keys if k != "slot"]
    cuts = slots.select(*keys, F.col("cutoff").alias("_cut"))

    def upto(series, cols):
        return cuts.join(series.select(*by, F.col("ts").alias("_ts"), *cols), by).filter(F.col("_ts") <= F.col("_cut"))

    def side(series, cols, tag):
        df = group_values(upto(series, cols), keys, {"_end": F.max("_ts")})
        df = position(df, keys, [F.col("_ts").desc()], "_back")
        recent = F.when(F.col("_ts") >= F.expr(f"_end - interval {window} minutes"), F.col("_ts"))

        def recent_return(c):
            first = F.min_by(F.when(recent.isNotNull(), F.col(c)), recent)
            return F.when(F.count(recent) >= 2, pct(F.max_by(c, "_ts"), first)).otherwise(0.0)

        paid = F.greatest(F.coalesce(F.col("amount"), F.lit(0.0)), F.lit(0.0))
        aggs = {
            f"{tag}_return": pct(F.max_by("close", "_ts"), F.min_by("close", "_ts")),
            f"{tag}_return_w": recent_return("close"),
            f"{tag}_amount_share_w": F.coalesce(ratio(F.sum(F.when(F.col("_back") <= window, paid)), F.sum(paid)), F.lit(0.0)),
            f"{tag}_rows": F.count(F.lit(1)),
        }
        if "oi" in cols:
            aggs |= {"oi_change": pct(F.max_by("oi", "_ts"), F.min_by("oi", "_ts")), "oi_change_w": recent_return("oi")}
        return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])

    a = etf.select(*by, "ts", F.col("close").alias("_a"))
    b = fut.select(*by, "ts", F.col("close").alias("_b"))
    aligned = upto(a.join(b, [*by, "ts"]), ["_a", "_b"])
    aligned = nearby(aligned, keys, [F.col("_ts")], lambda w: {"_pa": F.lag("_a").over(w), "_pb": F.lag("_b").over(w)})
    aligned = aligned.withColumns({"_ra": ratio("_a", "_pa") - 1, "_rb": ratio("_b", "_pb") - 1})
    diff = (F.col("_rb") - F.col("_ra")) * 100
    rho = F.when(F.count(diff) >= 3, _pearson(F.col("_ra"), F.col("_rb")))
    track = aligned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("aligned_rows"), F.coalesce(F.stddev_pop(diff), F.lit(0.0)).alias("tracking_error"),
        F.coalesce(rho, F.lit(0.0)).alias("return_correlation"),
    ).filter("aligned_rows >= 2")
    out = side(etf, ["close", "amount"], "etf").join(side(fut, ["close", "amount", "oi"], "future"), keys).join(track, keys)
    return out.withColumns(
        {"hedge_spread": F.col("future_return") - F.col("etf_return"), "hedge_spread_w": F.col("future_return_w") - F.col("etf_return_w")}
    )


def cross_pair_features(df, by, pair, cols, differences, means) -> DataFrame:
    """Differences between named pairs, and mean and deviation over all of them.

    ``differences`` maps an output name to (column, pair, minus pair); all named pairs
    must be present or the row stays NULL.
    """
    named = sorted({p for _, a, b in differences.values() for p in (a, b)})
    values = {(c, p): F.max(F.when(F.col(pair) == p, F.col(c))).alias(f"_{c}_{p}") for c in cols for p in named}
    t = df.groupBy(*by).agg(
        *values.values(), F.countDistinct(F.when(F.col(pair).isin(*named), F.col(pair))).alias("_have"),
        *[F.avg(c).alias(f"{c}_mean") for c in means], *[F.stddev_pop(c).alias(f"{c}_std") for c in means],
    )
    full = F.col("_have") == len(named)
    out = {n: F.when(full, F.col(f"_{c}_{a}") - F.col(f"_{c}_{b}")) for n, (c, a, b) in differences.items()}
    out |= {f"{c}_{s}": F.when(full, F.col(f"{c}_{s}")) for c in means for s in ("mean", "std")}
    return t.withColumns(out).select(*by, *out)


def futures_daily_features(fut, index, mapping, family="family", day="day", code="contract", month="month") -> DataFrame:
    """Main-contract readings per (day, family): returns, basis, term spread, OI share.

    ``mapping`` names the day's main contract. The next term is the nearest later month.
    """
    mapping = unique_rows(mapping, [day, family], "mapping")
    f = nearby(fut, [day, family], [F.col(month)], lambda w: {"_next": F.lead("settle").over(w)}, back=0, ahead=1)
    f = group_values(f, [day, family], {"_oi": F.sum(F.greatest("oi", F.lit(0)))})
    main = f.join(mapping.select(day, family, F.col("main").alias(code)), [day, family, code])
    df = main.join(index.select(day, family, F.col("close").alias("_ic")), [day, family])
    return df.select(
        day, family, code,
        pct("close", "pre_settle").alias("close_return"), pct("settle", "pre_settle").alias("settle_return"),
        (ratio("oi_chg", F.col("oi") - F.col("oi_chg")) * 100).alias("oi_change"), ratio("vol", "oi").alias("volume_to_oi"),
        pct("settle", "_ic").alias("basis"), pct("_next", "settle").alias("next_term_spread"), ratio("oi", "_oi").alias("oi_share"),
    )


def options_daily_features(opt, by, spot="spot") -> DataFrame:
    """Chain readings per underlying: put/call ratios, at-the-money straddle, activity."""
    from .aggregates import atm_strike_pick, put_call_ratios, topn_concentration

    pc = put_call_ratios(opt, by, "side", ["vol", "oi", "amount"])
    atm = atm_strike_pick(opt, by, spot).select(*by, "straddle_pct", "premium_ratio")
    act = opt.groupBy(*by).agg(ratio(F.sum("vol"), F.sum("oi")).alias("volume_to_oi"))
    top = topn_concentration(opt, by, "oi", 5, "top5_oi_share")
    # a chain without a usable straddle carries no reading at all
    return atm.join(pc, list(by)).join(act, list(by)).join(top, list(by))


# ---- ranking snapshots -----------------------------------------------------


def snapshot_batch_pick(df, by, ts, code, window, min_codes=50) -> DataFrame:
    """Latest minute of the clock window; when it repeats a code, its latest clean batch."""
    clock = F.date_format(ts, "HH:mm")
    df = df.filter(clock.between(*window)).withColumn("_min", F.date_trunc("minute", F.col(ts)).cast("timestamp_ntz"))
    last = df.groupBy(*by).agg(F.max("_min").alias("_min"))
    df = df.join(last, [*by, "_min"], "left_semi")
    batches = df.groupBy(*by, ts).agg(F.count(F.lit(1)).alias("_b"), F.countDistinct(code).alias("_u"))
    clean = batches.filter((F.col("_u") >= min_codes) & (F.col("_b") == F.col("_u"))).groupBy(*by).agg(F.max(ts).alias("_exact"))
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(code).alias("_c"))
    pick = size.join(clean, by, "left").select(*by, F.when(F.col("_n") > F.col("_c"), F.col("_exact")).alias("_exact"))
    out = df.join(pick, by).filter(F.col("_exact").isNull() | (F.col(ts) == F.col("_exact")))
    how = F.when(F.col("_exact").isNull(), "minute_bucket").otherwise("latest_complete_exact_timestamp")
    return out.withColumn("batch_selection", how).drop("_exact", "_min")


@measured_once
def rank_regime_normalize(df, by, rank, score, tie, max_ordinal=2000.0) -> DataFrame:
    """Decide per batch whether ``rank`` is an ordinal or a legacy score; normalise to 1..n."""
    paired = F.col(rank).isNotNull() & F.col(score).isNotNull()
    df = df.withColumns({"_pr": F.when(paired, F.col(rank)), "_ps": F.when(paired, F.col(score))})
    df = average_ranks(df, by, {"_a": "_pr", "_b": "_ps"})
    # count(distinct) is not a window function: ties are counted by the first of each value
    df = position(df, by, [F.col(rank).desc_nulls_last(), F.col(tie)], "_first")
    df = nearby(df, by, [F.col("_first")], lambda w: {"_new": F.col(rank).isNotNull() & ~F.col(rank).eqNullSafe(F.lag(rank).over(w))})
    df = group_values(
        df, by,
        {
            "_n": F.count(F.lit(1)), "_known": F.count(rank), "_hot": F.count(score), "_distinct": F.sum(share(F.col("_new"))),
            "_min": F.min(rank), "_max": F.max(rank), "_pairs": F.count("_a"),
            "_cov": F.covar_pop("_a", "_b"), "_sa": F.stddev_pop("_a"), "_sb": F.stddev_pop("_b"),
        },
    )
    n = F.col("_n")
    dense = (F.col("_known") / n >= 0.95) & (F.col("_distinct") / n >= 0.95)
    rho = F.when(F.col("_pairs") >= 3, ratio("_cov", F.col("_sa") * F.col("_sb")))
    ordinal = holds(dense & F.col("_min").isin(0.0, 1.0) & (F.col("_max") <= max_ordinal))
    legacy = holds(dense & (F.col("_min") > max_ordinal) & (F.col("_hot") / n >= 0.95) & (rho >= 0.99))
    value = F.when(ordinal, F.col(rank) - F.col("_min") + 1).when(legacy & F.col(rank).isNotNull(), F.col("_first"))
    regime = F.when(ordinal, "ordinal_zero_or_one_based").when(legacy, "legacy_hot_score_descending").otherwise("unusable")
    out = df.withColumns({"normalized_rank": value.cast("double"), "regime": regime})
    return out.drop(*[c for c in out.columns if c.startswith("_")])


# ---- masks and leaders -----------------------------------------------------


def previous_limit_flags(daily, limits, cands, calendar, tick=0.005, on=("code",)) -> DataFrame:
    """Whether the stock closed at or touched its up limit on the previous open day."""
    from .joins import prev_period_join

    keys = [*on, "day"]
    daily = unique_rows(daily, keys, "daily")
    limits = unique_rows(limits, keys, "limits")
    bound = F.col("up_limit")
    flags = daily.join(limits.select(*keys, "up_limit"), keys).select(
        *keys, holds((bound > 0) & (F.col("close") >= bound - tick)).alias("prev_closed_limit"),
        holds((bound > 0) & (F.col("high") >= bound - tick)).alias("prev_touched_limit"),
    )
    return prev_period_join(cands, flags, calendar, list(on)).na.fill(False, ["prev_closed_limit", "prev_touched_limit"])


def momentum_overlay_mask(df, slot="14:20", min_ret=7.0, prior_flag="prev_closed_limit", ret="ret", eligible=None, out="overlay") -> DataFrame:
    conds = [F.col("slot") == slot, F.col(ret) > min_ret, ~holds(F.col(prior_flag))]
    return df.withColumn(out, all_of(conds + ([F.col(eligible)] if eligible else [])))


def specialist_masks(df, masks: dict[str, Column], pk) -> DataFrame:
    """Sub-population membership in long form: one row per (identity, specialist) it fits."""
    hits = F.array_compact(F.array(*[F.when(holds(c), F.lit(n)) for n, c in masks.items()]))
    return df.select(*pk, F.explode(hits).alias("specialist"))


# fixed values: the six sub-populations of the reference contract, on panel columns
def default_masks() -> dict[str, Column]:
    c = F.col
    return {
        "early_structure": c("slot").isin("14:20", "14:25", "14:30", "14:35"),
        "late_confirmation": c("slot").isin("14:40", "14:45", "14:50"),
        "market_industry_leader": (c("relative_market") > 0) & (c("relative_industry") > 0) & (c("ret_rank") >= 0.60),
        "trend_persistence": (c("trend_slope") > 0) & (c("efficiency") >= 0.15) & (c("close_position") >= 0.55),
        "pullback_recovery": (c("max_drawdown") <= -0.50) & (c("rebound") >= 0.50) & (c("ret_1") > 0),
        "liquidity_breakout": (c("acceleration") > 0) & (c("confirmation") > 0) & (c("amount_rank") >= 0.60),
    }


@measured_once
def market_slot_leader(df, cs, eligible, order, score, cols) -> DataFrame:
    """Best eligible row of each slot with medians of the whole eligible cross-section."""
    ok = df.filter(holds(eligible))
    aggs: dict = {f"market_{c}_median": ("quantile", c, 0.5) for c in cols}
    aggs |= {"market_size": F.count(F.lit(1)), "score_median": ("quantile", score, 0.5), "score_std": F.stddev_samp(score)}
    ok = group_values(ok, cs, aggs)
    top = best_rows(ok, cs, order, 2)
    top = position(top, cs, order, "_r", bound=2)
    top = group_values(top, cs, {"_second": F.max(F.when(F.col("_r") == 2, F.col(score)))}, bound=2)
    return top.filter("_r = 1").withColumns(
        {
            "leader_margin": F.coalesce(F.col(score) - F.col("_second"), F.lit(0.0)),
            "leader_gap_to_median": F.col(score) - F.col("score_median"),
            "score_std": F.coalesce("score_std", F.lit(0.0)),
        }
    ).drop("_r", "_second")


