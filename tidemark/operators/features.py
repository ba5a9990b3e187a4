"""Candidate feature families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import all_of, clip, holds, log1p_floor, pct, ratio, share, signed_log
from .aggregates import basket_rollup
from .joins import lookback_join, prev_period_join, unique_rows, shifted_days
from .spread import best_rows, group_values, measured_once, position, tie_ranks


def basket_regime_frame(df, cs, eligible, order, n, min_n, **spec) -> DataFrame:
    """Top-n eligible basket of each cross-section as one row of features and labels."""
    basket = best_rows(df.filter(holds(eligible)), cs, order, n)
    ranked = position(basket, cs, order, "_rank", bound=n)
    return basket_rollup(ranked, cs, min_members=min_n, n=n, **spec)


# ---- price expressions -----------------------------------------------------


def total_return_price(df, price, f0, f1, out) -> DataFrame:
    """Price carried to another day's basis; NULL unless both factors are positive."""
    good = (F.col(f0) > 0) & (F.col(f1) > 0)
    return df.withColumn(out, F.when(good, F.col(price) * F.col(f1) / F.col(f0)))


def slot_price_features(df, price="price", prev="prev_close", opened="day_open", up="up_limit", down="down_limit") -> DataFrame:
    return df.withColumns(
        {
            "ret_from_prev_close": pct(price, prev),
            "ret_from_open": pct(price, opened),
            "gap_open": pct(opened, prev),
            "distance_to_up_limit": pct(up, price),
            "distance_to_down_limit": pct(price, down),
        }
    )


def _floor(name, least):
    return clip(F.abs(F.col(name)), lo=least)


def feature_interactions(df) -> DataFrame:
    """Fifteen interactions; the weights and floors are fixed values."""
    c = F.col
    rm, ri = c("relative_market"), c("relative_industry")
    return df.withColumns(
        {
            "momentum_reversal": c("prev_5d_return") - c("prev_20d_return"),
            "volatility_adjusted_momentum": ratio("prev_5d_return", _floor("prev_20d_volatility", 0.25)),
            "liquidity_acceleration": c("tail_amount_ratio") - c("prev_5d_amount_ratio"),
            "volume_price_confirmation": c("ret_20m") * log1p_floor("amount_acceleration"),
            "limit_asymmetry": c("dist_down") - c("dist_up"),
            "market_strength": 0.45 * c("market_return") + 2.0 * (c("market_breadth") - 0.5)
            + 0.35 * c("market_tail_return") + 1.0 * (c("market_tail_breadth") - 0.5),
            "industry_strength": 0.55 * c("industry_return") + 1.5 * (c("industry_breadth") - 0.5)
            + 0.45 * c("industry_tail_return") + 0.75 * (c("industry_tail_breadth") - 0.5),
            "relative_alignment": F.signum(rm) * F.signum(ri) * F.sqrt(F.abs(rm) * F.abs(ri)),
            "trend_quality": c("directional_efficiency") * clip("trend_r2", 0.0, 1.0) * c("trend_slope"),
            "reversal_pressure": c("path_rebound") + c("bar_lower_wick") - c("bar_upper_wick"),
            "breakout_pressure": (c("path_close_position") - 0.5) * c("path_range"),
            "overnight_alignment": c("gap") * c("ret_open"),
            "risk_adjusted_tail": ratio("ret_20m", _floor("realized_volatility", 0.05)),
            "dispersion_adjusted": ratio("relative_market", _floor("market_dispersion", 0.10)),
            "industry_dispersion": ri - rm,
        }
    )


def log_and_ratio_features(df, logs: dict, ratios: dict, diffs: dict) -> DataFrame:
    """``{out: source}`` logs of floored values, ``{out: (a, b)}`` ratios and differences."""
    return df.withColumns(
        {
            **{out: log1p_floor(c) for out, c in logs.items()},
            **{out: ratio(a, b) for out, (a, b) in ratios.items()},
            **{out: F.col(a) - F.col(b) for out, (a, b) in diffs.items()},
        }
    )


def price_parity(df, a, b, max_bps, out="parity_ok") -> DataFrame:
    return df.withColumns(
        {f"{out}_bps": F.abs(ratio(a, b) - 1) * 10_000, out: holds(F.abs(ratio(a, b) - 1) * 10_000 <= max_bps)}
    )


# ---- auction, flow, positioning -------------------------------------------


def auction_features(cands, auction, on=("code", "day"), price="price", ret="ret") -> DataFrame:
    """Opening-auction shape against the previous close implied by price and return."""
    auction = unique_rows(auction, list(on), "auction")
    a = auction.select(*on, *[F.col(c).alias(f"_a_{c}") for c in ("open", "high", "low", "close", "vwap", "amount", "vol")])
    df = cands.join(a, list(on), "left")
    c = {n: F.col(f"_a_{n}") for n in ("open", "high", "low", "close", "vwap", "amount", "vol")}
    prior = ratio(price, 1 + F.col(ret) / 100)
    return df.withColumns(
        {
            "auction_gap": pct(c["open"], prior),
            "auction_return": pct(c["close"], c["open"]),
            "auction_range": pct(c["high"], c["low"]),
            "auction_close_position": ratio(c["close"] - c["low"], c["high"] - c["low"]),
            "auction_vwap_gap": pct(c["close"], c["vwap"]),
            "auction_amount_log": log1p_floor(c["amount"]),
            "auction_volume_log": log1p_floor(c["vol"]),
            "auction_available": all_of([c["close"] > 0, c["open"] > 0, c["high"] >= c["low"], c["amount"] >= 0]),
        }
    ).drop(*[f"_a_{n}" for n in c])


def moneyflow_shares(cands, flow, calendar, on=("code",), sizes=("sm", "lg"), large=("lg",), small="sm", net="net_flow") -> DataFrame:
    """Previous open day's signed flow by order size over gross flow."""
    flow = unique_rows(flow, [*on, "day"], "flow")
    df = prev_period_join(cands, flow, calendar, list(on))
    gross = sum((F.abs(F.col(f"{side}_{s}")) for s in sizes for side in ("buy", "sell")), F.lit(0.0))
    diff = {s: F.col(f"buy_{s}") - F.col(f"sell_{s}") for s in sizes}
    big = sum((diff[s] for s in large), F.lit(0.0))
    out = {
        "flow_net_share": ratio(F.col(net), gross),
        "flow_large_share": ratio(big, gross),
        "flow_small_share": ratio(diff[small], gross),
        "flow_spread": ratio(big - diff[small], gross),
        "flow_gross_log": log1p_floor(gross),
        "flow_available": holds(gross > 0) & F.col(net).isNotNull(),
    }
    out |= {f"flow_{s}_share": ratio(diff[s], gross) for s in sizes if s not in large and s != small}
    return df.withColumns(out)


LADDER = ("his_low", "cost_5", "cost_15", "cost_50", "cost_85", "cost_95", "his_high")


def cost_distribution_features(cands, cost, calendar, on=("code",), price="price") -> DataFrame:
    """Position of the price inside the previous day's holder-cost ladder.

    A ladder counts when complete, non-decreasing and with a sane average and winner rate.
    """
    cost = unique_rows(cost, [*on, "day"], "cost")
    steps = [F.col(b) >= F.col(a) for a, b in zip(LADDER, LADDER[1:])]
    checked = cost.withColumn("_ok", all_of([*steps, F.col("weight_avg") > 0, F.col("winner_rate").between(0, 100)]))
    df = prev_period_join(cands, checked, calendar, list(on))
    ok, p, w = holds(F.col("_ok")), F.col(price), F.col("weight_avg")
    c5, c15, c85, c95 = (F.col(f"cost_{k}") for k in (5, 15, 85, 95))
    feats = {
        "cost_winner_rate": F.col("winner_rate"),
        "cost_vs_average": pct(p, w),
        "cost_vs_50": pct(p, "cost_50"),
        "cost_vs_85": pct(p, c85),
        "cost_vs_95": pct(p, c95),
        "cost_width_90": ratio(c95 - c5, w) * 100,
        "cost_width_70": ratio(c85 - c15, w) * 100,
        "cost_position_90": clip(ratio(p - c5, c95 - c5), -2.0, 3.0),
        "cost_overhang_85": ratio(clip(c85 - p, lo=0.0), p) * 100,
        "cost_cushion": ratio(clip(p - w, lo=0.0), p) * 100,
    }
    return df.withColumns({**{n: F.when(ok, c) for n, c in feats.items()}, "cost_available": ok}).drop(
        "_ok", "weight_avg", "winner_rate", *LADDER
    )


def margin_features(cands, margin, calendar, on=("code",)) -> DataFrame:
    """Financing and short balances of T-1, their flows and change from T-2."""
    fields = ("fin_balance", "short_balance", "total_balance", "fin_buy", "fin_repay", "short_sell", "short_repay")
    margin = unique_rows(margin, [*on, "day"], "margin")
    now = margin.select(*on, "day", *[F.col(f).alias(f"_n_{f}") for f in fields])
    old = margin.select(*on, "day", *[F.col(f).alias(f"_o_{f}") for f in fields[:2]])
    df = prev_period_join(cands, now, calendar, list(on)).drop("source_day")
    df = prev_period_join(df, old, calendar, list(on), lag=2).drop("source_day")
    n = {f: F.col(f"_n_{f}") for f in fields}
    ok = n["fin_balance"].isNotNull() & n["total_balance"].isNotNull()

    def flow(a, b):
        return ratio(a - b, F.abs(a) + F.abs(b))

    feats = {
        "margin_fin_log": log1p_floor(n["fin_balance"]),
        "margin_short_log": log1p_floor(n["short_balance"]),
        "margin_total_log": log1p_floor(n["total_balance"]),
        "margin_fin_flow": flow(n["fin_buy"], n["fin_repay"]),
        "margin_short_flow": flow(n["short_sell"], n["short_repay"]),
        "margin_fin_change": pct(n["fin_balance"], "_o_fin_balance"),
        "margin_short_change": pct(n["short_balance"], "_o_short_balance"),
        "margin_short_to_fin": clip(ratio(n["short_balance"], n["fin_balance"]), 0.0, 10.0),
    }
    return df.withColumns({**{k: F.when(ok, c) for k, c in feats.items()}, "margin_available": ok}).drop(
        *[f"_n_{f}" for f in fields], "_o_fin_balance", "_o_short_balance"
    )


def dealer_list_features(cands, rollup, calendar, on=("code",)) -> DataFrame:
    """Previous day's dealer list; absent means zero."""
    df = prev_period_join(cands, rollup, calendar, list(on))
    v = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("entries", "reasons", "net", "buy", "sell", "amount", "rate_max")}
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "dealer_flag": v["entries"] > 0,
            "dealer_entries": v["entries"],
            "dealer_reasons": v["reasons"],
            "dealer_net_log": signed_log(v["net"]),
            "dealer_net_ratio": clip(F.coalesce(ratio(v["net"], v["amount"]), zero), -5.0, 5.0),
            "dealer_buy_sell": clip(F.coalesce(ratio(v["buy"], v["sell"]), zero), 0.0, 20.0),
            "dealer_rate_max": v["rate_max"],
        }
    )


# ---- peers -----------------------------------------------------------------


def peer_slot_frame(bars, preclose, membership, offset="20 minutes", by="code", time="ts") -> DataFrame:
    """Slot bars with previous close, the close ``offset`` earlier and the day's groups."""
    past = bars.select(by, F.expr(f"{time} + interval {offset}").alias(time), F.col("close").alias("close_before"))
    df = bars.join(past, [by, time], "left").join(preclose, [by, "day"], "left").join(membership, [by, "day"], "left")
    return df.withColumns({"ret": pct("close", "pre_close"), "tail_ret": pct("close", "close_before")})


def _without_self(df, group, value, qs, code, tag):
    """Order statistics of the group without the row itself.

    Dropping rank r from the sorted values shifts the later ones by one, so a quantile of
    the others is always one of a few fixed ranks of the whole group. Those are read once
    per group; nothing is collected or joined pair by pair.
    """
    v = F.col(value)
    df = position(df, group, [v.asc_nulls_last(), F.col(code)], f"_{tag}r")
    df = group_values(df, group, {f"_{tag}n": F.count(value)})
    rank, n = F.col(f"_{tag}r") - 1, F.col(f"_{tag}n")
    own = v.isNotNull()
    m = n - own.cast("int")

    def at(k):
        return F.max(F.when(rank == k, v))

    # ranks of the full group that a quantile over n - 1 or n values can touch
    picks = {}
    for i, q in enumerate(qs):
        lo, whole = F.floor((n - 2) * F.lit(q)), F.floor((n - 1) * F.lit(q))
        for j in range(3):
            picks[f"_{tag}p{i}_{j}"] = at(lo + j)
        for j in range(2):
            picks[f"_{tag}w{i}_{j}"] = at(whole + j)
    picks |= {f"_{tag}top": F.max(v), f"_{tag}second": at(n - 2)}
    df = group_values(df, group, picks)
    out = {}
    for i, q in enumerate(qs):
        at_q = (m - 1) * F.lit(q)
        k = F.floor(at_q)
        frac = at_q - k

        def kth(j, i=i, k=k):
            skipped = F.when(k + j < rank, F.col(f"_{tag}p{i}_{j}")).otherwise(F.col(f"_{tag}p{i}_{j + 1}"))
            return F.when(own, skipped).otherwise(F.col(f"_{tag}w{i}_{j}"))

        value_q = F.when(frac == 0, kth(0)).otherwise(kth(0) + (kth(1) - kth(0)) * frac)
        out[f"{tag}_q{int(q * 100)}"] = F.when(m > 0, value_q)
    out[f"{tag}_max"] = F.when(m > 0, F.when(own & (rank == n - 1), F.col(f"_{tag}second")).otherwise(F.col(f"_{tag}top")))
    out[f"{tag}_count"] = m
    return df.withColumns(out).drop(*picks, f"_{tag}r")


@measured_once
def loo_peer_features(universe, cands, cs, group, code, ret="ret", tail="tail_ret", amount="amount", prefix="peer") -> DataFrame:
    """Twenty statistics of a candidate's group without the candidate."""
    g, keys = [*cs, group], [*cs, code]
    u = universe.select(*cs, group, code, ret, tail, amount)
    u = u.withColumns({"_la": F.when(F.col(amount) >= 0, F.log1p(F.col(amount))), "_known": F.col(group).isNotNull()})
    u = _without_self(u, g, ret, (0.25, 0.5, 0.75), code, "r")
    u = tie_ranks(u, g, F.col(ret), "_tie_")
    u = _without_self(u, g, tail, (0.5, 0.75), code, "t")
    u = _without_self(u, g, "_la", (0.5,), code, "a")
    u = group_values(u, g, {"_mean": F.avg(ret), "_size": F.count(F.lit(1))})
    u = u.withColumn("_c", F.col(ret) - F.col("_mean"))
    shares = {"positive": (ret, 0.0), "above_2": (ret, 2.0), "above_5": (ret, 5.0), "above_7": (ret, 7.0), "tail_positive": (tail, 0.0)}
    sums = {f"_s_{n}": F.sum(share(F.col(c) > x)) for n, (c, x) in shares.items()}
    u = group_values(u, g, {**sums, "_cc": F.sum(F.col("_c") * F.col("_c"))})
    own_c = F.coalesce(F.col("_c"), F.lit(0.0))
    m = F.col("r_count")
    spread_sum = -own_c
    var = ratio(F.col("_cc") - own_c * own_c, m) - ratio(spread_sum, m) * ratio(spread_sum, m)
    out = {
        "count": F.col("_size") - 1,
        "return_count": m,
        "return_median": F.col("r_q50"),
        "return_mean": F.col("_mean") + ratio(spread_sum, m),
        "return_q75": F.col("r_q75"),
        "return_iqr": F.col("r_q75") - F.col("r_q25"),
        "return_dispersion": F.when(m == 1, 0.0).when(m > 1, F.sqrt(clip(var, lo=0.0))),
        "return_max": F.col("r_max"),
        "tail_median": F.col("t_q50"),
        "tail_q75": F.col("t_q75"),
        "own_excess": F.col(ret) - F.col("r_q50"),
        "own_gap_to_q75": F.col(ret) - F.col("r_q75"),
        "own_gap_to_max": F.col(ret) - F.col("r_max"),
        "own_percentile": ratio(F.col("_tie_hi") - 1, m),
        "own_log_amount_excess": F.col("_la") - F.col("a_q50"),
    }
    for n, (c, x) in shares.items():
        k = F.col("t_count") if c == tail else m
        out[f"{n}_share"] = ratio(F.col(f"_s_{n}") - share(F.col(c) > x), k)
    known = F.col("_known")
    zero = ("count", "return_count")
    wide = u.select(
        *keys, *[(F.when(known, e).otherwise(0) if n in zero else F.when(known, e)).alias(f"{prefix}_{n}") for n, e in out.items()]
    )
    found = cands.select(*keys).distinct().join(wide, keys, "left")
    return found.na.fill(0, [f"{prefix}_{n}" for n in zero])


def hierarchical_shrinkage(df, metrics, fine="fine", coarse="coarse", pseudo=6.0, least_fine=2, least_coarse=4) -> DataFrame:
    """Blend fine-group and coarse-group statistics; a thin fine group leans on the coarse."""
    nf = F.greatest(F.coalesce(F.col(f"{fine}_count").cast("double"), F.lit(0.0)), F.lit(0.0))
    nc = F.greatest(F.coalesce(F.col(f"{coarse}_count").cast("double"), F.lit(0.0)), F.lit(0.0))
    raw = nf / (nf + F.lit(float(pseudo)))

    def flag(c):
        return c.cast("double")

    out = {
        "log_coarse_count": F.log1p(nc), "log_fine_count": F.log1p(nf),
        "coarse_available": flag(nc > 0), "fine_available": flag(nf > 0),
        "any_available": flag((nc > 0) | (nf > 0)), "no_context": flag(~((nc > 0) | (nf > 0))),
        "coarse_shallow": flag(nc < least_coarse), "fine_shallow": flag(nf < least_fine),
        "fine_weight": F.when((nc > 0) & (nf > 0), raw).otherwise(flag(nf > 0)),
        "fine_share": F.coalesce(clip(ratio(nf, nc), 0.0, 1.0), F.lit(0.0)),
    }
    for m in metrics:
        a, b = F.col(f"{fine}_{m}"), F.col(f"{coarse}_{m}")
        out[f"shrunk_{m}"] = F.coalesce(raw * a + (1 - raw) * b, a, b, F.lit(0.0))
    return df.withColumns(out)


# ---- event tape ------------------------------------------------------------


def _slot_flags(first, slots, recent, time_cols):
    """Stock-day event times once per slot, with seen-so-far and recent flags."""
    spec = F.array(*[F.lit(s) for s in slots])
    df = first.withColumn("slot", F.explode(spec))
    cutoff = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.col("slot")), F.lit("yyyy-MM-dd HH:mm"))
    df = df.withColumn("cutoff", cutoff)
    lower = F.expr(f"cutoff - interval {recent}")
    flags = {n: share(F.col(c) <= F.col("cutoff")).cast("int") for n, c in time_cols.items()}
    flags |= {f"{n}_recent": share((F.col(c) > lower) & (F.col(c) <= F.col("cutoff"))).cast("int") for n, c in time_cols.items() if n != "down"}
    return df.withColumns(flags)


TIMES = {"touch": "first_touch", "open": "first_open", "down": "first_down"}


def causal_event_projection(first, slots, recent="10 minutes") -> DataFrame:
    """Market counts per (day, slot) of events up to the cutoff and in the recent window."""
    flags = _slot_flags(first, slots, recent, TIMES)
    names = ["touch", "open", "down", "touch_recent", "open_recent"]
    out = flags.groupBy("day", "slot").agg(*[F.sum(n).alias(f"{n}_count") for n in names])
    return out.withColumns(
        {
            "net_sealed": F.greatest(F.col("touch_count") - F.col("open_count"), F.lit(0)),
            "open_to_touch": F.coalesce(ratio("open_count", "touch_count"), F.lit(0.0)),
        }
    )


def candidate_event_state(cands, first, projection) -> DataFrame:
    """Own event state before the cutoff with the market projection."""
    df = cands.select("day", "slot", "code").join(first, ["day", "code"], "left").join(projection, ["day", "slot"], "left")
    cutoff = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.col("slot")), F.lit("yyyy-MM-dd HH:mm"))
    df = df.withColumn("_cut", cutoff)
    out = {}
    for n, c in TIMES.items():
        seen = holds(F.col(c) <= F.col("_cut"))
        out[f"own_{n}"] = seen
        if n != "down":
            out[f"minutes_since_{n}"] = F.when(seen, F.timestamp_diff("MICROSECOND", F.col(c), F.col("_cut")) / 60e6)
    return df.withColumns(out).drop("_cut", *TIMES.values())


def event_presence(cands, events, calendar, k, sources, by="code") -> DataFrame:
    """Whether each source had any event in the k previous open days.

    Events are reduced to distinct (code, day, source) before they are spread over days.
    """
    targets = cands.select(by, "day").distinct()
    seen = lookback_join(targets, events.select(by, "day", "source").distinct(), calendar, [by], k)
    flags = seen.groupBy(by, "day").agg(*[F.max(F.col("source") == s).alias(f"has_{s}") for s in sources])
    return cands.join(flags, [by, "day"], "left").na.fill(False, [f"has_{s}" for s in sources])


def weighted_mean(value, weight) -> Column:
    """Weighted mean, the plain mean when no weight is positive."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.greatest(F.coalesce(F.col(weight) if isinstance(weight, str) else weight, F.lit(0.0)), F.lit(0.0))
    w = F.when(v.isNotNull(), w)
    return F.when(F.sum(w) > 0, F.try_divide(F.sum(v * w), F.sum(w))).otherwise(F.avg(v))


def weighted_mean_fallback(df, by, value, weight, out="weighted_mean") -> DataFrame:
    return df.groupBy(*by).agg(weighted_mean(value, weight).alias(out))


def event_window_features(cands, events, calendar, k, aggs: dict[str, dict], by="code") -> DataFrame:
    """Per source over the k previous open days: count, active, latest age and its own sums.

    ``aggs[source]`` maps an output name to a function of a masking helper, which turns a
    column into that source's values only; all sources share one conditional aggregation.
    """
    targets = cands.select(by, "day").distinct()
    seen = lookback_join(targets, events, calendar, [by], k)
    exprs = []
    for s, extra in aggs.items():
        def only(c, s=s):
            return F.when(F.col("source") == s, F.col(c) if isinstance(c, str) else c)

        exprs += [F.count(only("age")).alias(f"{s}_count"), F.min(only("age")).alias(f"{s}_latest_age")]
        exprs += [build(only).alias(f"{s}_{n}") for n, build in extra.items()]
    feats = seen.groupBy(by, "day").agg(*exprs)
    out = cands.join(feats, [by, "day"], "left").na.fill(0, [f"{s}_count" for s in aggs])
    return out.withColumns({f"{s}_active": (F.col(f"{s}_count") > 0).cast("int") for s in aggs})


def event_ecology(cands, first, membership, calendar, slots, levels=("fine", "coarse"), recent="10 minutes") -> DataFrame:
    """Same-group event counts without the own event, now and on the previous open day."""
    grouped = first.join(membership, "code", "left")
    flags = _slot_flags(grouped, slots, recent, TIMES)
    names = ["touch", "open", "down", "touch_recent", "open_recent"]
    own = flags.select("day", "slot", "code", *[F.col(n).alias(f"_own_{n}") for n in names])
    df = cands.select("day", "slot", "code").join(membership, "code", "left").join(own, ["day", "slot", "code"], "left")
    market = flags.groupBy("day", "slot").agg(F.sum("touch").alias("market_touch"))
    df = df.join(market, ["day", "slot"], "left").na.fill(0, ["market_touch"])
    whole = grouped.withColumns({n: F.col(c).isNotNull().cast("int") for n, c in TIMES.items()})
    before = shifted_days(calendar, 1, "day", "prev_day")
    df = df.join(before, "day", "left")
    own_prev = whole.select(
        F.col("day").alias("prev_day"), "code", *[F.col(n).alias(f"_prev_{n}") for n in TIMES], *[F.col(lv).alias(f"_prev_{lv}") for lv in levels]
    )
    df = df.join(own_prev, ["prev_day", "code"], "left")

    def less(total, mine):
        return F.greatest(F.coalesce(total, F.lit(0)) - F.coalesce(mine, F.lit(0)), F.lit(0))

    def rate(a, b):
        return F.coalesce(ratio(a, b), F.lit(0.0))

    for lv in levels:
        now = flags.groupBy("day", "slot", lv).agg(*[F.sum(n).alias(f"_g_{n}") for n in names])
        past = whole.groupBy(F.col("day").alias("prev_day"), lv).agg(*[F.sum(n).alias(f"_p_{n}") for n in TIMES])
        size = membership.groupBy(lv).agg(F.countDistinct("code").alias("_members"))
        df = df.join(now, ["day", "slot", lv], "left").join(past, ["prev_day", lv], "left").join(size, lv, "left")
        same = holds(F.col(f"_prev_{lv}") == F.col(lv))
        cols = {f"{lv}_{n}": less(F.col(f"_g_{n}"), F.col(f"_own_{n}")) for n in names}
        cols |= {f"prev_{lv}_{n}": less(F.col(f"_p_{n}"), F.when(same, F.col(f"_prev_{n}"))) for n in TIMES}
        cols[f"{lv}_members"] = less(F.col("_members"), F.col(lv).isNotNull().cast("int"))
        df = df.withColumns(cols).drop("_members", *[f"_g_{n}" for n in names], *[f"_p_{n}" for n in TIMES])
        hit, opened = F.col(f"{lv}_touch"), F.col(f"{lv}_open")
        df = df.withColumns(
            {
                f"{lv}_net_sealed": F.greatest(hit - opened, F.lit(0)),
                f"{lv}_touch_rate": rate(hit, F.col(f"{lv}_members")),
                f"{lv}_down_rate": rate(F.col(f"{lv}_down"), F.col(f"{lv}_members")),
                f"{lv}_open_to_touch": rate(opened, hit),
                f"{lv}_market_share": rate(hit, F.col("market_touch")),
                f"{lv}_active": (hit > 0).cast("int"),
                f"prev_{lv}_touch_rate": rate(F.col(f"prev_{lv}_touch"), F.col(f"{lv}_members")),
                f"prev_{lv}_active": (F.col(f"prev_{lv}_touch") > 0).cast("int"),
            }
        )
    return df.drop(*[c for c in df.columns if c.startswith("_")])
