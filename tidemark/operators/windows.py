"""Lagged, rolling, expanding and cross-section window operators.

Names: ``key`` groups a history, ``order`` sorts it (total order), ``cs`` is a
cross-section. Percent outputs are in percent points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clip, pct, ratio, safe_ln, share
from . import radix
from .spread import (
    CALENDAR,
    calendar_rows,
    group_values,
    measured_once,
    nearby,
    percentile_rank,
    percentile_ranks,
    position,
    running,
)


def _cols(order):
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _guard(value, seen, least):
    return F.when(seen >= least, value)


# ---- own history -----------------------------------------------------------


@measured_once
def lagged_returns(df, key, order, price, ks=(1, 2, 3, 5, 10, 20), shift=1) -> DataFrame:
    def build(w):
        return {f"ret_{k}": pct(F.lag(price, shift).over(w), F.lag(price, k + shift).over(w)) for k in ks}

    return nearby(df, key, _cols(order), build, back=max(ks) + shift)


@measured_once
def rolling_positive_share(df, key, order, ret, windows=(5, 10, 20), mins=(3, 7, 15)) -> DataFrame:
    """Share of positive returns; a missing return counts as not positive."""

    def build(w):
        out = {}
        for n, least in zip(windows, mins):
            frame = w.rowsBetween(1 - n, 0)
            rows = F.count(F.lit(1)).over(frame)
            out[f"positive_share_{n}"] = _guard(F.avg(share(F.col(ret) > 0)).over(frame), rows, least)
        return out

    return nearby(df, key, _cols(order), build, back=max(windows) - 1)


@measured_once
def rolling_volatility(df, key, order, ret, n=20, min_n=15, downside=False, out="volatility") -> DataFrame:
    """Sample deviation; the downside form sets non-negative and missing returns to 0."""
    value = F.when(F.col(ret) < 0, F.col(ret)).otherwise(0.0) if downside else F.col(ret)

    def build(w):
        frame = w.rowsBetween(1 - n, 0)
        return {out: _guard(F.stddev_samp(value).over(frame), F.count(value).over(frame), min_n)}

    return nearby(df, key, _cols(order), build, back=n - 1)


@measured_once
def rolling_drawdown(df, key, order, price, n=20, min_n=15, out="drawdown") -> DataFrame:
    """Prior price against the highest of the n prior prices."""

    df = nearby(df, key, _cols(order), lambda w: {"_prior": F.lag(price).over(w)})

    def build(w):
        frame = w.rowsBetween(1 - n, 0)
        top = _guard(F.max("_prior").over(frame), F.count("_prior").over(frame), min_n)
        return {out: pct("_prior", top)}

    return nearby(df, key, _cols(order), build, back=n - 1).drop("_prior")


def _rolling_mean(w, name, n, least):
    frame = w.rowsBetween(1 - n, 0)
    return _guard(F.avg(name).over(frame), F.count(name).over(frame), least)


@measured_once
def rolling_amount_ratio(df, key, order, amount, short=(5, 3), long=(20, 15)) -> DataFrame:
    df = nearby(df, key, _cols(order), lambda w: {"_prior": F.lag(amount).over(w)})

    def build(w):
        base = _rolling_mean(w, "_prior", *long)
        return {
            "prev_amount": base,
            "amount_ratio": ratio(F.col("_prior"), base),
            "amount_ratio_short": ratio(_rolling_mean(w, "_prior", *short), base),
        }

    return nearby(df, key, _cols(order), build, back=long[0] - 1).drop("_prior")


@measured_once
def prior_day_shape(df, key, order, o="open", h="high", lo="low", c="close", pc="pre_close") -> DataFrame:
    """Shape of the previous bar: gap, body, close position, wicks, 5-bar mean amplitude."""
    width = F.col(h) - F.col(lo)
    shape = {
        "gap": pct(o, pc),
        "intraday": pct(c, o),
        "close_position": F.when(width > 0, ratio(F.col(c) - F.col(lo), width)).otherwise(0.5),
        "upper_wick": ratio(F.col(h) - F.greatest(o, c), pc) * 100,
        "lower_wick": ratio(F.least(o, c) - F.col(lo), pc) * 100,
        "amplitude": ratio(width, pc) * 100,
    }

    df = nearby(df, key, _cols(order), lambda w: {f"prev_{n}": F.lag(v).over(w) for n, v in shape.items()})
    return nearby(
        df, key, _cols(order),
        lambda w: {"prev_amplitude_5": _rolling_mean(w, "prev_amplitude", 5, 3)}, back=4,
    )


@measured_once
def lagged_fundamentals(df, key, order, cols: dict, ratio_of: str, n=20, min_n=15) -> DataFrame:
    """Unit-scaled columns lagged one row; ``ratio_of`` also against its own lagged mean."""
    df = nearby(
        df, key, _cols(order),
        lambda w: {f"prev_{c}": F.lag(F.col(c) * F.lit(k)).over(w) for c, k in cols.items()},
    )

    def build(w):
        return {f"prev_{ratio_of}_ratio": ratio(f"prev_{ratio_of}", _rolling_mean(w, f"prev_{ratio_of}", n, min_n))}

    return nearby(df, key, _cols(order), build, back=n - 1)


# ---- inside a session ------------------------------------------------------


@measured_once
def expanding_path(df, key, order, o="open", h="high", lo="low", c="close", amount="amount") -> DataFrame:
    """Session so far: range, position, amount-weighted price, drawdown, rebound, shares."""
    order = _cols(order)
    typical = (F.col(h) + F.col(lo) + F.col(c)) / 3
    df = running(
        df, key, order,
        {
            "_open": ("first", F.col(o)), "_hi": ("max", F.col(h)), "_lo": ("min", F.col(lo)),
            "_amt": ("sum", F.col(amount)), "_top": ("max", F.col(amount)),
            "_wp": ("sum", typical * F.col(amount)), "_hc": ("max", F.col(c)), "_lc": ("min", F.col(c)),
        },
    )
    df = running(
        df.withColumn("_dd", pct(c, "_hc")), key, order, {"path_max_drawdown": ("min", F.col("_dd"))}
    )
    width = F.col("_hi") - F.col("_lo")
    return df.withColumns(
        {
            "path_return": pct(c, "_open"),
            "path_range": pct("_hi", "_lo"),
            "path_close_position": F.when(width > 0, ratio(F.col(c) - F.col("_lo"), width)).otherwise(0.5),
            "path_vwap_gap": pct(c, ratio("_wp", "_amt")),
            "path_rebound": pct(c, "_lc"),
            "path_amount": F.col("_amt"),
            "path_latest_share": ratio(amount, "_amt"),
            "path_concentration": ratio("_top", "_amt"),
        }
    ).drop("_open", "_hi", "_lo", "_amt", "_top", "_wp", "_hc", "_lc", "_dd")


def _log_steps(df, key, order, o, c):
    """Log return of each bar; the first bar is measured from its own open."""
    return nearby(
        df, key, order,
        lambda w: {"_r": safe_ln(ratio(c, F.coalesce(F.lag(c).over(w), F.col(o))))},
    )


@measured_once
def expanding_moments(df, key, order, o="open", c="close") -> DataFrame:
    order = _cols(order)
    df = _log_steps(df, key, order, o, c)
    r = F.col("_r")
    df = running(
        df, key, order,
        {
            "_n": ("count", F.lit(1)), "_s": ("sum", r), "_ss": ("sum", r * r), "_sa": ("sum", F.abs(r)),
            "_up": ("sum", share(r > 0)), "_dn": ("sum", share(r < 0)), "_first": ("first", F.col(o)),
        },
    )
    n = F.col("_n").cast("double")
    var = ratio(F.col("_ss") - F.col("_s") * F.col("_s") / n, n - 1)
    return df.withColumns(
        {
            "bars_so_far": F.col("_n"),
            "realized_volatility": F.sqrt(clip(var, lo=0.0)) * 100,
            "mean_abs_return": F.col("_sa") / n * 100,
            "up_share": F.col("_up") / n,
            "down_share": F.col("_dn") / n,
            "directional_efficiency": F.when(F.col("_sa") > 0, safe_ln(ratio(c, "_first")) / F.col("_sa")).otherwise(0.0),
        }
    ).drop("_r", "_n", "_s", "_ss", "_sa", "_up", "_dn", "_first")


@measured_once
def expanding_trend(df, key, order, c="close") -> DataFrame:
    """Least-squares slope and r2 of log close on bar number, bars so far."""
    order = _cols(order)
    df = running(df, key, order, {"_n": ("count", F.lit(1))})
    x = (F.col("_n") - 1).cast("double")
    y = safe_ln(c)
    df = running(
        df, key, order, {"_sy": ("sum", y), "_syy": ("sum", y * y), "_sxy": ("sum", x * y)}
    )
    n = F.col("_n").cast("double")
    sx = n * (n - 1) / 2
    sxx = n * (n - 1) * (2 * n - 1) / 6
    cov = n * F.col("_sxy") - sx * F.col("_sy")
    vx = n * sxx - sx * sx
    vy = n * F.col("_syy") - F.col("_sy") * F.col("_sy")
    return df.withColumns(
        {"trend_slope": ratio(cov, vx) * 100, "trend_r2": clip(ratio(cov * cov, vx * vy), 0.0, 1.0)}
    ).drop("_n", "_sy", "_syy", "_sxy")


@measured_once
def trailing_bar_window(df, key, order, h="high", lo="low", c="close", amount="amount", ns=(1, 2, 4)) -> DataFrame:
    def build(w):
        out = {}
        for n in ns:
            base = F.lag(c, n).over(w)
            out[f"bar_ret_{n}"] = F.when(base > 0, pct(c, base))
        hi, low = (f(x).over(w.rowsBetween(-1, 0)) for f, x in ((F.max, h), (F.min, lo)))
        past = w.rowsBetween(-3, -1)
        mean = _guard(F.avg(amount).over(past), F.count(amount).over(past), 3)
        out["range_2"] = F.when(low > 0, pct(hi, low))
        out["close_position_2"] = F.when(hi - low > 0, ratio(F.col(c) - low, hi - low)).otherwise(0.5)
        out["amount_acceleration"] = F.when(mean > 0, ratio(amount, mean))
        return out

    return nearby(df, key, _cols(order), build, back=max(*ns, 3))


@measured_once
def bar_anatomy(df, o="open", h="high", lo="low", c="close") -> DataFrame:
    return df.withColumns(
        {
            "bar_body": pct(c, o),
            "bar_range": pct(h, lo),
            "bar_upper_wick": pct(h, F.greatest(o, c)),
            "bar_lower_wick": pct(F.least(o, c), lo),
        }
    )


@measured_once
def group_first_transform(df, key, order, name, out) -> DataFrame:
    """First non-NULL value of the group on every row."""
    first = running(df, key, _cols(order), {"_f": ("first", F.col(name))})
    # later rows already carry it; max over the group fills rows before the first value
    return group_values(first, key, {out: F.max("_f")}).drop("_f")


@measured_once
def calendar_index(df, date, k=5) -> DataFrame:
    """Dense day index with neighbours and the k previous open days.

    One row per open day, so the single ordered window is bounded by the calendar.
    """
    from pyspark.sql import Window

    w = Window.orderBy("day")
    days = df.select(F.col(date).cast("date").alias("day")).distinct()
    back = w.rowsBetween(-k, -1)
    return days.select(
        "day",
        (F.row_number().over(w) - 1).alias("idx"),
        F.lag("day").over(w).alias("prev_day"),
        F.lead("day").over(w).alias("next_day"),
        F.collect_list("day").over(back).alias("lookback"),
    )


# ---- cross-section ---------------------------------------------------------


@measured_once
def cs_percentile_rank(df, cs, cols, desc=()) -> DataFrame:
    return percentile_ranks(df, cs, {f"{c}_rank": (c, c in desc) for c in cols})


@measured_once
def cs_first_rank(df, cs, name, tie, out="first_rank", desc=True) -> DataFrame:
    """Ordinal rank; equal values are ordered by ``tie``."""
    value = F.col(name).desc_nulls_last() if desc else F.col(name).asc_nulls_last()
    return position(df, cs, [value, *_cols(tie)], out)


@measured_once
def score_decile(df, cs, name, out="decile") -> DataFrame:
    ranked = percentile_rank(df, cs, name, "_pr")
    return ranked.withColumn(out, clip(F.ceil(F.col("_pr") * 10), 1, 10).cast("int")).drop("_pr")


@measured_once
def quantile_bucket(df, name, n, tie, out="bucket") -> DataFrame:
    """Equal-count buckets of ordinal ranks, edges at linear quantiles of 1..rows.

    Counts of value cells tell the bucket of a row without its rank, except in the few cells that
    an edge runs through: only their rows are put in order.
    """
    if n < 2:
        return df.withColumn(out, F.lit(1))
    rows = radix.with_cells(df, F.col(name), "_cell")
    cells = radix.cell_ranks(rows, "_cell")

    def bucket(rank):
        at = F.try_divide((rank - 1) * n, (F.col("_rows") - 1).cast("double"))
        return F.coalesce(clip(F.ceil(F.round(at, 9)), 1, n), F.lit(1)).cast("int")

    cells = cells.withColumns({"_lo": bucket(F.col("_before") + 1), "_hi": bucket(F.col("_before") + F.col("_size"))})
    # for each bucket from the second on, the first cell that reaches it
    reach = [F.min(F.when(F.col("_hi") >= k, F.struct("_cell", "_lo", "_before", F.lit(k).alias("_k")))) for k in range(2, n + 1)]
    edges = cells.groupBy().agg(F.array_compact(F.array(*reach)).alias("_edges"), F.max("_rows").alias("_rows"))
    here = lambda e: e["_cell"] == F.col("_cell")
    passed = F.filter("_edges", lambda e: (e["_cell"] < F.col("_cell")) | (here(e) & (e["_lo"] >= e["_k"])))
    cut = F.filter("_edges", lambda e: here(e) & (e["_lo"] < e["_k"]))
    marked = rows.crossJoin(F.broadcast(edges)).withColumns({out: (F.size(passed) + 1).cast("int"), "_cut": F.get(cut, F.lit(0))["_before"]})
    kept = [c for c in df.columns if c != out]
    whole = marked.where("_cut IS NULL").select(*kept, out)
    ranked = position(marked.where("_cut IS NOT NULL"), ["_cell"], [F.col(name), *_cols(tie)], "_r")
    return whole.unionByName(ranked.select(*kept, bucket(F.col("_cut") + F.col("_r")).alias(out)))


@measured_once
def market_context(df, cs, ret, medians=(), thresholds=(0.0, 2.0, 5.0), near=(), prefix="market") -> DataFrame:
    """Median, breadth over all rows, sample deviation and near-limit counts per row."""
    aggs: dict = {f"{prefix}_return": ("quantile", ret, 0.5), f"{prefix}_dispersion": F.stddev_samp(ret)}
    aggs |= {f"{prefix}_breadth_{int(x)}": F.avg(share(F.col(ret) > x)) for x in thresholds}
    aggs |= {f"{prefix}_{c}": ("quantile", c, 0.5) for c in medians}
    aggs |= {f"{c}_near": F.sum(share(F.col(c) <= 0.10)) for c in near}
    return group_values(df, cs, aggs)


@measured_once
def industry_context(df, cs, group, ret, prefix="industry") -> DataFrame:
    """Group median and breadth; rows without a group get NULL."""
    known = F.col(group).isNotNull() & (F.trim(F.col(group).cast("string")) != "")
    df = group_values(
        df, [*cs, group],
        {f"{prefix}_return": ("quantile", ret, 0.5), f"{prefix}_breadth": F.avg(share(F.col(ret) > 0))},
    )
    return df.withColumns({f"{prefix}_{n}": F.when(known, F.col(f"{prefix}_{n}")) for n in ("return", "breadth")})


@measured_once
def cs_zscore(df, cs, name, limit=10.0, out="zscore") -> DataFrame:
    df = group_values(df, cs, {"_mean": F.avg(name), "_sd": F.stddev_samp(name)})
    z = ratio(F.col(name) - F.col("_mean"), "_sd")
    return df.withColumn(out, clip(z, -limit, limit)).drop("_mean", "_sd")


@measured_once
def cs_change_from_first_slot(df, day, slot, name, first_slot, out="change") -> DataFrame:
    """Cross-section value minus its value in the day's first slot; NULL without that slot."""
    df = group_values(df, day, {"_f": F.max(F.when(F.col(slot) == first_slot, F.col(name)))})
    return df.withColumn(out, F.col(name) - F.col("_f")).drop("_f")


@measured_once
def slot_history(df, day, code, order, cols, hit_rules: dict) -> DataFrame:
    """Per stock-day across slots: step change, change from first, running mean, min, std, hits."""
    key, order = [*day, *code], _cols(order)
    df = nearby(df, key, order, lambda w: {f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in cols})
    aggs = {"appearances": ("count", F.lit(1))}
    for c in cols:
        v = F.col(c)
        aggs |= {
            f"_{c}_f": ("first", v), f"_{c}_n": ("count", v), f"_{c}_s": ("sum", v),
            f"_{c}_ss": ("sum", v * v), f"{c}_min": ("min", v), f"{c}_max": ("max", v),
        }
    aggs |= {f"{n}_hits": ("sum", share(c).cast("int")) for n, c in hit_rules.items()}
    df = running(df, key, order, aggs)
    out = {}
    for c in cols:
        n = F.col(f"_{c}_n").cast("double")
        var = ratio(F.col(f"_{c}_ss") - F.col(f"_{c}_s") * F.col(f"_{c}_s") / n, n - 1)
        out |= {
            f"{c}_from_first": F.col(c) - F.col(f"_{c}_f"),
            f"{c}_mean": ratio(f"_{c}_s", n),
            f"{c}_std": F.coalesce(F.sqrt(clip(var, lo=0.0)), F.lit(0.0)),
        }
    return df.withColumns(out).drop(*[f"_{c}_{x}" for c in cols for x in ("f", "n", "s", "ss")])


@measured_once
def slot_leader_context(df, cs, score, tie, cols=()) -> DataFrame:
    """Rank in the slot, slot statistics, gap to the top and the leader's margin to second."""
    df = position(df, cs, [F.col(score).desc_nulls_last(), *_cols(tie)], "slot_rank")
    aggs: dict = {
        "slot_size": F.count(F.lit(1)),
        "slot_max": F.max(score),
        "slot_median": ("quantile", score, 0.5),
        "slot_q90": ("quantile", score, 0.9),
        "slot_std": F.stddev_samp(score),
        "_second": F.max(F.when(F.col("slot_rank") == 2, F.col(score))),
    }
    aggs |= {f"{c}_slot_max": F.max(c) for c in cols}
    df = group_values(df, cs, aggs)
    return df.withColumns(
        {
            "slot_std": F.coalesce("slot_std", F.lit(0.0)),
            "gap_to_top": F.col("slot_max") - F.col(score),
            "top_margin": F.coalesce(F.col("slot_max") - F.col("_second"), F.lit(0.0)),
        }
    ).drop("_second")


@measured_once
def leader_persistence(df, day, code, order, score, rank) -> DataFrame:
    key, order = [*day, *code], _cols(order)
    df = nearby(df, key, order, lambda w: {"score_delta": F.coalesce(F.col(score) - F.lag(score).over(w), F.lit(0.0))})
    df = running(
        df, key, order,
        {
            "seen_so_far": ("count", F.lit(1)), "_s": ("sum", F.col(score)), "_n": ("count", F.col(score)),
            "best_rank_so_far": ("min", F.col(rank)),
        },
    )
    return df.withColumn("mean_so_far", ratio("_s", "_n")).drop("_s", "_n")


@measured_once
def path_context(df, cs, day, code, slot_minute, cols) -> DataFrame:
    """Slot rank of each path column, its change since the stock's last appearance, and the wait."""
    df = cs_percentile_rank(df, cs, cols)

    def build(w):
        out = {f"{c}_change": F.col(c) - F.lag(c).over(w) for c in cols}
        out["minutes_since_prior"] = F.col(slot_minute) - F.lag(slot_minute).over(w)
        return out

    return nearby(df, [*day, *code], [F.col(slot_minute)], build)


@measured_once
def max_streak(df, key, order, cond, out="max_streak") -> DataFrame:
    """Longest run of true per key; runs are numbered by the false rows before them."""
    df = running(df.withColumn("_ok", share(cond)), key, _cols(order), {"_run": ("sum", 1 - F.col("_ok"))})
    runs = df.groupBy(*key, "_run").agg(F.sum("_ok").cast("bigint").alias("_len"))
    return runs.groupBy(*key).agg(F.max("_len").alias(out))


@measured_once
def cumulative_equity_drawdown(df, by, day, ret) -> DataFrame:
    """Compounded equity of daily percent returns, its peak and the worst drawdown so far."""
    growth = 1 + F.col(ret) / 100
    df = running(calendar_rows(df, by), by, [F.col(day)], {"equity": ("product", growth)}, bound=CALENDAR)
    df = running(df, by, [F.col(day)], {"_peak": ("max", F.col("equity"))}, bound=CALENDAR)
    df = df.withColumn("peak", F.greatest("_peak", F.lit(1.0)))
    df = df.withColumn("drawdown", pct("equity", "peak"))
    return running(df, by, [F.col(day)], {"max_drawdown": ("min", F.col("drawdown"))}, bound=CALENDAR).drop("_peak")


@measured_once
def next_term_contract(df, family, month, value, out=None) -> DataFrame:
    """Contract with the next later month in its family, one row per (family, month)."""
    return nearby(
        df, family, [F.col(month)],
        lambda w: {f"next_{c}": F.lead(c).over(w) for c in (month, *value)}, back=0, ahead=1,
    )


