"""Queries for the window operators."""

from pyspark.sql import functions as F

from ..functions import minute_of_day
from ..operators import windows as op
from .registry import query

W = "WINDOW w AS (PARTITION BY code ORDER BY day)"
KEY, DAY = ["code"], ["day"]
LAG_RET = f"SELECT *, (pc / lag(pc) OVER w - 1) * 100 AS r FROM (SELECT *, lag(close * adj) OVER w AS pc FROM daily {W}) {W}"


def adjusted(t):
    return t.daily.withColumn("px", F.col("close") * F.col("adj"))


def shifted(t):
    return op.lagged_returns(adjusted(t), KEY, DAY, "px", ks=(1,))


@query("lagged_returns", "code:i day:d ret_1:r ret_2:r ret_3:r ret_5:r ret_10:r ret_20:r",
       "SELECT code, day, " + ", ".join(f"(lag(px, 1) OVER w / lag(px, {k + 1}) OVER w - 1) * 100 AS ret_{k}" for k in (1, 2, 3, 5, 10, 20))
       + f" FROM (SELECT *, close * adj AS px FROM daily) {W}")
def _(t):
    return op.lagged_returns(adjusted(t), KEY, DAY, "px")


@query("rolling_positive_share", "code:i day:d positive_share_5:r positive_share_10:r positive_share_20:r",
       "SELECT code, day, " + ", ".join(
           f"CASE WHEN count(*) OVER w{n} >= {m} THEN avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w{n} END AS positive_share_{n}"
           for n, m in ((5, 3), (10, 7), (20, 15))) + f" FROM ({LAG_RET}) WINDOW " + ", ".join(
           f"w{n} AS (PARTITION BY code ORDER BY day ROWS {n - 1} PRECEDING)" for n in (5, 10, 20)))
def _(t):
    return op.rolling_positive_share(shifted(t), KEY, DAY, "ret_1")


@query("rolling_volatility", "code:i day:d volatility:r downside:r",
       f"""SELECT code, day, CASE WHEN count(r) OVER w >= 15 THEN stddev_samp(r) OVER w END AS volatility,
       CASE WHEN count(*) OVER w >= 15 THEN stddev_samp(CASE WHEN r < 0 THEN r ELSE 0 END) OVER w END AS downside
       FROM ({LAG_RET}) WINDOW w AS (PARTITION BY code ORDER BY day ROWS 19 PRECEDING)""")
def _(t):
    df = op.rolling_volatility(shifted(t), KEY, DAY, "ret_1")
    return op.rolling_volatility(df, KEY, DAY, "ret_1", downside=True, out="downside")


@query("rolling_drawdown", "code:i day:d drawdown:r",
       f"""SELECT code, day, CASE WHEN count(pc) OVER w >= 15 THEN (pc / max(pc) OVER w - 1) * 100 END AS drawdown
       FROM ({LAG_RET}) WINDOW w AS (PARTITION BY code ORDER BY day ROWS 19 PRECEDING)""")
def _(t):
    return op.rolling_drawdown(adjusted(t), KEY, DAY, "px")


@query("rolling_amount_ratio", "code:i day:d prev_amount:r amount_ratio:r amount_ratio_short:r",
       f"""SELECT code, day, m AS prev_amount, pa / m AS amount_ratio, s / m AS amount_ratio_short FROM (
       SELECT code, day, pa, CASE WHEN count(pa) OVER w20 >= 15 THEN avg(pa) OVER w20 END AS m,
       CASE WHEN count(pa) OVER w5 >= 3 THEN avg(pa) OVER w5 END AS s FROM (SELECT *, lag(amount) OVER w AS pa FROM bars {W})
       WINDOW w20 AS (PARTITION BY code ORDER BY day ROWS 19 PRECEDING), w5 AS (PARTITION BY code ORDER BY day ROWS 4 PRECEDING))""")
def _(t):
    return op.rolling_amount_ratio(t.bars, KEY, DAY, "amount")


@query("prior_day_shape", "code:i day:d prev_gap:r prev_intraday:r prev_close_position:r prev_upper_wick:r prev_lower_wick:r prev_amplitude_5:r",
       f"""SELECT *, CASE WHEN count(pa) OVER v >= 3 THEN avg(pa) OVER v END AS prev_amplitude_5 FROM (
       SELECT code, day, lag((open / pre_close - 1) * 100) OVER w AS prev_gap, lag((close / open - 1) * 100) OVER w AS prev_intraday,
       lag(CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END) OVER w AS prev_close_position,
       lag((high - greatest(open, close)) / pre_close * 100) OVER w AS prev_upper_wick,
       lag((least(open, close) - low) / pre_close * 100) OVER w AS prev_lower_wick,
       lag((high - low) / pre_close * 100) OVER w AS pa FROM daily {W})
       WINDOW v AS (PARTITION BY code ORDER BY day ROWS 4 PRECEDING)""")
def _(t):
    return op.prior_day_shape(t.daily, KEY, DAY)


@query("lagged_fundamentals", "code:i day:d prev_vol:r prev_amount:r prev_vol_ratio:r",
       f"""SELECT code, day, pv AS prev_vol, pa AS prev_amount, pv / CASE WHEN count(pv) OVER v >= 15 THEN avg(pv) OVER v END AS prev_vol_ratio
       FROM (SELECT code, day, lag(vol) OVER w AS pv, lag(amount * 0.01::DOUBLE) OVER w AS pa FROM bars {W})
       WINDOW v AS (PARTITION BY code ORDER BY day ROWS 19 PRECEDING)""")
def _(t):
    return op.lagged_fundamentals(t.bars, KEY, DAY, {"vol": 1.0, "amount": 0.01}, "vol")


M = "PARTITION BY code, day ORDER BY ts"
TS = "strftime(ts, '%H:%M') AS bar"


def bar_clock(df):
    return df.withColumn("bar", F.date_format("ts", "HH:mm"))


@query("expanding_path", "code:i day:d bar:s path_return:r path_range:r path_close_position:r path_vwap_gap:r path_rebound:r path_amount:r path_latest_share:r path_concentration:r path_max_drawdown:r",
       f"""SELECT code, day, {TS}, (close / fo - 1) * 100 AS path_return, (hi / lo - 1) * 100 AS path_range,
       CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END AS path_close_position, (close / (wp / amt) - 1) * 100 AS path_vwap_gap,
       (close / lc - 1) * 100 AS path_rebound, amt AS path_amount, amount / amt AS path_latest_share, top / amt AS path_concentration,
       min((close / hc - 1) * 100) OVER ({M}) AS path_max_drawdown FROM (
       SELECT *, first_value(open) OVER v AS fo, max(high) OVER v AS hi, min(low) OVER v AS lo, sum(amount) OVER v AS amt, max(amount) OVER v AS top,
       sum((high + low + close) / 3 * amount) OVER v AS wp, max(close) OVER v AS hc, min(close) OVER v AS lc FROM mbars WINDOW v AS ({M}))""")
def _(t):
    return bar_clock(op.expanding_path(t.mbars, ["code", "day"], ["ts"]))


STEPS = f"SELECT *, ln(close / coalesce(lag(close) OVER ({M}), open)) AS r, first_value(open) OVER ({M}) AS fo FROM mbars"


@query("expanding_moments", "code:i day:d bar:s bars_so_far:i realized_volatility:r mean_abs_return:r up_share:r down_share:r directional_efficiency:r",
       f"""SELECT code, day, {TS}, count(*) OVER v AS bars_so_far, stddev_samp(r) OVER v * 100 AS realized_volatility, avg(abs(r)) OVER v * 100 AS mean_abs_return,
       avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER v AS up_share, avg(CASE WHEN r < 0 THEN 1.0::DOUBLE ELSE 0 END) OVER v AS down_share,
       CASE WHEN sum(abs(r)) OVER v > 0 THEN ln(close / fo) / sum(abs(r)) OVER v ELSE 0 END AS directional_efficiency
       FROM ({STEPS}) WINDOW v AS ({M})""")
def _(t):
    return bar_clock(op.expanding_moments(t.mbars, ["code", "day"], ["ts"]))


@query("expanding_trend", "code:i day:d bar:s trend_slope:r trend_r2:r",
       f"""SELECT code, day, {TS}, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) * 100 AS trend_slope,
       least(greatest((n * sxy - sx * sy) * (n * sxy - sx * sy) / nullif((n * sxx - sx * sx) * (n * syy - sy * sy), 0), CASE WHEN n > 1 THEN 0.0::DOUBLE END), CASE WHEN n > 1 THEN 1.0::DOUBLE END) AS trend_r2
       FROM (SELECT *, sum(y) OVER v AS sy, sum(y * y) OVER v AS syy, sum((n - 1) * y) OVER v AS sxy, n * (n - 1) / 2 AS sx, n * (n - 1) * (2 * n - 1) / 6 AS sxx
       FROM (SELECT *, ln(close) AS y, CAST(count(*) OVER ({M}) AS DOUBLE) AS n FROM mbars) WINDOW v AS ({M}))""")
def _(t):
    return bar_clock(op.expanding_trend(t.mbars, ["code", "day"], ["ts"]))


@query("trailing_bar_window", "code:i day:d bar:s bar_ret_1:r bar_ret_2:r bar_ret_4:r range_2:r close_position_2:r amount_acceleration:r",
       f"""SELECT code, day, {TS}, (close / lag(close, 1) OVER v - 1) * 100 AS bar_ret_1, (close / lag(close, 2) OVER v - 1) * 100 AS bar_ret_2,
       (close / lag(close, 4) OVER v - 1) * 100 AS bar_ret_4, (hi / lo - 1) * 100 AS range_2,
       CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END AS close_position_2, CASE WHEN n = 3 THEN amount / m END AS amount_acceleration
       FROM (SELECT *, max(high) OVER two AS hi, min(low) OVER two AS lo, avg(amount) OVER three AS m, count(amount) OVER three AS n FROM mbars
       WINDOW two AS ({M} ROWS 1 PRECEDING), three AS ({M} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WINDOW v AS ({M})""")
def _(t):
    return bar_clock(op.trailing_bar_window(t.mbars, ["code", "day"], ["ts"]))


@query("bar_anatomy", "code:i day:d bar_body:r bar_range:r bar_upper_wick:r bar_lower_wick:r",
       """SELECT code, day, (close / open - 1) * 100 AS bar_body, (high / low - 1) * 100 AS bar_range,
       (high / greatest(open, close) - 1) * 100 AS bar_upper_wick, (least(open, close) / low - 1) * 100 AS bar_lower_wick FROM bars""")
def _(t):
    return op.bar_anatomy(t.bars)


@query("group_first_transform", "code:i day:d bar:s day_open:r",
       f"SELECT code, day, {TS}, first_value(open) OVER ({M}) AS day_open FROM mbars")
def _(t):
    return bar_clock(op.group_first_transform(t.mbars, ["code", "day"], ["ts"], "open", "day_open").select("code", "day", "ts", "day_open"))


@query("calendar_index", "day:d idx:i prev_day:d next_day:d lookback:s",
       """SELECT c.day, c.idx, c.prev_day, c.next_day, coalesce((SELECT string_agg(CAST(o.day AS VARCHAR), '|' ORDER BY o.day) FROM calendar o
       WHERE o.idx BETWEEN c.idx - 5 AND c.idx - 1), '') AS lookback FROM calendar c""")
def _(t):
    out = op.calendar_index(t.lines, "day", 5)
    return out.withColumn("lookback", F.array_join(F.col("lookback").cast("array<string>"), "|"))


def pr(col, cs="day, slot", src="panel", desc=False):
    o = f"{col} {'DESC' if desc else 'ASC'} NULLS LAST"
    return f"""CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {cs} ORDER BY {o}) + (count(*) OVER (PARTITION BY {cs}, {col}) - 1) / 2.0::DOUBLE)
    / count({col}) OVER (PARTITION BY {cs}) END"""


CS = ["day", "slot"]


@query("cs_percentile_rank", "day:d slot:s code:i ret_rank:r vol_rank:r",
       f"SELECT day, slot, code, {pr('ret')} AS ret_rank, {pr('vol', desc=True)} AS vol_rank FROM panel")
def _(t):
    return op.cs_percentile_rank(t.panel.select("day", "slot", "code", "ret", "vol"), CS, ["ret", "vol"], desc=["vol"])


@query("cs_first_rank", "day:d slot:s code:i first_rank:i",
       "SELECT day, slot, code, row_number() OVER (PARTITION BY day, slot ORDER BY vol DESC NULLS LAST, code) AS first_rank FROM panel")
def _(t):
    return op.cs_first_rank(t.panel, CS, "vol", ["code"])


@query("score_decile", "day:d slot:s code:i decile:i",
       f"SELECT day, slot, code, least(greatest(ceil({pr('p')} * 10), 1), 10) AS decile FROM scored")
def _(t):
    return op.score_decile(t.scored, CS, "p")


@query("quantile_bucket", "day:d slot:s code:i bucket:i",
       """SELECT day, slot, code, least(greatest(ceil(round((row_number() OVER (ORDER BY vol, day, slot, code) - 1) * 5 / CAST(count(*) OVER () - 1 AS DOUBLE), 9)), 1), 5) AS bucket
       FROM panel""")
def _(t):
    return op.quantile_bucket(t.panel, "vol", 5, ["day", "slot", "code"])


@query("market_context", "day:d slot:s code:i market_return:r market_dispersion:r market_breadth_0:r market_breadth_2:r market_breadth_5:r market_gap:r dist_up_near:i",
       """SELECT day, slot, code, median(ret) OVER w AS market_return, stddev_samp(ret) OVER w AS market_dispersion,
       avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS market_breadth_0, avg(CASE WHEN ret > 2 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS market_breadth_2,
       avg(CASE WHEN ret > 5 THEN 1.0::DOUBLE ELSE 0 END) OVER w AS market_breadth_5, median(gap) OVER w AS market_gap,
       sum(CASE WHEN dist_up <= 0.1 THEN 1 ELSE 0 END) OVER w AS dist_up_near FROM panel WINDOW w AS (PARTITION BY day, slot)""")
def _(t):
    return op.market_context(t.panel, CS, "ret", medians=["gap"], near=["dist_up"])


@query("industry_context", "day:d slot:s code:i industry_return:r industry_breadth:r",
       """SELECT day, slot, code, CASE WHEN g <> '' THEN median(ret) OVER w END AS industry_return,
       CASE WHEN g <> '' THEN avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w END AS industry_breadth
       FROM (SELECT *, CASE WHEN region = 2 THEN '' ELSE CAST(region AS VARCHAR) END AS g FROM panel) WINDOW w AS (PARTITION BY day, slot, g)""")
def _(t):
    g = F.when(F.col("region") == 2, "").otherwise(F.col("region").cast("string"))
    return op.industry_context(t.panel.withColumn("g", g), CS, "g", "ret")


@query("cs_zscore", "day:d slot:s code:i zscore:r",
       """SELECT day, slot, code, CASE WHEN s <> 0 THEN CASE WHEN (ret - m) / s > 10 THEN 10 WHEN (ret - m) / s < -10 THEN -10 ELSE (ret - m) / s END END AS zscore FROM (
       SELECT *, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s FROM panel WINDOW w AS (PARTITION BY day, slot))""")
def _(t):
    return op.cs_zscore(t.panel, CS, "ret")


@query("cs_change_from_first_slot", "day:d slot:s breadth:r change:r",
       """WITH b AS (SELECT day, slot, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS breadth FROM panel GROUP BY day, slot)
       SELECT day, slot, breadth, breadth - max(CASE WHEN slot = '14:00' THEN breadth END) OVER (PARTITION BY day) AS change FROM b""")
def _(t):
    b = t.panel.groupBy(*CS).agg(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("breadth"))
    return op.cs_change_from_first_slot(b, ["day"], "slot", "breadth", "14:00")


@query("slot_history", "day:d slot:s code:i appearances:i p_delta:r p_from_first:r p_mean:r p_min:r p_max:r p_std:r strong_hits:i",
       """SELECT day, slot, code, count(*) OVER v AS appearances, p - lag(p) OVER v AS p_delta, p - first_value(p) OVER v AS p_from_first, avg(p) OVER v AS p_mean,
       min(p) OVER v AS p_min, max(p) OVER v AS p_max, coalesce(stddev_samp(p) OVER v, 0) AS p_std, sum(CASE WHEN p > 0.7 THEN 1 ELSE 0 END) OVER v AS strong_hits
       FROM scored WINDOW v AS (PARTITION BY day, code ORDER BY slot)""")
def _(t):
    return op.slot_history(t.scored, ["day"], ["code"], ["slot"], ["p"], {"strong": F.col("p") > 0.7})


@query("slot_leader_context", "day:d slot:s code:i slot_rank:i slot_size:i slot_max:r slot_median:r slot_q90:r slot_std:r gap_to_top:r top_margin:r ret_slot_max:r",
       """SELECT *, m - p AS gap_to_top, coalesce(m - max(CASE WHEN slot_rank = 2 THEN p END) OVER (PARTITION BY day, slot), 0) AS top_margin FROM (
       SELECT day, slot, code, p, row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) AS slot_rank, count(*) OVER w AS slot_size, max(p) OVER w AS slot_max, max(p) OVER w AS m,
       median(p) OVER w AS slot_median, quantile_cont(p, 0.9) OVER w AS slot_q90, coalesce(stddev_samp(p) OVER w, 0) AS slot_std, max(ret) OVER w AS ret_slot_max FROM scored WINDOW w AS (PARTITION BY day, slot))""")
def _(t):
    return op.slot_leader_context(t.scored, CS, "p", ["code"], ["ret"])


@query("leader_persistence", "day:d slot:s code:i seen_so_far:i mean_so_far:r score_delta:r best_rank_so_far:i",
       """SELECT day, slot, code, count(*) OVER v AS seen_so_far, avg(p) OVER v AS mean_so_far, coalesce(p - lag(p) OVER v, 0) AS score_delta, min(rk) OVER v AS best_rank_so_far
       FROM (SELECT *, row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) AS rk FROM scored) WINDOW v AS (PARTITION BY day, code ORDER BY slot)""")
def _(t):
    ranked = op.cs_first_rank(t.scored, CS, "p", ["code"], out="rk")
    return op.leader_persistence(ranked, ["day"], ["code"], ["slot"], "p", "rk")


@query("path_context", "day:d slot:s code:i ret_rank:r ret_change:r minutes_since_prior:i",
       f"""SELECT day, slot, code, {pr('ret')} AS ret_rank, ret - lag(ret) OVER v AS ret_change, mi - lag(mi) OVER v AS minutes_since_prior
       FROM (SELECT *, CAST(left(slot, 2) AS INT) * 60 + CAST(right(slot, 2) AS INT) AS mi FROM panel) WINDOW v AS (PARTITION BY day, code ORDER BY mi)""")
def _(t):
    df = t.panel.withColumn("mi", minute_of_day("slot"))
    return op.path_context(df, CS, ["day"], ["code"], "mi", ["ret"])


@query("max_streak", "code:i max_streak:i",
       f"""SELECT code, max(n) AS max_streak FROM (SELECT code, g, sum(ok) AS n FROM (SELECT *, sum(1 - ok) OVER w AS g FROM (
       SELECT code, day, CASE WHEN close > open THEN 1 ELSE 0 END AS ok FROM bars) {W}) GROUP BY code, g) GROUP BY code""")
def _(t):
    return op.max_streak(t.bars, KEY, DAY, F.col("close") > F.col("open"))


@query("cumulative_equity_drawdown", "fold:i day:d equity:r peak:r drawdown:r max_drawdown:r",
       """SELECT *, min(drawdown) OVER (PARTITION BY fold ORDER BY day) AS max_drawdown FROM (SELECT *, (equity / peak - 1) * 100 AS drawdown FROM (
       SELECT *, greatest(max(equity) OVER (PARTITION BY fold ORDER BY day), 1) AS peak FROM (
       SELECT fold, day, product(1 + r / 100) OVER (PARTITION BY fold ORDER BY day) AS equity FROM (SELECT fold, day, avg(net) / 10 AS r FROM scored GROUP BY fold, day))))""")
def _(t):
    daily = t.scored.groupBy("fold", "day").agg((F.avg("net") / 10).alias("r"))
    return op.cumulative_equity_drawdown(daily, ["fold"], "day", "r")


@query("next_term_contract", "code:i day:d close:r next_day:d next_close:r",
       f"SELECT code, day, close, lead(day) OVER w AS next_day, lead(close) OVER w AS next_close FROM bars {W}")
def _(t):
    return op.next_term_contract(t.bars, KEY, "day", ["close"])
