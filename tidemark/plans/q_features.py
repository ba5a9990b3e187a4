"""Queries for price, flow, positioning, peer and event features."""

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import features as op
from ..operators import joins, windows
from .registry import query

CS, PK = ["day", "slot"], ["day", "slot", "code"]


@query("total_return_price", "code:i day:d tr_price:r",
       "SELECT code, day, close * lead(adj) OVER (PARTITION BY code ORDER BY day) / adj AS tr_price FROM daily")
def _(t):
    df = windows.next_term_contract(t.daily, ["code"], "day", ["adj"])
    return op.total_return_price(df, "close", "adj", "next_adj", "tr_price")


@query("slot_price_features", "day:d slot:s code:i ret_from_prev_close:r ret_from_open:r gap_open:r distance_to_up_limit:r distance_to_down_limit:r",
       """SELECT day, slot, code, (price / prev_close - 1) * 100 AS ret_from_prev_close, (price / day_open - 1) * 100 AS ret_from_open, (day_open / prev_close - 1) * 100 AS gap_open,
       (up_limit / price - 1) * 100 AS distance_to_up_limit, (price / down_limit - 1) * 100 AS distance_to_down_limit FROM panel LEFT JOIN limits USING (code, day)""")
def _(t):
    return op.slot_price_features(t.panel.join(t.limits, ["code", "day"], "left"))


# inputs of the interactions, from columns of the scored panel
INPUTS = {
    "relative_market": "ret", "relative_industry": "gap", "prev_5d_return": "ret_open", "prev_20d_return": "gap", "prev_20d_volatility": "risk",
    "tail_amount_ratio": "p", "prev_5d_amount_ratio": "q", "ret_20m": "ret_open", "amount_acceleration": "u", "market_return": "ret", "market_breadth": "p",
    "market_tail_return": "ret_open", "market_tail_breadth": "q", "industry_return": "gap", "industry_breadth": "u", "industry_tail_return": "ret", "industry_tail_breadth": "risk",
    "directional_efficiency": "p", "trend_r2": "q", "trend_slope": "ret", "path_rebound": "ret_open", "bar_lower_wick": "p", "bar_upper_wick": "q", "path_close_position": "u",
    "path_range": "ret", "realized_volatility": "risk", "market_dispersion": "u",
}
I_SQL = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in INPUTS.items()) + " FROM scored"


@query("feature_interactions", "day:d slot:s code:i momentum_reversal:r volatility_adjusted_momentum:r liquidity_acceleration:r volume_price_confirmation:r limit_asymmetry:r market_strength:r industry_strength:r relative_alignment:r trend_quality:r reversal_pressure:r breakout_pressure:r overnight_alignment:r risk_adjusted_tail:r dispersion_adjusted:r industry_dispersion:r",
       f"""SELECT day, slot, code, prev_5d_return - prev_20d_return AS momentum_reversal, prev_5d_return / greatest(abs(prev_20d_volatility), 0.25) AS volatility_adjusted_momentum,
       tail_amount_ratio - prev_5d_amount_ratio AS liquidity_acceleration, ret_20m * ln(1 + greatest(amount_acceleration, 0)) AS volume_price_confirmation, dist_down - dist_up AS limit_asymmetry,
       0.45 * market_return + 2 * (market_breadth - 0.5) + 0.35 * market_tail_return + (market_tail_breadth - 0.5) AS market_strength,
       0.55 * industry_return + 1.5 * (industry_breadth - 0.5) + 0.45 * industry_tail_return + 0.75 * (industry_tail_breadth - 0.5) AS industry_strength,
       sign(relative_market) * sign(relative_industry) * sqrt(abs(relative_market) * abs(relative_industry)) AS relative_alignment,
       directional_efficiency * least(greatest(trend_r2, 0), 1) * trend_slope AS trend_quality, path_rebound + bar_lower_wick - bar_upper_wick AS reversal_pressure,
       (path_close_position - 0.5) * path_range AS breakout_pressure, gap * ret_open AS overnight_alignment, ret_20m / greatest(abs(realized_volatility), 0.05) AS risk_adjusted_tail,
       relative_market / greatest(abs(market_dispersion), 0.1) AS dispersion_adjusted, relative_industry - relative_market AS industry_dispersion FROM ({I_SQL})""")
def _(t):
    return op.feature_interactions(t.scored.withColumns({k: F.col(v) for k, v in INPUTS.items()}))


@query("log_and_ratio_features", "day:d slot:s code:i amount_log:r amount_ratio:r relative:r",
       "SELECT day, slot, code, ln(1 + greatest(slot_amount, 0)) AS amount_log, slot_amount / nullif(prev_close, 0) AS amount_ratio, ret - gap AS relative FROM panel")
def _(t):
    return op.log_and_ratio_features(
        t.panel, {"amount_log": "slot_amount"}, {"amount_ratio": ("slot_amount", "prev_close")}, {"relative": ("ret", "gap")})


@query("price_parity", "day:d slot:s code:i parity_ok:b parity_ok_bps:r",
       "SELECT day, slot, code, coalesce(abs(price / day_open - 1) * 10000 <= 500, false) AS parity_ok, abs(price / day_open - 1) * 10000 AS parity_ok_bps FROM panel")
def _(t):
    return op.price_parity(t.panel, "price", "day_open", 500)


@query("auction_features", "day:d slot:s code:i auction_gap:r auction_return:r auction_range:r auction_close_position:r auction_vwap_gap:r auction_amount_log:r auction_volume_log:r auction_available:b",
       """SELECT p.day, p.slot, p.code, (a.open / (p.price / (1 + p.ret / 100)) - 1) * 100 AS auction_gap, (a.close / a.open - 1) * 100 AS auction_return, (a.high / a.low - 1) * 100 AS auction_range,
       (a.close - a.low) / nullif(a.high - a.low, 0) AS auction_close_position, (a.close / (a.amount / a.vol) - 1) * 100 AS auction_vwap_gap, ln(1 + a.amount) AS auction_amount_log, ln(1 + a.vol) AS auction_volume_log,
       a.code IS NOT NULL AS auction_available FROM panel p LEFT JOIN (SELECT * FROM slot_bars WHERE slot = '14:00') a ON a.code = p.code AND a.day = p.day""")
def _(t):
    auction = t.slot_bars.filter("slot = '14:00'").withColumn("vwap", F.col("amount") / F.col("vol"))
    return op.auction_features(t.panel, auction)


@query("moneyflow_shares", "code:i day:d source_day:d flow_net_share:r flow_large_share:r flow_small_share:r flow_spread:r flow_gross_log:r flow_available:b",
       """SELECT b.code, b.day, k.prev_day AS source_day, (bl + bs - sl - ss) / nullif(g, 0) AS flow_net_share, (bl - sl) / nullif(g, 0) AS flow_large_share, (bs - ss) / nullif(g, 0) AS flow_small_share,
       ((bl - sl) - (bs - ss)) / nullif(g, 0) AS flow_spread, ln(1 + g) AS flow_gross_log, coalesce(g > 0, false) AS flow_available FROM bars b JOIN calendar k USING (day) LEFT JOIN
       (SELECT code, day, buy_lg AS bl, buy_sm AS bs, sell_lg AS sl, sell_sm AS ss, buy_lg + buy_sm + sell_lg + sell_sm AS g FROM flow) f ON f.code = b.code AND f.day = k.prev_day""")
def _(t):
    flow = t.flow.withColumn("net_flow", F.col("buy_lg") + F.col("buy_sm") - F.col("sell_lg") - F.col("sell_sm"))
    return op.moneyflow_shares(t.bars, flow, t.calendar)


COST = """SELECT code, day, low * 0.9::DOUBLE AS his_low, low AS cost_5, least(open, close) AS cost_15, (open + close) / 2 AS cost_50, greatest(open, close) AS cost_85, CASE WHEN CAST(vol AS BIGINT) % 5 = 0 THEN low ELSE high END AS cost_95,
  high * 1.1::DOUBLE AS his_high, amount / vol AS weight_avg, CAST(vol AS BIGINT) % 101 AS winner_rate FROM bars"""


def cost(t):
    v = F.col("vol").cast("bigint")
    return t.bars.select(
        "code", "day", (F.col("low") * 0.9).alias("his_low"), F.col("low").alias("cost_5"), F.least("open", "close").alias("cost_15"), ((F.col("open") + F.col("close")) / 2).alias("cost_50"),
        F.greatest("open", "close").alias("cost_85"), F.when(v % 5 == 0, F.col("low")).otherwise(F.col("high")).alias("cost_95"), (F.col("high") * 1.1).alias("his_high"),
        (F.col("amount") / F.col("vol")).alias("weight_avg"), (v % 101).cast("double").alias("winner_rate"))


@query("cost_distribution_features", "code:i day:d cost_available:b cost_winner_rate:r cost_vs_average:r cost_vs_50:r cost_width_90:r cost_width_70:r cost_position_90:r cost_overhang_85:r cost_cushion:r",
       f"""SELECT code, day, ok AS cost_available, CASE WHEN ok THEN winner_rate END AS cost_winner_rate, CASE WHEN ok THEN (close / weight_avg - 1) * 100 END AS cost_vs_average, CASE WHEN ok THEN (close / cost_50 - 1) * 100 END AS cost_vs_50,
       CASE WHEN ok THEN (cost_95 - cost_5) / weight_avg * 100 END AS cost_width_90, CASE WHEN ok THEN (cost_85 - cost_15) / weight_avg * 100 END AS cost_width_70,
       CASE WHEN ok AND cost_95 <> cost_5 THEN least(greatest((close - cost_5) / (cost_95 - cost_5), -2), 3) END AS cost_position_90,
       CASE WHEN ok THEN greatest(cost_85 - close, 0) / close * 100 END AS cost_overhang_85, CASE WHEN ok THEN greatest(close - weight_avg, 0) / close * 100 END AS cost_cushion FROM (
       SELECT b.code, b.day, b.close, c.* EXCLUDE (code, day), coalesce(his_low <= cost_5 AND cost_5 <= cost_15 AND cost_15 <= cost_50 AND cost_50 <= cost_85 AND cost_85 <= cost_95 AND cost_95 <= his_high AND weight_avg > 0, false) AS ok
       FROM bars b JOIN calendar k USING (day) LEFT JOIN ({COST}) c ON c.code = b.code AND c.day = k.prev_day)""")
def _(t):
    return op.cost_distribution_features(t.bars, cost(t), t.calendar, price="close")


M_SQL = """SELECT code, day, amount AS fb, vol AS sb, amount + vol AS tb, buy_lg AS fbuy, sell_lg AS frep, buy_sm AS ssell, sell_sm AS srep FROM bars JOIN flow USING (code, day)"""


@query("margin_features", "code:i day:d margin_available:b margin_fin_log:r margin_short_log:r margin_fin_flow:r margin_short_flow:r margin_fin_change:r margin_short_change:r margin_short_to_fin:r",
       f"""SELECT b.code, b.day, n.code IS NOT NULL AS margin_available, ln(1 + n.fb) AS margin_fin_log, ln(1 + n.sb) AS margin_short_log, (n.fbuy - n.frep) / nullif(n.fbuy + n.frep, 0) AS margin_fin_flow,
       (n.ssell - n.srep) / nullif(n.ssell + n.srep, 0) AS margin_short_flow, (n.fb / o.fb - 1) * 100 AS margin_fin_change, (n.sb / o.sb - 1) * 100 AS margin_short_change, n.sb / n.fb AS margin_short_to_fin
       FROM bars b JOIN calendar k ON k.day = b.day LEFT JOIN calendar k2 ON k2.day = k.prev_day LEFT JOIN ({M_SQL}) n ON n.code = b.code AND n.day = k.prev_day LEFT JOIN ({M_SQL}) o ON o.code = b.code AND o.day = k2.prev_day AND n.code IS NOT NULL""")
def _(t):
    m = t.bars.join(t.flow, ["code", "day"]).select(
        "code", "day", F.col("amount").alias("fin_balance"), F.col("vol").alias("short_balance"), (F.col("amount") + F.col("vol")).alias("total_balance"),
        F.col("buy_lg").alias("fin_buy"), F.col("sell_lg").alias("fin_repay"), F.col("buy_sm").alias("short_sell"), F.col("sell_sm").alias("short_repay"))
    return op.margin_features(t.bars.select("code", "day"), m, t.calendar)


D_SQL = """SELECT code, day, count(*) AS n, count(DISTINCT tag) AS k, sum(CASE WHEN tag = 'purchase' THEN value ELSE -value END) AS net, sum(CASE WHEN tag = 'purchase' THEN value ELSE 0 END) AS buy,
  sum(CASE WHEN tag <> 'purchase' THEN value ELSE 0 END) AS sell, sum(value) AS amt, max(value) AS mx FROM tape GROUP BY code, day"""


@query("dealer_list_features", "code:i day:d dealer_flag:b dealer_entries:r dealer_reasons:r dealer_net_log:r dealer_net_ratio:r dealer_buy_sell:r dealer_rate_max:r",
       f"""SELECT u.code, u.day, n IS NOT NULL AS dealer_flag, coalesce(n, 0) AS dealer_entries, coalesce(k, 0) AS dealer_reasons, sign(coalesce(net, 0)) * ln(1 + abs(coalesce(net, 0))) AS dealer_net_log,
       least(greatest(coalesce(net / nullif(amt, 0), 0), -5), 5) AS dealer_net_ratio, least(greatest(coalesce(buy / nullif(sell, 0), 0), 0), 20) AS dealer_buy_sell, coalesce(mx, 0) AS dealer_rate_max
       FROM user_days u JOIN ecal c ON c.day = u.day LEFT JOIN ({D_SQL}) d ON d.code = u.code AND d.day = c.prev_day""")
def _(t):
    buy = F.when(F.col("tag") == "purchase", F.col("value")).otherwise(0.0)
    tape = t.tape.withColumns({"buy": buy, "sell": F.col("value") - buy}).withColumn("net", F.col("buy") - F.col("sell"))
    roll = agg.dealer_list_rollup(tape.withColumn("amount", F.col("value")), ["code", "day"], "tag", ["net", "buy", "sell", "amount"], "value")
    roll = roll.select("code", "day", "entries", "reasons", *[F.col(f"{c}_sum").alias(c) for c in ("net", "buy", "sell", "amount")], F.col("value_max").alias("rate_max"))
    return op.dealer_list_features(t.user_days, roll, t.ecal)


@query("peer_slot_frame", "code:i bar:s close:r close_before:r ret:r tail_ret:r coarse:i",
       """SELECT a.code, strftime(a.ts, '%Y-%m-%d %H:%M') AS bar, a.close, b.close AS close_before, (a.close / d.pre_close - 1) * 100 AS ret, (a.close / b.close - 1) * 100 AS tail_ret, m.coarse FROM mbars a
       LEFT JOIN mbars b ON b.code = a.code AND b.ts = a.ts - INTERVAL 20 MINUTE LEFT JOIN daily d ON d.code = a.code AND d.day = a.day
       LEFT JOIN membership m ON m.code = a.code AND m.valid_from <= a.day AND (m.valid_to IS NULL OR m.valid_to > a.day)""")
def _(t):
    pre = t.daily.select("code", "day", "pre_close")
    member = joins.asof_join_interval(t.bars.select("code", "day"), t.membership, ["code"], "day", "valid_from", "valid_to", ["fine", "coarse"], ["code", "day"])
    out = op.peer_slot_frame(t.mbars, pre, member.drop("active_from"))
    return out.withColumn("bar", F.date_format("ts", "yyyy-MM-dd HH:mm"))


LOO_OUT = "peer_count:i peer_return_count:i peer_return_median:r peer_return_mean:r peer_return_q75:r peer_return_iqr:r peer_return_dispersion:r peer_return_max:r peer_positive_share:r peer_above_2_share:r peer_above_5_share:r peer_above_7_share:r peer_tail_median:r peer_tail_q75:r peer_tail_positive_share:r peer_own_excess:r peer_own_gap_to_q75:r peer_own_gap_to_max:r peer_own_percentile:r peer_own_log_amount_excess:r"


def loo_sql(group, pre="peer"):
    share = lambda c, x, n: f"avg((b.{c} > {x})::INT) AS {pre}_{n}_share"
    return f"""SELECT a.day, a.slot, a.code, count(b.code) AS {pre}_count, count(b.ret) AS {pre}_return_count, median(b.ret) AS {pre}_return_median, avg(b.ret) AS {pre}_return_mean, quantile_cont(b.ret, 0.75) AS {pre}_return_q75,
    quantile_cont(b.ret, 0.75) - quantile_cont(b.ret, 0.25) AS {pre}_return_iqr, stddev_pop(b.ret) AS {pre}_return_dispersion, max(b.ret) AS {pre}_return_max, {share('ret', 0, 'positive')}, {share('ret', 2, 'above_2')}, {share('ret', 5, 'above_5')},
    {share('ret', 7, 'above_7')}, median(b.ret_open) AS {pre}_tail_median, quantile_cont(b.ret_open, 0.75) AS {pre}_tail_q75, {share('ret_open', 0, 'tail_positive')}, any_value(a.ret) - median(b.ret) AS {pre}_own_excess,
    any_value(a.ret) - quantile_cont(b.ret, 0.75) AS {pre}_own_gap_to_q75, any_value(a.ret) - max(b.ret) AS {pre}_own_gap_to_max, avg((b.ret <= a.ret)::INT) AS {pre}_own_percentile,
    ln(1 + any_value(a.slot_amount)) - median(ln(1 + b.slot_amount)) AS {pre}_own_log_amount_excess FROM panel a LEFT JOIN panel b ON b.day = a.day AND b.slot = a.slot AND b.{group} = a.{group} AND b.code <> a.code WHERE a.t1_close IS NOT NULL GROUP BY a.day, a.slot, a.code"""


@query("loo_peer_features", f"day:d slot:s code:i {LOO_OUT}", loo_sql("nation"))
def _(t):
    return op.loo_peer_features(t.panel, t.panel.filter("t1_close is not null"), CS, "nation", "code", tail="ret_open", amount="slot_amount")


SHRUNK = ["return_median", "positive_share", "own_excess"]


@query("hierarchical_shrinkage", "day:d slot:s code:i log_fine_count:r fine_available:r any_available:r fine_shallow:r coarse_shallow:r fine_weight:r fine_share:r shrunk_return_median:r shrunk_positive_share:r shrunk_own_excess:r",
       f"""SELECT day, slot, code, ln(1 + nf) AS log_fine_count, (nf > 0)::INT AS fine_available, (nf > 0 OR nc > 0)::INT AS any_available, (nf < 2)::INT AS fine_shallow, (nc < 4)::INT AS coarse_shallow,
       CASE WHEN nf > 0 AND nc > 0 THEN nf / (nf + 6) ELSE (nf > 0)::INT END AS fine_weight, coalesce(least(nf / nullif(nc, 0), 1), 0) AS fine_share,
       {", ".join(f"coalesce(nf / (nf + 6) * fine_{m} + (1 - nf / (nf + 6)) * coarse_{m}, fine_{m}, coarse_{m}, 0) AS shrunk_{m}" for m in SHRUNK)}
       FROM (SELECT *, fine_count::DOUBLE AS nf, coarse_count::DOUBLE AS nc FROM ({loo_sql('nation', 'fine')}) JOIN ({loo_sql('region', 'coarse')}) USING (day, slot, code))""")
def _(t):
    cands = t.panel.filter("t1_close is not null")
    args = {"tail": "ret_open", "amount": "slot_amount"}
    fine = op.loo_peer_features(t.panel, cands, CS, "nation", "code", prefix="fine", **args)
    coarse = op.loo_peer_features(t.panel, cands, CS, "region", "code", prefix="coarse", **args)
    return op.hierarchical_shrinkage(fine.join(coarse, PK), SHRUNK)


# ---- events ----------------------------------------------------------------

SLOTS = ["10:00", "13:00", "16:00", "20:00"]
SLOT_SQL = "(VALUES " + ", ".join(f"('{s}')" for s in SLOTS) + ") v(slot)"
FIRST = "SELECT code, day, " + ", ".join(f"min(ts) FILTER (WHERE tag = '{g}') AS first_{g}" for g in ("touch", "open", "down")) + " FROM tape GROUP BY code, day"
FLAGS = f"""SELECT *, coalesce(first_touch <= cut, false)::INT AS touch, coalesce(first_open <= cut, false)::INT AS open, coalesce(first_down <= cut, false)::INT AS down,
  coalesce(first_touch <= cut AND first_touch > cut - INTERVAL 120 MINUTE, false)::INT AS touch_recent, coalesce(first_open <= cut AND first_open > cut - INTERVAL 120 MINUTE, false)::INT AS open_recent
  FROM (SELECT f.*, slot, CAST(day || ' ' || slot || ':00' AS TIMESTAMP) AS cut FROM ({FIRST}) f, {SLOT_SQL})"""
EVENT_NAMES = ["touch", "open", "down", "touch_recent", "open_recent"]
PROJ = f"SELECT day, slot, {', '.join(f'sum({n}) AS {n}_count' for n in EVENT_NAMES)}, greatest(sum(touch) - sum(open), 0) AS net_sealed, coalesce(sum(open)::DOUBLE / nullif(sum(touch), 0), 0) AS open_to_touch FROM ({FLAGS}) GROUP BY day, slot"


def first_events(t):
    return agg.first_event_times(t.tape, ["code", "day"], "ts", {g: F.col("tag") == g for g in ("touch", "open", "down")})


def event_cands(t):
    return t.user_days.withColumn("slot", F.explode(F.array(*[F.lit(s) for s in SLOTS])))


@query("causal_event_projection", "day:d slot:s touch_count:i open_count:i down_count:i touch_recent_count:i open_recent_count:i net_sealed:i open_to_touch:r", PROJ)
def _(t):
    return op.causal_event_projection(first_events(t), SLOTS, "120 minutes")


@query("candidate_event_state", "day:d slot:s code:i own_touch:b own_open:b own_down:b minutes_since_touch:m minutes_since_open:m touch_count:i",
       f"""SELECT f.day, f.slot, f.code, touch = 1 AS own_touch, open = 1 AS own_open, down = 1 AS own_down, CASE WHEN touch = 1 THEN date_diff('microsecond', first_touch, cut) / 60e6::DOUBLE END AS minutes_since_touch,
       CASE WHEN open = 1 THEN date_diff('microsecond', first_open, cut) / 60e6::DOUBLE END AS minutes_since_open, touch_count FROM ({FLAGS}) f JOIN ({PROJ}) p USING (day, slot)""")
def _(t):
    first = first_events(t)
    return op.candidate_event_state(event_cands(t), first, op.causal_event_projection(first, SLOTS, "120 minutes"))


LOOK = "user_days u JOIN ecal c ON c.day = u.day JOIN ecal d ON c.idx - d.idx BETWEEN 1 AND 5 JOIN tape e ON e.code = u.code AND e.day = d.day"
SOURCES = ["touch", "open", "view"]


@query("event_presence", "code:i day:d has_touch:b has_open:b has_view:b",
       f"""SELECT u.code, u.day, {', '.join(f"coalesce(has_{s}, false) AS has_{s}" for s in SOURCES)} FROM user_days u LEFT JOIN (SELECT u.code, u.day, {', '.join(f"bool_or(e.tag = '{s}') AS has_{s}" for s in SOURCES)}
       FROM {LOOK} GROUP BY u.code, u.day) h ON h.code = u.code AND h.day = u.day""")
def _(t):
    return op.event_presence(t.user_days, t.tape.withColumn("source", F.col("tag")), t.ecal, 5, SOURCES)


@query("event_window_features", "code:i day:d touch_count:i touch_active:i touch_latest_age:i touch_value_log:r touch_value_max:r open_count:i open_active:i open_weighted_value:r",
       f"""SELECT u.code, u.day, coalesce(tc, 0) AS touch_count, (coalesce(tc, 0) > 0)::INT AS touch_active, ta AS touch_latest_age, ln(1 + tv) AS touch_value_log, tm AS touch_value_max, coalesce(oc, 0) AS open_count, (coalesce(oc, 0) > 0)::INT AS open_active, ow AS open_weighted_value
       FROM user_days u LEFT JOIN (SELECT u.code, u.day, count(*) FILTER (WHERE tag = 'touch') AS tc, min(c.idx - d.idx) FILTER (WHERE tag = 'touch') AS ta, sum(value) FILTER (WHERE tag = 'touch') AS tv, max(value) FILTER (WHERE tag = 'touch') AS tm,
       count(*) FILTER (WHERE tag = 'open') AS oc, coalesce(sum(value * second(e.ts)) FILTER (WHERE tag = 'open') / nullif(sum(second(e.ts)) FILTER (WHERE tag = 'open'), 0), avg(value) FILTER (WHERE tag = 'open')) AS ow FROM {LOOK} GROUP BY u.code, u.day) h ON h.code = u.code AND h.day = u.day""")
def _(t):
    events = t.tape.withColumns({"source": F.col("tag"), "w": F.second("ts").cast("double")})
    aggs = {
        "touch": {"value_log": lambda only: F.log1p(F.sum(only("value"))), "value_max": lambda only: F.max(only("value"))},
        "open": {"weighted_value": lambda only: op.weighted_mean(only("value"), only("w"))},
    }
    return op.event_window_features(t.user_days, events, t.ecal, 5, aggs)


@query("weighted_mean_fallback", "code:i day:d weighted_mean:r",
       """SELECT code, day, CASE WHEN sum(greatest(w, 0)) > 0 THEN sum(value * greatest(w, 0)) / sum(greatest(w, 0)) ELSE avg(value) END AS weighted_mean FROM (SELECT *, second(ts) - 40 AS w FROM tape) GROUP BY code, day""")
def _(t):
    return op.weighted_mean_fallback(t.tape.withColumn("w", (F.second("ts") - 40).cast("double")), ["code", "day"], "value", "w")


def eco_level(lv):
    g = f"(SELECT day, slot, {lv}, {', '.join(f'sum({n}) AS {n}' for n in EVENT_NAMES)} FROM f GROUP BY ALL)"
    p = f"(SELECT day, {lv}, count(first_touch) AS touch, count(first_open) AS open FROM w GROUP BY ALL)"
    return g, p


@query("event_ecology", "day:d slot:s code:i fine_touch:i fine_open:i fine_touch_recent:i fine_members:i fine_touch_rate:r fine_open_to_touch:r fine_market_share:r fine_active:i prev_fine_touch:i prev_fine_open:i coarse_touch:i coarse_net_sealed:i prev_coarse_touch:i prev_coarse_touch_rate:r",
       f"""WITH f AS (SELECT z.*, fine, coarse FROM ({FLAGS}) z LEFT JOIN ufine USING (code)), w AS (SELECT z.*, fine, coarse FROM ({FIRST}) z LEFT JOIN ufine USING (code)),
       x AS (SELECT f.day, f.slot, f.code, mk.touch AS mt, greatest(coalesce(gf.touch, 0) - f.touch, 0) AS fine_touch, greatest(coalesce(gf.open, 0) - f.open, 0) AS fine_open, greatest(coalesce(gf.touch_recent, 0) - f.touch_recent, 0) AS fine_touch_recent,
       coalesce(nf.n, 0) - (f.fine IS NOT NULL)::INT AS fine_members, coalesce(nc.n, 0) - (f.coarse IS NOT NULL)::INT AS coarse_members,
       greatest(coalesce(pf.touch, 0) - (ow.first_touch IS NOT NULL AND f.fine IS NOT NULL)::INT, 0) AS prev_fine_touch, greatest(coalesce(pf.open, 0) - (ow.first_open IS NOT NULL AND f.fine IS NOT NULL)::INT, 0) AS prev_fine_open,
       greatest(coalesce(gc.touch, 0) - f.touch, 0) AS coarse_touch, greatest(coalesce(gc.open, 0) - f.open, 0) AS coarse_open, greatest(coalesce(pc.touch, 0) - (ow.first_touch IS NOT NULL AND f.coarse IS NOT NULL)::INT, 0) AS prev_coarse_touch
       FROM f JOIN ecal k ON k.day = f.day JOIN (SELECT day, slot, sum(touch) AS touch FROM f GROUP BY ALL) mk ON mk.day = f.day AND mk.slot = f.slot
       LEFT JOIN {eco_level('fine')[0]} gf ON gf.day = f.day AND gf.slot = f.slot AND gf.fine = f.fine LEFT JOIN {eco_level('coarse')[0]} gc ON gc.day = f.day AND gc.slot = f.slot AND gc.coarse = f.coarse
       LEFT JOIN {eco_level('fine')[1]} pf ON pf.day = k.prev_day AND pf.fine = f.fine LEFT JOIN {eco_level('coarse')[1]} pc ON pc.day = k.prev_day AND pc.coarse = f.coarse
       LEFT JOIN w ow ON ow.code = f.code AND ow.day = k.prev_day LEFT JOIN (SELECT fine, count(*) AS n FROM ufine GROUP BY fine) nf ON nf.fine = f.fine LEFT JOIN (SELECT coarse, count(*) AS n FROM ufine GROUP BY coarse) nc ON nc.coarse = f.coarse)
       SELECT *, coalesce(fine_touch::DOUBLE / nullif(fine_members, 0), 0) AS fine_touch_rate, coalesce(fine_open::DOUBLE / nullif(fine_touch, 0), 0) AS fine_open_to_touch, coalesce(fine_touch::DOUBLE / nullif(mt, 0), 0) AS fine_market_share,
       (fine_touch > 0)::INT AS fine_active, greatest(coarse_touch - coarse_open, 0) AS coarse_net_sealed, coalesce(prev_coarse_touch::DOUBLE / nullif(coarse_members, 0), 0) AS prev_coarse_touch_rate FROM x""")
def _(t):
    return op.event_ecology(event_cands(t), first_events(t), t.ufine, t.ecal, SLOTS, recent="120 minutes")
