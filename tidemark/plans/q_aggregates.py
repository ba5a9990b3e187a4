"""Queries for grouped rollups and score quality."""

from pyspark.sql import functions as F

from ..functions import hash_unit
from ..operators import aggregates as op
from ..operators.features import basket_regime_frame
from ..operators.spread import best_rows, position
from .registry import query


@query("dealer_list_rollup", "code:i day:d entries:i reasons:i value_sum:r value_max:r",
       "SELECT code, day, count(*) AS entries, count(DISTINCT tag) AS reasons, sum(value) AS value_sum, max(value) AS value_max FROM tape GROUP BY code, day")
def _(t):
    return op.dealer_list_rollup(t.tape, ["code", "day"], "tag", ["value"], "value")


@query("pair_quality_rollup", "code:i day:d bars:i valid_bars:i first_bar:s last_bar:s has_close:b covered:b",
       """SELECT p.code, p.day, coalesce(n, 0) AS bars, coalesce(v, 0) AS valid_bars, f AS first_bar, l AS last_bar, coalesce(l = '14:20', false) AS has_close,
       coalesce(l = '14:20' AND v >= 3, false) AS covered FROM (SELECT DISTINCT code, day FROM slot_bars) p LEFT JOIN
       (SELECT code, day, count(*) AS n, count(*) FILTER (WHERE amount > 30000) AS v, min(strftime(ts, '%H:%M')) AS f, max(strftime(ts, '%H:%M')) AS l FROM mbars GROUP BY 1, 2) b
       ON b.code = p.code AND b.day = p.day""")
def _(t):
    bars = t.mbars.withColumn("clock", F.date_format("ts", "HH:mm"))
    return op.pair_quality_rollup(bars, t.slot_bars, ["code", "day"], F.col("amount") > 30000, "clock", "14:20", 3)


@query("first_event_times", "code:i day:d first_touch:s first_open:s first_down:s",
       "SELECT code, day, " + ", ".join(f"strftime(min(ts) FILTER (WHERE tag = '{g}'), '%H:%M:%S') AS first_{g}" for g in ("touch", "open", "down")) + " FROM tape GROUP BY code, day")
def _(t):
    out = op.first_event_times(t.tape, ["code", "day"], "ts", {g: F.col("tag") == g for g in ("touch", "open", "down")})
    return out.select("code", "day", *[F.date_format(c, "HH:mm:ss").alias(c) for c in out.columns[2:]])


EXPERTS = """SELECT day, slot, code, e, CAST('0x' || substr(md5(concat_ws('|', code, day, slot, 'x', e)), 1, 15) AS BIGINT)::DOUBLE / pow(2, 60) AS pe, net * e AS re, risk / e AS ke
  FROM scored, (VALUES (1), (2), (3)) v(e) WHERE p > e * 0.2::DOUBLE"""


@query("expert_aggregate", "day:d slot:s code:i experts:i p_median:r p_min:r p_spread:r ret_median:r ret_lower:r risk_max:r score_median:r expert_ids:s",
       f"""SELECT day, slot, code, count(DISTINCT e) AS experts, median(pe) AS p_median, min(pe) AS p_min, max(pe) - min(pe) AS p_spread, median(re) AS ret_median,
       min(re) - 0.5 * coalesce(stddev_samp(re), 0) AS ret_lower, max(ke) AS risk_max, median(pe - ke) AS score_median,
       string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS expert_ids FROM ({EXPERTS}) GROUP BY day, slot, code""")
def _(t):
    e = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))
    long = t.scored.withColumn("expert", e).filter(F.col("p") > F.col("expert") * F.lit(0.2))
    long = long.withColumns({
        "p_positive": hash_unit("code", "day", "slot", F.lit("x"), "expert"),
        "expected": F.col("net") * F.col("expert"), "p_severe": F.col("risk") / F.col("expert"),
    }).withColumn("score", F.col("p_positive") - F.col("p_severe"))
    return op.expert_aggregate(long, ["day", "slot", "code"])


@query("daily_equal_weight", "slot:s days:i day_equal_mean:r day_win_rate:r",
       "SELECT slot, count(*) AS days, avg(m) AS day_equal_mean, avg((m > 0)::INT) AS day_win_rate FROM (SELECT slot, day, avg(net) AS m FROM scored GROUP BY slot, day) GROUP BY slot")
def _(t):
    return op.daily_equal_weight(t.scored, "day", "net", ["slot"])


REASONS = "concat_ws('|', CASE WHEN p < 0.5 THEN 'low_p' END, CASE WHEN risk > 0.5 THEN 'high_risk' END, CASE WHEN NOT entry_ok THEN 'no_entry' END)"


def reasons(t):
    return t.scored.withColumn("reasons", F.concat_ws(
        "|", F.when(F.col("p") < 0.5, "low_p"), F.when(F.col("risk") > 0.5, "high_risk"), F.when(~F.col("entry_ok"), "no_entry")))


@query("rejection_reason_counts", "reason:s n:i",
       f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({REASONS}, '|')) AS reason FROM scored) WHERE reason <> '' GROUP BY reason")
def _(t):
    return op.rejection_reason_counts(reasons(t), "reasons")


@query("rejection_summary", "reasons:s rows:i days:i codes:i",
       f"SELECT {REASONS} AS reasons, count(*) AS rows, count(DISTINCT day) AS days, count(DISTINCT code) AS codes FROM scored GROUP BY 1")
def _(t):
    return op.rejection_summary(reasons(t), "reasons", "day", "code")


@query("stock_day_rollup", "day:d code:i best_q:r best_p:r least_risk:r",
       "SELECT day, code, max(q) AS best_q, max(p) AS best_p, min(risk) AS least_risk FROM scored GROUP BY day, code")
def _(t):
    return op.stock_day_rollup(t.scored, ["day"], ["code"], {"best_q": F.max("q"), "best_p": F.max("p"), "least_risk": F.min("risk")})


BASKET_OUT = "day:d slot:s members:i member_list:s ret_median:r ret_iqr:r up_breadth:r basket_mean:r basket_min:r positive_share:r target_good:i target_margin:i target_severe:i"
BASKET_SPEC = {"code": "code", "medians": ["ret"], "iqrs": ["ret"], "breadth": {"up": ("ret", 1.0)}, "net": "net"}
BASKET = """SELECT *, (basket_mean > 0 AND positive_share > 0.5)::INT AS target_good, (basket_mean > 0.5 AND positive_share > 0.5)::INT AS target_margin, (basket_min <= -2)::INT AS target_severe FROM (
  SELECT day, slot, count(*) AS members, string_agg(CAST(code AS VARCHAR), '|' ORDER BY r) AS member_list, median(ret) AS ret_median, quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) AS ret_iqr,
  avg(coalesce((ret > 1)::INT, 0)) AS up_breadth, avg(net) AS basket_mean, min(net) AS basket_min, avg((net > 0)::INT) AS positive_share
  FROM (SELECT *, row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) AS r FROM scored WHERE {}) WHERE r <= 10 GROUP BY day, slot HAVING count(*) >= 5)"""


@query("basket_rollup", BASKET_OUT, BASKET.format("true"))
def _(t):
    order = [F.col("p").desc(), F.col("code")]
    ranked = position(best_rows(t.scored, ["day", "slot"], order, 10), ["day", "slot"], order, "_rank", bound=10)
    return op.basket_rollup(ranked, ["day", "slot"], min_members=5, n=10, **BASKET_SPEC)


@query("basket_regime_frame", BASKET_OUT, BASKET.format("entry_ok"))
def _(t):
    return basket_regime_frame(t.scored, ["day", "slot"], F.col("entry_ok"), [F.col("p").desc(), F.col("code")], 10, 5, **BASKET_SPEC)


@query("group_member_counts", "day:d slot:s nation:i members:i",
       "SELECT day, slot, nation, count(DISTINCT code) AS members FROM panel GROUP BY day, slot, nation")
def _(t):
    return op.group_member_counts(t.panel, ["day", "slot", "nation"], "code")


@query("peer_group_count", "day:d slot:s large_groups:i groups:i",
       "SELECT day, slot, count(*) FILTER (WHERE n >= 4) AS large_groups, count(*) AS groups FROM (SELECT day, slot, nation, count(DISTINCT code) AS n FROM panel GROUP BY 1, 2, 3) GROUP BY day, slot")
def _(t):
    return op.peer_group_count(t.panel, ["day", "slot"], "nation", "code", 4)


# rounded scores make ties
TIED = "SELECT *, round(p, 2) AS s FROM scored"


def tied(t):
    return t.scored.withColumn("s", F.round("p", 2))


@query("binary_rank_auc", "fold:i rows:i positives:i auc:r",
       f"""SELECT fold, count(*) AS rows, sum(win::INT) AS positives, (sum(CASE WHEN win THEN r ELSE 0 END) - sum(win::INT)::DOUBLE * (sum(win::INT) + 1) / 2) / (sum(win::INT)::DOUBLE * (count(*) - sum(win::INT))) AS auc
       FROM (SELECT fold, win, rank() OVER (PARTITION BY fold ORDER BY s) + (count(*) OVER (PARTITION BY fold, s) - 1) / 2.0::DOUBLE AS r FROM ({TIED})) GROUP BY fold""")
def _(t):
    return op.binary_rank_auc(tied(t), "win", "s", ["fold"])


@query("average_precision", "fold:i positives:i average_precision:r",
       f"""SELECT fold, sum(pos) AS positives, sum(pos * tp / n) / sum(pos) AS average_precision FROM (SELECT fold, pos, sum(pos) OVER w::DOUBLE AS tp, sum(c) OVER w AS n
       FROM (SELECT fold, s, sum(win::INT) AS pos, count(*) AS c FROM ({TIED}) GROUP BY fold, s) WINDOW w AS (PARTITION BY fold ORDER BY s DESC)) GROUP BY fold""")
def _(t):
    return op.average_precision(tied(t), "win", "s", ["fold"])


@query("brier_logloss", "fold:i rows:i brier:r log_loss:r",
       """SELECT fold, count(*) AS rows, avg((x - y) * (x - y)) AS brier, avg(-(y * ln(x) + (1 - y) * ln(1 - x))) AS log_loss FROM (
       SELECT fold, least(greatest(p, 1e-6), 1 - 1e-6) AS x, win::INT AS y FROM scored) GROUP BY fold""")
def _(t):
    return op.brier_logloss(t.scored, "win", "p", ["fold"])


@query("loss_concentration", "fold:i total_loss:r top_10_share:r top_20_share:r",
       """SELECT fold, sum(l) AS total_loss, sum(l) FILTER (WHERE r <= 10) / sum(l) AS top_10_share, sum(l) FILTER (WHERE r <= 20) / sum(l) AS top_20_share FROM (
       SELECT fold, -net AS l, row_number() OVER (PARTITION BY fold ORDER BY net) AS r FROM scored WHERE net < 0) GROUP BY fold""")
def _(t):
    return op.loss_concentration(t.scored, "net", by=["fold"])


@query("score_quantile_summary", "score:s n:i min:r q01:r q05:r q25:r q50:r q75:r q95:r q99:r max:r",
       " UNION ALL ".join(f"""SELECT '{c}' AS score, count({c}) AS n, min({c}) AS min, quantile_cont({c}, 0.01) AS q01, quantile_cont({c}, 0.05) AS q05, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75, quantile_cont({c}, 0.95) AS q95,
       quantile_cont({c}, 0.99) AS q99, max({c}) AS max FROM scored""" for c in ("p", "q", "net")))
def _(t):
    return op.score_quantile_summary(t.scored, ["p", "q", "net"])


def options(t):
    """Parts as an option chain: brand is the underlying, size the days to expiry."""
    spot = F.lit(950.0)
    return t.part.select(
        F.col("p_brand").alias("family"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("side"),
        (F.floor(F.col("p_retailprice") / 20) * 20).alias("strike"), F.col("p_size").alias("dte"), spot.alias("spot"),
        F.round(F.abs(F.col("p_retailprice") - spot) + 5, 1).alias("close"), F.col("p_size").alias("vol"), (F.col("p_partkey") % 97).alias("oi"))


OPTIONS = """SELECT p_brand AS family, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS side, floor(p_retailprice / 20) * 20 AS strike, p_size AS dte, 950.0::DOUBLE AS spot,
  round(abs(p_retailprice - 950) + 5, 1) AS close, p_size AS vol, p_partkey % 97 AS oi FROM part"""


@query("put_call_ratios", "family:s put_call_vol:r put_call_oi:r",
       "SELECT family, " + ", ".join(f"(coalesce(sum({c}) FILTER (WHERE side = 'put'), 0) + 1)::DOUBLE / (coalesce(sum({c}) FILTER (WHERE side = 'call'), 0) + 1) AS put_call_{c}" for c in ("vol", "oi")) + f" FROM ({OPTIONS}) GROUP BY family")
def _(t):
    return op.put_call_ratios(options(t), ["family"], "side", ["vol", "oi"])


@query("topn_concentration", "family:s concentration:r",
       f"SELECT family, sum(oi) FILTER (WHERE r <= 5)::DOUBLE / sum(oi) AS concentration FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY oi DESC) AS r FROM ({OPTIONS})) GROUP BY family")
def _(t):
    return op.topn_concentration(options(t), ["family"], "oi", 5)


ATM = f"""SELECT family, dte, strike, spot, call, put, (call + put) / spot * 100 AS straddle_pct, put / call AS premium_ratio FROM (
  SELECT family, dte, strike, spot, max(close) FILTER (WHERE side = 'call') AS call, max(close) FILTER (WHERE side = 'put') AS put
  FROM (SELECT *, min(dte) OVER (PARTITION BY family) AS nd FROM ({OPTIONS}) o WHERE dte BETWEEN 7 AND 45 AND family IN (SELECT family FROM ({OPTIONS}) GROUP BY 1 HAVING count(*) FILTER (WHERE side = 'call') >= 5 AND count(*) FILTER (WHERE side = 'put') >= 5))
  WHERE dte = nd GROUP BY ALL) WHERE call IS NOT NULL AND put IS NOT NULL QUALIFY row_number() OVER (PARTITION BY family ORDER BY abs(strike - spot), strike) = 1"""


@query("atm_strike_pick", "family:s dte:i strike:r straddle_pct:r premium_ratio:r", ATM)
def _(t):
    return op.atm_strike_pick(options(t), ["family"], "spot")


@query("period_rollup", "level:s year:i month:s day:s slot:s trades:i wins:i win_rate:r mean_net:r worst:r",
       """SELECT CASE grouping_id(y, m, d, slot) WHEN 0 THEN 'day_slot' WHEN 1 THEN 'day' WHEN 3 THEN 'month' WHEN 7 THEN 'year' WHEN 14 THEN 'slot' ELSE 'total' END AS level, y AS year, m AS month, d AS day, slot,
       count(*) AS trades, count(*) FILTER (WHERE win) AS wins, avg(win::INT) AS win_rate, avg(net) AS mean_net, min(net) AS worst
       FROM (SELECT *, year(day) AS y, strftime(day, '%Y%m') AS m, CAST(day AS VARCHAR) AS d FROM scored) GROUP BY GROUPING SETS ((y, m, d, slot), (y, m, d), (y, m), (y), (slot), ())""")
def _(t):
    return op.period_rollup(t.scored, "day", "slot", "net")


