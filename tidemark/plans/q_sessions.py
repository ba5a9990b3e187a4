"""Queries for session paths, pairs, derivatives, snapshots and masks."""

from pyspark.sql import functions as F

from ..operators import joins
from ..operators import session_features as op
from ..operators import windows
from .q_aggregates import ATM, OPTIONS, options
from .registry import query

CS, PK = ["day", "slot"], ["day", "slot", "code"]
# session time each slot can see
CUTS = {"14:00": "10:30", "14:20": "11:40", "14:35": "12:50", "14:50": "14:30"}
CUT_SQL = "CAST(day || ' ' || CASE slot " + " ".join(f"WHEN '{k}' THEN '{v}:00'" for k, v in CUTS.items()) + " END AS TIMESTAMP)"


def cut_column():
    clock = F.create_map(*[F.lit(x) for kv in CUTS.items() for x in kv])[F.col("slot")]
    return F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))


def cands(t):
    return t.session_slots.select("day", "slot", "code", F.col("close").alias("price")).withColumn("cutoff", cut_column())


SEEN = f"""SELECT c.day, c.slot, c.code, c.price, cut, m.ts, m.open, m.high, m.low, m.close, m.amount, m.vol FROM (SELECT day, slot, code, close AS price, {CUT_SQL} AS cut FROM slot_bars) c
  JOIN mbars m ON m.code = c.code AND m.day = c.day AND m.ts <= cut"""
K = "PARTITION BY day, slot, code"
PATH = f"""SELECT *, row_number() OVER w AS i, count(*) OVER ({K}) AS n, close / lag(close) OVER w - 1 AS r, abs(close - lag(close) OVER w) AS mv, max(close) OVER w AS peak,
  max(high) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph, min(low) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM ({SEEN}) WINDOW w AS ({K} ORDER BY ts)"""
MICRO = f"""SELECT *, lag(r) OVER w AS pr, max(CASE WHEN NOT coalesce(r > 0, false) THEN i END) OVER w AS nu, max(CASE WHEN NOT coalesce(r < 0, false) THEN i END) OVER w AS nd FROM ({PATH}) WINDOW w AS ({K} ORDER BY ts)"""


def last(c, k=0):
    return f"max({c}) FILTER (WHERE n - i = {k})"


@query("minute_microstructure", "day:d slot:s code:i m_rows:i m_zero_amount_share:r m_ret_1:r m_ret_3:r m_ret_5:r m_ret_from_base:r m_volatility:r m_downside_volatility:r m_skew:r m_autocorr:r m_efficiency:r m_max_drawdown:r m_rebound:r m_reversal:r m_up_share:r m_down_share:r m_max_up_streak:i m_max_down_streak:i m_imbalance:r m_amihud:r m_concentration:r m_last3_share:r m_last5_share:r m_acceleration:r m_vwap_gap:r m_close_position:r m_upper_wick:r m_lower_wick:r m_high_breaks:i m_low_breaks:i m_last5_vs_prior5:r",
       f"""SELECT c.day, c.slot, c.code, coalesce(m_rows, 0) AS m_rows, f.* EXCLUDE (day, slot, code, m_rows) FROM slot_bars c LEFT JOIN (SELECT day, slot, code, count(*) AS m_rows, avg((amount <= 0)::INT) AS m_zero_amount_share,
       {", ".join(f"({last('close')} / {last('close', k)} - 1) * 100 AS m_ret_{k}" for k in (1, 3, 5))}, ({last('close')} / max(close) FILTER (WHERE strftime(ts, '%H:%M') = '10:00') - 1) * 100 AS m_ret_from_base,
       stddev_pop(r) * 100 AS m_volatility, CASE WHEN count(*) FILTER (WHERE r < 0) >= 2 THEN stddev_pop(r) FILTER (WHERE r < 0) * 100 ELSE 0 END AS m_downside_volatility,
       CASE WHEN count(r) >= 3 THEN skewness(r) END AS m_skew, CASE WHEN count(r) >= 4 THEN covar_pop(r, pr) / nullif(stddev_pop(r) FILTER (WHERE pr IS NOT NULL) * stddev_pop(pr) FILTER (WHERE r IS NOT NULL), 0) END AS m_autocorr,
       coalesce(({last('close')} - max(close) FILTER (WHERE i = 1)) / nullif(sum(mv), 0), 0) AS m_efficiency, min((close / peak - 1) * 100) AS m_max_drawdown, ({last('close')} / min(low) - 1) * 100 AS m_rebound, ({last('close')} / max(high) - 1) * 100 AS m_reversal,
       avg((r > 0)::INT) AS m_up_share, avg((r < 0)::INT) AS m_down_share, coalesce(max(i - coalesce(nu, 0)) FILTER (WHERE r > 0), 0) AS m_max_up_streak, coalesce(max(i - coalesce(nd, 0)) FILTER (WHERE r < 0), 0) AS m_max_down_streak,
       sum(sign(coalesce(r, 0)) * amount) / sum(amount) AS m_imbalance, avg(abs(r) / nullif(amount, 0)) * 1e8 AS m_amihud, sum(amount * amount) / (sum(amount) * sum(amount)) AS m_concentration,
       sum(amount) FILTER (WHERE n - i < 3) / sum(amount) AS m_last3_share, sum(amount) FILTER (WHERE n - i < 5) / sum(amount) AS m_last5_share,
       CASE WHEN count(*) >= 10 THEN avg(amount) FILTER (WHERE n - i < 5) / avg(amount) FILTER (WHERE n - i >= 5 AND n - i < 10) END AS m_acceleration, ({last('close')} / (sum(close * vol) / sum(vol)) - 1) * 100 AS m_vwap_gap,
       CASE WHEN max(high) > min(low) THEN ({last('close')} - min(low)) / (max(high) - min(low)) ELSE 0.5 END AS m_close_position, avg((high - greatest(open, close)) / close) * 100 AS m_upper_wick, avg((least(open, close) - low) / close) * 100 AS m_lower_wick,
       sum(coalesce(high > ph, false)::INT) AS m_high_breaks, sum(coalesce(low < pl, false)::INT) AS m_low_breaks,
       CASE WHEN count(*) >= 11 THEN ({last('close')} / {last('close', 5)} - {last('close', 5)} / {last('close', 10)}) * 100 END AS m_last5_vs_prior5 FROM ({MICRO}) GROUP BY day, slot, code) f USING (day, slot, code)""")
def _(t):
    return op.minute_microstructure(cands(t), t.session_bars, PK, start="09:30", base="10:00")


FULL = f"""SELECT *, coalesce(r, 0) AS q, lag(coalesce(r, 0)) OVER w AS pq, b <= '11:30' AS am, b >= '13:00' AS pm, b <= '10:00' AS op, b >= '14:00' AS la,
  CASE WHEN lag(b) OVER w <= '11:30' THEN coalesce(r, 0) ELSE 0 END AS ra, CASE WHEN lag(b) OVER w >= '13:00' THEN coalesce(r, 0) ELSE 0 END AS rp,
  CASE WHEN sum(amount) OVER ({K}) > 0 THEN sum(close * amount) OVER ({K}) / sum(amount) OVER ({K}) END AS vw FROM (SELECT *, strftime(ts, '%H:%M') AS b FROM ({PATH})) WINDOW w AS ({K} ORDER BY ts)"""


def seg(f):
    return f"coalesce((arg_max(close, i) FILTER (WHERE {f}) / arg_min(open, i) FILTER (WHERE {f}) - 1) * 100, 0)"


def imb(f, r):
    return f"coalesce(sum(sign({r}) * amount) FILTER (WHERE {f}) / nullif(sum(amount) FILTER (WHERE {f}), 0), 0)"


def dev(f):
    return f"CASE WHEN count(*) FILTER (WHERE {f}) >= 2 THEN stddev_pop(q) FILTER (WHERE {f}) ELSE 0 END"


S_NAMES = "s_return s_opening_return s_morning_return s_afternoon_return s_lunch_gap s_late_return s_morning_range s_afternoon_range s_volatility s_downside_volatility s_efficiency s_max_drawdown s_rebound s_reversal s_vwap_gap s_above_vwap_share s_close_position s_opening_share s_morning_share s_recent_share s_acceleration s_imbalance s_morning_imbalance s_afternoon_imbalance s_flow_agreement s_price_amount_corr s_amihud s_high_time s_low_time s_since_high s_since_low s_zero_amount_share s_autocorr s_volatility_ratio".split()


@query("full_session_path", "day:d slot:s code:i s_rows:i s_complete:b s_coverage:r " + " ".join(f"{n}:r" for n in S_NAMES),
       f"""SELECT c.day, c.slot, c.code, coalesce(s_rows, 0) AS s_rows, coalesce(s_rows > 0 AND abs(lc / c.close - 1) * 10000 <= 50 AND least(s_rows / 3.0::DOUBLE, 1) >= 0.9, false) AS s_complete, least(coalesce(s_rows, 0) / 3.0::DOUBLE, 1) AS s_coverage,
       {", ".join(f"coalesce({n}, 0) AS {n}" for n in S_NAMES)} FROM slot_bars c LEFT JOIN (SELECT *, CASE WHEN p30 > 0 THEN v30 / p30 ELSE 0 END AS s_volatility_ratio, (n0 - 1 - h) / greatest(n0 - 1, 1) AS s_since_high, (n0 - 1 - l) / greatest(n0 - 1, 1) AS s_since_low,
       h / greatest(n0 - 1, 1) AS s_high_time, l / greatest(n0 - 1, 1) AS s_low_time, sign(s_morning_imbalance) * sign(s_afternoon_imbalance) AS s_flow_agreement, CASE WHEN a30 > 0 THEN a15 / a30 - 1 ELSE 0 END AS s_acceleration FROM (
       SELECT day, slot, code, count(*) AS s_rows, count(*)::DOUBLE AS n0, {last('close')} AS lc, ({last('close')} / max(open) FILTER (WHERE i = 1) - 1) * 100 AS s_return, {seg('op')} AS s_opening_return, {seg('am')} AS s_morning_return, {seg('pm')} AS s_afternoon_return,
       coalesce((arg_min(open, i) FILTER (WHERE pm) / arg_max(close, i) FILTER (WHERE am) - 1) * 100, 0) AS s_lunch_gap, {seg('la')} AS s_late_return, coalesce((max(high) FILTER (WHERE am) / min(low) FILTER (WHERE am) - 1) * 100, 0) AS s_morning_range,
       coalesce((max(high) FILTER (WHERE pm) / min(low) FILTER (WHERE pm) - 1) * 100, 0) AS s_afternoon_range, ({dev('true')}) * 100 AS s_volatility, ({dev('q < 0')}) * 100 AS s_downside_volatility,
       coalesce(abs({last('close')} / max(open) FILTER (WHERE i = 1) - 1) / nullif(sum(abs(q)), 0), 0) AS s_efficiency, min((close / peak - 1) * 100) AS s_max_drawdown, ({last('close')} / min(low) - 1) * 100 AS s_rebound, ({last('close')} / max(high) - 1) * 100 AS s_reversal,
       ({last('close')} / max(vw) - 1) * 100 AS s_vwap_gap, avg((close > vw)::INT) AS s_above_vwap_share, CASE WHEN max(high) > min(low) THEN ({last('close')} - min(low)) / (max(high) - min(low)) ELSE 0.5 END AS s_close_position,
       coalesce(sum(amount) FILTER (WHERE op), 0) / sum(amount) AS s_opening_share, coalesce(sum(amount) FILTER (WHERE am), 0) / sum(amount) AS s_morning_share, sum(amount) FILTER (WHERE n - i < 4) / sum(amount) AS s_recent_share,
       sum(amount) FILTER (WHERE n - i < 2) AS a15, CASE WHEN count(*) >= 4 THEN sum(amount) FILTER (WHERE n - i >= 2 AND n - i < 4) ELSE 0 END AS a30,
       sum(sign(q) * amount) / sum(amount) AS s_imbalance, {imb('am', 'ra')} AS s_morning_imbalance, {imb('pm', 'rp')} AS s_afternoon_imbalance, CASE WHEN count(*) >= 3 THEN coalesce(covar_pop(q, amount) / nullif(stddev_pop(q) * stddev_pop(amount), 0), 0) ELSE 0 END AS s_price_amount_corr,
       avg(coalesce(abs(q) / nullif(amount, 0), 0)) * 1e6 AS s_amihud, arg_min(i, ROW(-high, i)) - 1 AS h, arg_min(i, ROW(low, i)) - 1 AS l, avg((amount <= 0)::INT) AS s_zero_amount_share,
       CASE WHEN count(*) >= 3 THEN coalesce(covar_pop(q, pq) FILTER (WHERE i > 1) / nullif(stddev_pop(q) FILTER (WHERE i > 1) * stddev_pop(pq) FILTER (WHERE i > 1), 0), 0) ELSE 0 END AS s_autocorr,
       {dev('n - i < 4')} AS v30, {dev('n - i >= 4 AND (n < 8 OR n - i < 8)')} AS p30 FROM ({FULL}) GROUP BY day, slot, code)) f USING (day, slot, code)""")
def _(t):
    c = cands(t).withColumn("expected", F.lit(3.0))
    return op.full_session_path(c, t.session_bars, PK, expected="expected", recent=4)


A = """SELECT a.code, a.day, a.ts, a.close AS p, b.close * 1.001::DOUBLE AS e FROM mbars a LEFT JOIN mbars b ON b.code = a.code AND b.ts = a.ts + INTERVAL 60 MINUTE"""
CONF = f"""SELECT a.*, m.ts AS mt, m.high, m.low, m.close, m.amount, row_number() OVER w AS i, count(*) OVER (PARTITION BY a.code, a.ts) AS n, coalesce(lag(m.close) OVER w, p) AS pc FROM ({A}) a JOIN mbars m ON m.code = a.code AND m.day = a.day AND m.ts > a.ts AND m.ts <= a.ts + INTERVAL 50 MINUTE
  WINDOW w AS (PARTITION BY a.code, a.ts ORDER BY m.ts)"""
C_NAMES = "c_return c_range c_extension c_drawdown c_rebound c_reversal c_close_position c_vwap_gap c_up_share c_efficiency c_imbalance c_acceleration c_last2_return c_zero_amount_share".split()


@query("post_alert_confirmation", "code:i bar:s c_rows:i c_public_price:r c_amount_ratio:r c_entry_error_bps:r " + " ".join(f"{n}:r" for n in C_NAMES),
       f"""SELECT a.code, strftime(a.ts, '%Y-%m-%d %H:%M') AS bar, coalesce(c_rows, 0) AS c_rows, lc AS c_public_price, mean / pm AS c_amount_ratio, abs(x.close * 1.001::DOUBLE / a.e - 1) * 10000 AS c_entry_error_bps, {", ".join(C_NAMES)} FROM ({A}) a
       LEFT JOIN (SELECT code, ts, count(*) AS c_rows, {last('close')} AS lc, avg(amount) AS mean, ({last('close')} / max(p) - 1) * 100 AS c_return, (max(high) / min(low) - 1) * 100 AS c_range, (max(high) / max(p) - 1) * 100 AS c_extension, (min(low) / max(p) - 1) * 100 AS c_drawdown,
       ({last('close')} / min(low) - 1) * 100 AS c_rebound, ({last('close')} / max(high) - 1) * 100 AS c_reversal, CASE WHEN max(high) > min(low) THEN ({last('close')} - min(low)) / (max(high) - min(low)) ELSE 0.5 END AS c_close_position,
       ({last('close')} / (sum(close * amount) / sum(amount)) - 1) * 100 AS c_vwap_gap, avg((close > pc)::INT) AS c_up_share, coalesce(({last('close')} - max(p)) / nullif(sum(abs(close - pc)), 0), 0) AS c_efficiency, sum(sign(close / pc - 1) * amount) / sum(amount) AS c_imbalance,
       CASE WHEN count(*) >= 2 THEN avg(amount) FILTER (WHERE i >= n - 1) / avg(amount) FILTER (WHERE i <= 2) END AS c_acceleration, CASE WHEN count(*) >= 3 THEN ({last('close')} / {last('close', 2)} - 1) * 100 WHEN count(*) = 2 THEN ({last('close')} / max(p) - 1) * 100 END AS c_last2_return,
       avg((amount <= 0)::INT) AS c_zero_amount_share FROM ({CONF}) GROUP BY code, ts) f ON f.code = a.code AND f.ts = a.ts
       LEFT JOIN (SELECT code, ts, avg(amount) AS pm FROM (SELECT a.code, a.ts, m.amount FROM ({A}) a JOIN mbars m ON m.code = a.code AND m.day = a.day AND m.ts <= a.ts QUALIFY row_number() OVER (PARTITION BY a.code, a.ts ORDER BY m.ts DESC) <= 3) GROUP BY 1, 2) g ON g.code = a.code AND g.ts = a.ts
       LEFT JOIN mbars x ON x.code = a.code AND x.ts = a.ts + INTERVAL 60 MINUTE""")
def _(t):
    nxt = joins.session_offset_values(t.session_bars.select("code", "day", "ts", "close"), ["code", "day"], "ts", "60 minutes", ["close"])
    c = nxt.select("code", "day", "ts", F.col("close").alias("price"), (F.col("close_at") * 1.001).alias("entry_price")).withColumn("key_ts", F.col("ts"))
    out = op.post_alert_confirmation(c, t.session_bars, ["code", "day", "key_ts"], delay="50 minutes", entry_delay="60 minutes", prior_n=3, expected=3)
    return out.withColumn("bar", F.date_format("key_ts", "yyyy-MM-dd HH:mm"))


# a nation's bars against its region's bars: fund and future
ETF = "SELECT s_nationkey AS pair, day, dom, arg_max(price, o) AS close, sum(cents) / 100.0::DOUBLE AS amount FROM lines JOIN supplier ON s_suppkey = code WHERE l_linestatus = 'O' GROUP BY ALL"
FUT = "SELECT s_nationkey AS pair, day, dom, arg_max(price, o) AS close, sum(cents) / 100.0::DOUBLE AS amount, sum(qty) AS oi FROM lines JOIN supplier ON s_suppkey = code WHERE l_linestatus = 'F' GROUP BY ALL"
STAMP = "day + INTERVAL 570 MINUTE + (dom - 1) * INTERVAL 10 MINUTE"


def pair_series(t, status):
    home = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("pair"))
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(570) + (F.col("dom") - 1) * 10)
    return t.lines.filter(F.col("l_linestatus") == status).join(home, "code").groupBy("pair", "day", "dom").agg(
        F.max_by("price", "o").alias("close"), (F.sum("cents") / F.lit(100.0)).alias("amount"), F.sum("qty").alias("oi")).withColumn("ts", at)


def _pair_frame(t):
    etf, fut = pair_series(t, "O"), pair_series(t, "F")
    slots = etf.select("pair", "day").distinct().withColumn("slot", F.explode(F.array(F.lit("14:20"), F.lit("14:50"))))
    return op.pair_spread_features(etf, fut, slots.withColumn("cutoff", cut_column()), ["pair", "day", "slot"])


def side_sql(src, tag, oi=False):
    extra = ", (arg_max(oi, ts) / arg_min(oi, ts) - 1) * 100 AS oi_change, CASE WHEN count(*) FILTER (WHERE w) >= 2 THEN (arg_max(oi, ts) / arg_min(oi, ts) FILTER (WHERE w) - 1) * 100 ELSE 0 END AS oi_change_w" if oi else ""
    return f"""SELECT pair, day, slot, (arg_max(close, ts) / arg_min(close, ts) - 1) * 100 AS {tag}_return, CASE WHEN count(*) FILTER (WHERE w) >= 2 THEN (arg_max(close, ts) / arg_min(close, ts) FILTER (WHERE w) - 1) * 100 ELSE 0 END AS {tag}_return_w,
    sum(amount) FILTER (WHERE b <= 20) / sum(amount) AS {tag}_amount_share_w, count(*) AS {tag}_rows{extra} FROM (SELECT *, ts >= max(ts) OVER (PARTITION BY pair, day, slot) - INTERVAL 20 MINUTE AS w, row_number() OVER (PARTITION BY pair, day, slot ORDER BY ts DESC) AS b FROM
    (SELECT *, {STAMP} AS ts FROM ({src})), (VALUES ('14:20'), ('14:50')) v(slot) WHERE ts <= {CUT_SQL}) GROUP BY pair, day, slot"""


PAIRS = f"""WITH e AS (SELECT *, {STAMP} AS ts FROM ({ETF})), u AS (SELECT *, {STAMP} AS ts FROM ({FUT})), al AS (SELECT *, ca / lag(ca) OVER w - 1 AS ra, cb / lag(cb) OVER w - 1 AS rb FROM (SELECT e.pair, e.day, slot, e.ts, e.close AS ca, u.close AS cb FROM e JOIN u ON u.pair = e.pair AND u.ts = e.ts, (VALUES ('14:20'), ('14:50')) v(slot)
  WHERE e.ts <= {CUT_SQL.replace('day ||', 'e.day ||')}) WINDOW w AS (PARTITION BY pair, day, slot ORDER BY ts)),
  tr AS (SELECT pair, day, slot, count(*) AS aligned_rows, coalesce(stddev_pop((rb - ra) * 100), 0) AS tracking_error, CASE WHEN count(ra) >= 3 THEN coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0) ELSE 0 END AS return_correlation FROM al GROUP BY pair, day, slot HAVING count(*) >= 2)
  SELECT *, future_return - etf_return AS hedge_spread, future_return_w - etf_return_w AS hedge_spread_w FROM ({side_sql(ETF, 'etf')}) JOIN ({side_sql(FUT, 'future', True)}) USING (pair, day, slot) JOIN tr USING (pair, day, slot)"""


@query("pair_spread_features", "pair:i day:d slot:s etf_return:r future_return:r etf_return_w:r future_return_w:r hedge_spread:r hedge_spread_w:r oi_change:r oi_change_w:r etf_amount_share_w:r future_amount_share_w:r aligned_rows:i tracking_error:r return_correlation:r", PAIRS)
def _(t):
    return _pair_frame(t)


@query("cross_pair_features", "day:d slot:s small_minus_large:r mid_minus_large:r hedge_spread_mean:r hedge_spread_std:r oi_change_mean:r oi_change_std:r",
       f"""SELECT day, slot, CASE WHEN k = 3 THEN f2 - f0 END AS small_minus_large, CASE WHEN k = 3 THEN f1 - f0 END AS mid_minus_large, CASE WHEN k = 3 THEN hm END AS hedge_spread_mean, CASE WHEN k = 3 THEN hs END AS hedge_spread_std, CASE WHEN k = 3 THEN om END AS oi_change_mean, CASE WHEN k = 3 THEN os END AS oi_change_std FROM (
       SELECT day, slot, count(DISTINCT pair) FILTER (WHERE pair IN (8, 15, 20)) AS k, max(etf_return) FILTER (WHERE pair = 8) AS f0, max(etf_return) FILTER (WHERE pair = 15) AS f1, max(etf_return) FILTER (WHERE pair = 20) AS f2, avg(hedge_spread) AS hm, stddev_pop(hedge_spread) AS hs,
       avg(oi_change) AS om, stddev_pop(oi_change) AS os FROM ({PAIRS}) GROUP BY day, slot)""")
def _(t):
    diffs = {"small_minus_large": ("etf_return", 20, 8), "mid_minus_large": ("etf_return", 15, 8)}
    return op.cross_pair_features(_pair_frame(t), CS, "pair", ["etf_return"], diffs, ["hedge_spread", "oi_change"])


# suppliers of a nation are its contract months; the largest amount is the main contract
CHAIN = """SELECT s_nationkey AS family, d.day, d.code AS contract, d.code AS month, d.close, (open + close) / 2 AS settle, pre_close AS pre_settle, vol AS oi, vol - lag(vol) OVER (PARTITION BY d.code ORDER BY d.day) AS oi_chg, amount / 1000 AS vol, amount
  FROM daily d JOIN supplier ON s_suppkey = d.code"""


def chain(t):
    home = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("family"))
    df = windows.nearby(t.daily, ["code"], [F.col("day")], lambda w: {"pv": F.lag("vol").over(w)})
    return df.join(home, "code").select(
        "family", "day", F.col("code").alias("contract"), F.col("code").alias("month"), "close", ((F.col("open") + F.col("close")) / 2).alias("settle"),
        F.col("pre_close").alias("pre_settle"), F.col("vol").alias("oi"), (F.col("vol") - F.col("pv")).alias("oi_chg"), (F.col("amount") / 1000).alias("vol"), "amount")


@query("futures_daily_features", "day:d family:i contract:i close_return:r settle_return:r oi_change:r volume_to_oi:r basis:r next_term_spread:r oi_share:r",
       f"""WITH c AS (SELECT *, lead(settle) OVER (PARTITION BY day, family ORDER BY month) AS nx, sum(oi) OVER (PARTITION BY day, family) AS total, avg(close) OVER (PARTITION BY day, family) AS ic FROM ({CHAIN}))
       SELECT day, family, contract, (close / pre_settle - 1) * 100 AS close_return, (settle / pre_settle - 1) * 100 AS settle_return, oi_chg / nullif(oi - oi_chg, 0) * 100 AS oi_change, vol / oi AS volume_to_oi, (settle / ic - 1) * 100 AS basis, (nx / settle - 1) * 100 AS next_term_spread, oi / total AS oi_share
       FROM c QUALIFY row_number() OVER (PARTITION BY day, family ORDER BY amount DESC, contract DESC) = 1""")
def _(t):
    f = chain(t)
    mapping = f.groupBy("day", "family").agg(F.max_by("contract", F.struct("amount", "contract")).alias("main"))
    index = f.groupBy("day", "family").agg(F.avg("close").alias("close"))
    return op.futures_daily_features(f, index, mapping)


@query("options_daily_features", "family:s straddle_pct:r premium_ratio:r put_call_vol:r put_call_oi:r put_call_amount:r volume_to_oi:r top5_oi_share:r",
       f"""SELECT a.family, straddle_pct, premium_ratio, pv / cv AS put_call_vol, po / co AS put_call_oi, pa / ca AS put_call_amount, vo AS volume_to_oi, t5 AS top5_oi_share FROM ({ATM}) a JOIN (
       SELECT family, {", ".join(f"(coalesce(sum({c}) FILTER (WHERE side = '{s}'), 0) + 1)::DOUBLE AS {s[0]}{c[0]}" for c in ('vol', 'oi') for s in ('put', 'call'))},
       {", ".join(f"coalesce(sum(close * vol) FILTER (WHERE side = '{s}'), 0) + 1 AS {s[0]}a" for s in ('put', 'call'))}, sum(vol)::DOUBLE / sum(oi) AS vo, sum(oi) FILTER (WHERE r <= 5)::DOUBLE / sum(oi) AS t5
       FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY oi DESC) AS r FROM ({OPTIONS})) GROUP BY family) s ON s.family = a.family""")
def _(t):
    return op.options_daily_features(options(t).withColumn("amount", F.col("close") * F.col("vol")), ["family"])


@query("snapshot_batch_pick", "day:d event_id:i user_id:i batch_selection:s",
       """WITH w AS (SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS m, * FROM events WHERE strftime(ts, '%H:%M') BETWEEN '13:20' AND '14:50'),
       s AS (SELECT * FROM w QUALIFY m = max(m) OVER (PARTITION BY day, event_type)), b AS (SELECT day, event_type, ts, count(*) AS n, count(DISTINCT user_id) AS u FROM s GROUP BY ALL),
       c AS (SELECT day, event_type, max(ts) AS x FROM b WHERE n = u GROUP BY ALL), z AS (SELECT day, event_type, count(*) > count(DISTINCT user_id) AS dup FROM s GROUP BY ALL)
       SELECT s.day, event_id, user_id, CASE WHEN dup THEN 'latest_complete_exact_timestamp' ELSE 'minute_bucket' END AS batch_selection FROM s JOIN z ON z.day = s.day AND z.event_type = s.event_type JOIN c ON c.day = s.day AND c.event_type = s.event_type WHERE NOT dup OR s.ts = x""")
def _(t):
    df = t.events.withColumn("day", F.to_date("ts"))
    return op.snapshot_batch_pick(df, ["day", "event_type"], "ts", "user_id", ("13:20", "14:50"), 1)


RANKED = "SELECT day, code, CASE WHEN month(day) = 1 THEN CAST(row_number() OVER w - 1 AS DOUBLE) WHEN month(day) = 2 THEN 3000 + close * 10 WHEN month(day) = 3 THEN close ELSE CAST(row_number() OVER w AS DOUBLE) END AS rk, close AS hot FROM bars WINDOW w AS (PARTITION BY day ORDER BY close DESC, code)"


@query("rank_regime_normalize", "day:d code:i regime:s normalized_rank:r",
       f"""WITH b AS (SELECT *, count(*) OVER w AS n, min(rk) OVER w AS mn, max(rk) OVER w AS mx, row_number() OVER (PARTITION BY day ORDER BY rk DESC, code) AS f FROM ({RANKED}) WINDOW w AS (PARTITION BY day)),
       d AS (SELECT day, count(DISTINCT rk)::DOUBLE / count(*) AS u, corr(a, h) AS rho FROM (SELECT day, rk, rank() OVER (PARTITION BY day ORDER BY rk) + (count(*) OVER (PARTITION BY day, rk) - 1) / 2.0 AS a, rank() OVER (PARTITION BY day ORDER BY hot) + (count(*) OVER (PARTITION BY day, hot) - 1) / 2.0 AS h FROM ({RANKED})) GROUP BY day),
       r AS (SELECT b.*, u >= 0.95 AND mn IN (0, 1) AND mx <= 2000 AS o, u >= 0.95 AND mn > 2000 AND rho >= 0.99 AS l FROM b JOIN d USING (day))
       SELECT day, code, CASE WHEN o THEN 'ordinal_zero_or_one_based' WHEN l THEN 'legacy_hot_score_descending' ELSE 'unusable' END AS regime, CASE WHEN o THEN rk - mn + 1 WHEN l THEN f END AS normalized_rank FROM r""")
def _(t):
    ranked = windows.cs_first_rank(t.bars, ["day"], "close", ["code"], "_p")
    m = F.month("day")
    rank = F.when(m == 1, F.col("_p") - 1.0).when(m == 2, 3000 + F.col("close") * 10).when(m == 3, F.col("close")).otherwise(F.col("_p").cast("double"))
    return op.rank_regime_normalize(ranked.withColumns({"rk": rank, "hot": F.col("close")}).drop("_p"), ["day"], "rk", "hot", "code")


@query("previous_limit_flags", "code:i day:d prev_closed_limit:b prev_touched_limit:b",
       """SELECT b.code, b.day, coalesce(f.close >= up_limit - 0.005, false) AS prev_closed_limit, coalesce(f.high >= up_limit - 0.005, false) AS prev_touched_limit FROM bars b JOIN calendar k USING (day)
       LEFT JOIN (SELECT code, day, close, high, up_limit FROM bars JOIN limits USING (code, day)) f ON f.code = b.code AND f.day = k.prev_day""")
def _(t):
    return op.previous_limit_flags(t.bars, t.limits, t.bars.select("code", "day"), t.calendar)


@query("momentum_overlay_mask", "day:d slot:s code:i overlay:b",
       "SELECT day, slot, code, coalesce(slot = '14:20' AND ret > 7 AND NOT coalesce(gap > 10, false) AND dist_up > 1, false) AS overlay FROM panel")
def _(t):
    df = t.panel.withColumns({"flag": F.col("gap") > 10, "ok": F.col("dist_up") > 1})
    return op.momentum_overlay_mask(df, prior_flag="flag", eligible="ok")


M_COLS = {"relative_market": "ret", "relative_industry": "gap", "ret_rank": "p", "trend_slope": "ret_open", "efficiency": "q", "close_position": "u", "max_drawdown": "gap", "rebound": "ret_open", "ret_1": "ret", "acceleration": "gap", "confirmation": "ret", "amount_rank": "risk"}


@query("specialist_masks", "day:d slot:s code:i specialist:s",
       """SELECT day, slot, code, specialist FROM (SELECT day, slot, code, unnest([CASE WHEN slot IN ('14:20', '14:25', '14:30', '14:35') THEN 'early_structure' END, CASE WHEN slot IN ('14:40', '14:45', '14:50') THEN 'late_confirmation' END,
       CASE WHEN ret > 0 AND gap > 0 AND p >= 0.6 THEN 'market_industry_leader' END, CASE WHEN ret_open > 0 AND q >= 0.15 AND u >= 0.55 THEN 'trend_persistence' END,
       CASE WHEN gap <= -0.5 AND ret_open >= 0.5 AND ret > 0 THEN 'pullback_recovery' END, CASE WHEN gap > 0 AND ret > 0 AND risk >= 0.6 THEN 'liquidity_breakout' END]) AS specialist FROM scored) WHERE specialist IS NOT NULL""")
def _(t):
    return op.specialist_masks(t.scored.withColumns({k: F.col(v) for k, v in M_COLS.items()}), op.default_masks(), PK)


@query("market_slot_leader", "day:d slot:s code:i p:r market_size:i market_ret_median:r score_median:r score_std:r leader_margin:r leader_gap_to_median:r",
       """SELECT day, slot, code, p, n AS market_size, rm AS market_ret_median, pm AS score_median, coalesce(ps, 0) AS score_std, coalesce(p - nx, 0) AS leader_margin, p - pm AS leader_gap_to_median FROM (SELECT *, count(*) OVER w AS n, median(ret) OVER w AS rm, median(p) OVER w AS pm, stddev_samp(p) OVER w AS ps,
       lead(p) OVER (PARTITION BY day, slot ORDER BY p DESC, code) AS nx, row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) AS r FROM scored WHERE entry_ok WINDOW w AS (PARTITION BY day, slot)) WHERE r = 1""")
def _(t):
    return op.market_slot_leader(t.scored, CS, F.col("entry_ok"), [F.col("p").desc(), F.col("code")], "p", ["ret"])

