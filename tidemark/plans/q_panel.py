"""The end-to-end panel and the flagship study."""


from ..operators.labels import Execution
from .panel import Sources, causal_panel, signal_study
from .q_sessions import CUT_SQL, cut_column
from .q_statistics import wilson
from .q_windows import LAG_RET, M, pr
from .registry import query

CFG = Execution(min_amount=20_000.0)


def sources(t):
    # every source lies by code, so history, sessions and their joins stay there
    slots = t.code_slots.select("day", "slot", "code").withColumn("cutoff", cut_column())
    return Sources(t.code_daily, t.code_bars, slots, t.code_limits, t.membership, t.calendar)


PANEL = f"""WITH px AS (SELECT *, close * adj AS px, lag(amount) OVER (PARTITION BY code ORDER BY day) AS pa FROM daily),
hist AS (SELECT code, day, pre_close, adj, open AS day_open, (lag(px, 1) OVER w / lag(px, 6) OVER w - 1) * 100 AS prev_5d_return, CASE WHEN count(pa) OVER v >= 15 THEN pa / avg(pa) OVER v END AS amount_ratio FROM px
  WINDOW w AS (PARTITION BY code ORDER BY day), v AS (PARTITION BY code ORDER BY day ROWS 19 PRECEDING)),
vola AS (SELECT code, day, CASE WHEN count(r) OVER w >= 15 THEN stddev_samp(r) OVER w END AS prev_20d_volatility FROM ({LAG_RET}) WINDOW w AS (PARTITION BY code ORDER BY day ROWS 19 PRECEDING)),
path AS (SELECT code, day, ts, close, (close / first_value(open) OVER v - 1) * 100 AS path_return, min(dd) OVER v AS path_max_drawdown, sum(amount) OVER v AS path_amount FROM (SELECT *, (close / max(close) OVER ({M}) - 1) * 100 AS dd FROM mbars) WINDOW v AS ({M})),
c AS (SELECT day, slot, code, {CUT_SQL} AS cut FROM slot_bars),
snap AS (SELECT c.day, c.slot, c.code, p.close AS price, path_return, path_max_drawdown, path_amount FROM c ASOF JOIN path p ON p.code = c.code AND p.day = c.day AND c.cut >= p.ts),
base AS (SELECT s.*, h.pre_close, h.adj, day_open, prev_5d_return, amount_ratio, prev_20d_volatility, m.coarse AS industry, k.next_day, n.close AS t1_close, n.vol AS t1_vol, n.adj AS t1_adj, down_limit * 0.9::DOUBLE AS t1_down,
  (price / h.pre_close - 1) * 100 AS ret_from_prev_close, (day_open / h.pre_close - 1) * 100 AS gap_open, (up_limit / price - 1) * 100 AS dist_up
  FROM snap s JOIN hist h ON h.code = s.code AND h.day = s.day JOIN vola v ON v.code = s.code AND v.day = s.day LEFT JOIN limits l ON l.code = s.code AND l.day = s.day
  LEFT JOIN membership m ON m.code = s.code AND m.valid_from <= s.day AND (m.valid_to IS NULL OR m.valid_to > s.day) JOIN calendar k ON k.day = s.day LEFT JOIN daily n ON n.code = s.code AND n.day = k.next_day),
ctx AS (SELECT *, median(ret_from_prev_close) OVER w AS market_return, avg(coalesce((ret_from_prev_close > 0)::INT, 0)) OVER w AS market_breadth_0, median(ret_from_prev_close) OVER (PARTITION BY day, slot, industry) AS industry_return,
  {pr('ret_from_prev_close', src='base')} AS return_rank, {pr('path_amount', src='base')} AS amount_rank, coalesce(path_amount >= 20000 AND adj > 0, false) AS eligible, coalesce(dist_up >= 0.5, false) AS entry_ok,
  coalesce(t1_close IS NOT NULL AND t1_vol > 0 AND (t1_down IS NULL OR t1_close > t1_down * 1.0001::DOUBLE), false) AS exit_ok, t1_close * t1_adj / adj AS exit_price, next_day IS NOT NULL AS truth FROM base WINDOW w AS (PARTITION BY day, slot)),
lab AS (SELECT *, (exit_price / (price * 1.001::DOUBLE) - 1) * 100 - 0.25::DOUBLE AS cnet, NOT entry_ok OR (truth AND (coalesce(exit_price > 0, false) OR NOT exit_ok)) AS label_available FROM ctx),
res AS (SELECT *, CASE WHEN eligible AND entry_ok AND exit_ok AND label_available THEN cnet WHEN label_available AND NOT entry_ok THEN 0 WHEN label_available AND entry_ok AND NOT exit_ok THEN -10 END AS net_return,
  CASE WHEN label_available THEN (eligible AND entry_ok AND exit_ok AND cnet > 0)::INT END AS target_positive FROM lab)
SELECT *, CASE WHEN label_available THEN ((entry_ok AND NOT exit_ok) OR (eligible AND entry_ok AND exit_ok AND cnet <= -2))::INT END AS target_severe, {pr('net_all', src='res')} AS net_rank FROM (SELECT *, CASE WHEN eligible AND label_available THEN net_return END AS net_all FROM res) res"""


@query("causal_panel", "day:d slot:s code:i price:r ret_from_prev_close:r gap_open:r prev_5d_return:r prev_20d_volatility:r amount_ratio:r path_return:r path_max_drawdown:r industry:i market_return:r market_breadth_0:r industry_return:r return_rank:r amount_rank:r entry_ok:b exit_ok:b label_available:b net_return:r target_positive:i target_severe:i net_rank:r", PANEL)
def _(t):
    return causal_panel(sources(t), CFG)


@query("flagship_study", "slot:s events:i trade_days:i wins:i win_rate:r wilson_lower:r mean_net:r median_net:r severe_rate:r entry_fill_rate:r day_equal_mean:r",
       f"""WITH f AS (SELECT * FROM ({PANEL}) WHERE label_available AND return_rank >= 0.5 AND market_breadth_0 >= 0.3 AND amount_rank >= 0.3 QUALIFY row_number() OVER (PARTITION BY day, code ORDER BY slot) = 1), e AS (SELECT * FROM f WHERE net_return IS NOT NULL)
       SELECT * FROM (SELECT slot, count(*) AS events, count(DISTINCT day) AS trade_days, sum((net_return > 0)::INT) AS wins, avg((net_return > 0)::INT) AS win_rate, {wilson('sum((net_return > 0)::INT)', 'count(*)', 'lower')} AS wilson_lower, avg(net_return) AS mean_net, median(net_return) AS median_net,
       avg((net_return <= -2)::INT) AS severe_rate, avg(entry_ok::INT) AS entry_fill_rate FROM e GROUP BY slot) JOIN (SELECT slot, avg(m) AS day_equal_mean FROM (SELECT slot, day, avg(net_return) AS m FROM e GROUP BY slot, day) GROUP BY slot) USING (slot)""")
def _(t):
    return signal_study(causal_panel(sources(t), CFG))


