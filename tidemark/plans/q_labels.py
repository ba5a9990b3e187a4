"""Queries for execution outcomes and labels."""

from pyspark.sql import functions as F

from ..operators import labels as op
from .q_windows import pr
from .registry import query

CFG = op.Execution()
PK = ["day", "slot", "code"]


@query("entry_fillable", "day:d slot:s code:i entry_fill:b",
       """SELECT day, slot, code, coalesce(price > 0 AND slot_amount >= 50000 AND slot_amount * 0.1::DOUBLE >= 5000 AND dist_up >= 0.5
       AND CAST(vol AS BIGINT) % 6 = 0, false) AS entry_fill FROM panel""")
def _(t):
    df = t.panel.withColumn("entry_lag", F.col("vol").cast("bigint") % 6)
    return op.entry_fillable(df, CFG, "price", "slot_amount", "dist_up", "entry_lag", "entry_fill")


DOWN = "(CASE WHEN region <> 1 THEN prev_close * 0.9::DOUBLE END)"


def with_down(t):
    return t.panel.withColumn("t1_down_limit", F.when(F.col("region") != 1, F.col("prev_close") * F.lit(0.9)))


@query("exit_fillable", "day:d slot:s code:i exit_fill:b",
       f"""SELECT day, slot, code, coalesce(t1_close IS NOT NULL AND t1_vol > 0 AND ({DOWN} IS NULL OR t1_close > {DOWN} * 1.0001::DOUBLE), false) AS exit_fill FROM panel""")
def _(t):
    return op.exit_fillable(with_down(t), out="exit_fill")


# eligibility, fills and truth flags derived from the panel
BASE = """SELECT *, slot_amount >= 60000 AS eligible, coalesce(dist_up >= 0.5, false) AS entry_ok, coalesce(t1_close > price * 0.75::DOUBLE, false) AS exit_ok,
  t1_close * t1_adj / adj AS exit_price, t1_close IS NOT NULL AND year(day) < 2001 AS truth FROM panel"""
LABELLED = f"""SELECT *, coalesce(eligible AND entry_ok AND exit_ok AND seen, false) AS trip FROM (SELECT *, (exit_price / (price * 1.001::DOUBLE) - 1) * 100 - 0.25::DOUBLE AS cnet,
  coalesce(price > 0, false) AND (NOT entry_ok OR (truth AND (coalesce(exit_price > 0, false) OR NOT exit_ok))) AS seen FROM ({BASE}))"""
OUTCOME = f"""SELECT *, CASE WHEN trip THEN cnet WHEN seen AND NOT entry_ok THEN 0 WHEN seen AND entry_ok AND NOT exit_ok THEN -10 END AS net_return, CASE WHEN trip THEN cnet END AS cond FROM ({LABELLED})"""


def base(t):
    return t.panel.withColumns({
        "eligible": F.col("slot_amount") >= 60000,
        "entry_ok": F.coalesce(F.col("dist_up") >= 0.5, F.lit(False)),
        "exit_ok": F.coalesce(F.col("t1_close") > F.col("price") * F.lit(0.75), F.lit(False)),
        "exit_price": F.col("t1_close") * F.col("t1_adj") / F.col("adj"),
        "truth": F.col("t1_close").isNotNull() & (F.year("day") < 2001),
    })


@query("supervised_labels", "day:d slot:s code:i label_available:b net_return:r target_positive:i target_severe:i target_entry:i target_exit:i net_rank:r conditional_rank:r conditional_residual:r target_top:i",
       f"""SELECT *, CASE WHEN trip THEN (conditional_rank >= 1 - 0.2::DOUBLE)::INT END AS target_top FROM (SELECT day, slot, code, trip, seen AS label_available, net_return,
       CASE WHEN seen THEN (trip AND cnet > 0)::INT END AS target_positive, CASE WHEN seen THEN ((entry_ok AND NOT exit_ok) OR (trip AND cnet <= -2))::INT END AS target_severe,
       CASE WHEN seen THEN entry_ok::INT END AS target_entry, CASE WHEN seen AND entry_ok THEN exit_ok::INT END AS target_exit,
       {pr('net_all')} AS net_rank, {pr('cond')} AS conditional_rank, cond - median(cond) OVER (PARTITION BY day, slot) AS conditional_residual
       FROM (SELECT *, CASE WHEN eligible AND seen THEN net_return END AS net_all FROM ({OUTCOME})))""")
def _(t):
    return op.supervised_labels(base(t), ["day", "slot"], CFG, entry_ref="price", truth="truth")


CONTRACT = f"""SELECT *, price * 1.001::DOUBLE AS entry_price, {DOWN} AS t1_down_limit, CASE WHEN NOT entry_ok THEN 0 WHEN NOT exit_ok THEN -10
  ELSE (exit_price / (price * 1.001::DOUBLE) - 1) * 100 - 0.25::DOUBLE END AS net_close FROM ({BASE}) WHERE t1_close IS NOT NULL"""


def contract_base(t):
    df = base(t).filter("t1_close is not null").withColumns({
        "entry_price": F.col("price") * 1.001,
        "t1_down_limit": F.when(F.col("region") != 1, F.col("prev_close") * F.lit(0.9)),
    })
    net = F.when(~F.col("entry_ok"), 0.0).when(~F.col("exit_ok"), -10.0)
    return df.withColumn("net_close", net.otherwise((F.col("exit_price") / F.col("entry_price") - 1) * 100 - 0.25))


OPEN_OK = "coalesce(t1_open > 0 AND t1_vol > 0 AND (t1_down_limit IS NULL OR t1_open > t1_down_limit + 0.005::DOUBLE), false)"


@query("open_exit_contract", "day:d slot:s code:i exit_open_ok:b net_open:r",
       f"""SELECT day, slot, code, {OPEN_OK} AS exit_open_ok, CASE WHEN NOT entry_ok THEN 0 WHEN NOT {OPEN_OK} THEN -10
       ELSE (t1_open * t1_adj / adj / entry_price - 1) * 100 - 0.25::DOUBLE END AS net_open FROM ({CONTRACT})""")
def _(t):
    return op.open_exit_contract(contract_base(t), CFG)


HIT = "coalesce(entry_ok AND t1_high >= entry_price * (1 + 225 / 10000.0::DOUBLE) / (t1_adj / adj) + 0.01::DOUBLE - 1e-9 AND t1_vol > 0, false)"


@query("take_profit_contract", "day:d slot:s code:i hit_200:b net_tp_200:r",
       f"""SELECT day, slot, code, {HIT} AS hit_200, CASE WHEN NOT entry_ok THEN 0 WHEN NOT ({HIT} OR exit_ok) THEN -10 WHEN {HIT} THEN 2 ELSE net_close END AS net_tp_200 FROM ({CONTRACT})""")
def _(t):
    return op.take_profit_contract(contract_base(t), [200], 0.01, CFG)


TAIL_OK = """coalesce(truth AND x.close > 0 AND x.amount >= 50000 AND x.vol > 0 AND (t1_down_limit IS NULL OR x.close > t1_down_limit * 1.0001::DOUBLE), false)"""


@query("tail_exit_contracts", "day:d slot:s code:i contract:s exit_contract_ok:b contract_label_available:b contract_net:r",
       f"""SELECT c.day, c.slot, c.code, contract, {TAIL_OK} AS exit_contract_ok, NOT (entry_ok AND NOT truth) AS contract_label_available,
       CASE WHEN NOT entry_ok THEN 0 WHEN NOT truth THEN NULL WHEN NOT {TAIL_OK} THEN -10 ELSE (x.close * t1_adj / adj * 0.999::DOUBLE / entry_price - 1) * 100 - 0.25::DOUBLE END AS contract_net
       FROM ({CONTRACT}) c, (VALUES ('early', '14:00'), ('mid', '14:20'), ('late', '14:35'), ('close', '14:50')) k(contract, xs)
       LEFT JOIN slot_bars x ON x.code = c.code AND x.day = c.t1_day AND x.slot = xs""")
def _(t):
    slots = {"early": "14:00", "mid": "14:20", "late": "14:35", "close": "14:50"}
    return op.tail_exit_contracts(contract_base(t), t.slot_bars, slots, CFG, ["code"], covered="truth")


FAST = """SELECT a.code, a.day, a.ts, m.close AS c, m.amount AS a, m.vol AS v, up_limit, down_limit, b.t1 AS exit_price, coalesce(b.t1 > a.close * 0.8::DOUBLE, false) AS exit_ok, b.t1 IS NOT NULL AS source_label,
  a.amount > 20000 AS eligible, (up_limit / m.close - 1) * 100 AS up, (m.close / down_limit - 1) * 100 AS dn
  FROM mbars a JOIN (SELECT code, day, lead(close) OVER (PARTITION BY code ORDER BY day) AS t1 FROM bars) b ON b.code = a.code AND b.day = a.day
  LEFT JOIN limits l ON l.code = a.code AND l.day = a.day LEFT JOIN mbars m ON m.code = a.code AND m.ts = a.ts + INTERVAL 10 MINUTE"""
FAST_OK = f"""SELECT *, coalesce(complete AND eligible AND a >= 50000 AND v > 0 AND up >= 0.5 AND dn >= 0.5, false) AS fill FROM (SELECT *, coalesce(c > 0 AND a >= 0 AND v >= 0 AND up IS NOT NULL AND dn IS NOT NULL, false) AS complete FROM ({FAST}))"""


@query("fast_entry_outcome", "code:i bar:s bar_exact:b entry_complete:b fast_entry_ok:b fast_label_available:b fast_net:r",
       f"""SELECT code, strftime(ts, '%Y-%m-%d %H:%M') AS bar, c IS NOT NULL AS bar_exact, complete AS entry_complete, fill AS fast_entry_ok, seen AS fast_label_available,
       CASE WHEN seen THEN CASE WHEN NOT fill THEN 0 WHEN NOT exit_ok THEN -10 ELSE (exit_price / (c * 1.001::DOUBLE) - 1) * 100 - 0.25::DOUBLE END END AS fast_net
       FROM (SELECT *, complete AND source_label AND (NOT fill OR NOT exit_ok OR coalesce(exit_price > 0, false)) AS seen FROM ({FAST_OK}))""")
def _(t):
    from pyspark.sql import Window

    nxt = t.bars.select("code", "day", F.lead("close").over(Window.partitionBy("code").orderBy("day")).alias("exit_price"))
    cands = t.mbars.join(nxt, ["code", "day"]).join(t.limits, ["code", "day"], "left").select(
        "code", "day", "ts", "up_limit", "down_limit", "exit_price",
        F.coalesce(F.col("exit_price") > F.col("close") * F.lit(0.8), F.lit(False)).alias("exit_ok"),
        F.col("exit_price").isNotNull().alias("source_label"), (F.col("amount") > 20000).alias("eligible"))
    out = op.fast_entry_outcome(cands, t.mbars, ["code"], "10 minutes", CFG)
    return out.withColumn("bar", F.date_format("ts", "yyyy-MM-dd HH:mm"))


@query("materialize_contract", "day:d slot:s code:i net_return:r exit_ok:b target_positive:i target_severe:i exit_contract:s",
       f"""SELECT day, slot, code, net_close AS net_return, exit_ok, (net_close > 0)::INT AS target_positive, (net_close <= -2)::INT AS target_severe, 'close_auction' AS exit_contract FROM ({CONTRACT})""")
def _(t):
    return op.materialize_contract(contract_base(t), "net_close", "exit_ok", "close_auction", CFG)


@query("truth_hydration", "code:i day:d t1_close:r truth_status:s",
       """SELECT code, day, c AS t1_close, CASE WHEN c IS NULL THEN 'PENDING' ELSE 'SETTLED' END AS truth_status FROM (SELECT b.code, b.day,
       CASE WHEN b.close > 1500 THEN b.close WHEN k.next_day <= DATE '2000-01-01' THEN n.close END AS c
       FROM bars b JOIN calendar k USING (day) LEFT JOIN bars n ON n.code = b.code AND n.day = k.next_day)""")
def _(t):
    cal = t.calendar.select("day", F.col("next_day").alias("due"))
    pending = t.bars.join(cal, "day").withColumn("t1_close", F.when(F.col("close") > 1500, F.col("close")))
    truth = t.bars.select("code", F.col("day").alias("due"), F.col("close").alias("t1_close"))
    return op.truth_hydration(pending, truth, ["code", "due"], "due", "2000-01-01", ["t1_close"])


@query("paired_contract_delta", "pairs:i mean_delta:r median_delta:r improved_share:r day_equal_delta:r days:i",
       f"""WITH d AS (SELECT day, CASE WHEN NOT entry_ok THEN 0 WHEN NOT {OPEN_OK} THEN -10 ELSE (t1_open * t1_adj / adj / entry_price - 1) * 100 - 0.25::DOUBLE END - net_close AS d FROM ({CONTRACT}))
       SELECT count(*) AS pairs, avg(d) AS mean_delta, median(d) AS median_delta, avg((d > 0)::INT) AS improved_share,
       (SELECT avg(m) FROM (SELECT avg(d) AS m FROM d GROUP BY day)) AS day_equal_delta, count(DISTINCT day) AS days FROM d""")
def _(t):
    df = op.open_exit_contract(contract_base(t), CFG)
    return op.paired_contract_delta(df.withColumn("v", F.col("net_close")), df.withColumn("v", F.col("net_open")), PK, "day", "v")
