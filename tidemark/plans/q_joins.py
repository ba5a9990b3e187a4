"""Queries for the join operators."""

from pyspark.sql import functions as F

from ..operators import joins as op
from ..operators.selection import topk_per_group
from .registry import query


@query("left_join_checked", "code:i day:d close:r up_limit:r",
       "SELECT code, day, close, up_limit FROM bars LEFT JOIN limits USING (code, day)")
def _(t):
    return op.left_join_checked(t.bars, t.limits, ["code", "day"], "1:1")


@query("inner_join_identities", "code:i day:d slot:s price:r",
       "SELECT code, day, slot, price FROM panel WHERE t1_close IS NOT NULL")
def _(t):
    ids = t.panel.filter("t1_close is not null").select("day", "slot", "code")
    return op.inner_join_identities(t.panel, ids, ["day", "slot", "code"])


@query("outer_join_families", "code:i day:d buy_lg:r n_slots:i up_limit:r",
       """SELECT * FROM (SELECT code, day, buy_lg FROM flow WHERE buy_lg > 0) FULL JOIN
       (SELECT code, day, count(*) AS n_slots FROM slot_bars WHERE close > 1200 GROUP BY 1, 2) USING (code, day)
       FULL JOIN (SELECT code, day, up_limit FROM limits) USING (code, day)""")
def _(t):
    slots = t.slot_bars.filter("close > 1200").groupBy("code", "day").agg(F.count(F.lit(1)).alias("n_slots"))
    flow = t.flow.filter("buy_lg > 0").select("code", "day", "buy_lg")
    return op.outer_join_families([flow, slots, t.limits.select("code", "day", "up_limit")], ["code", "day"])


@query("semi_join_universe", "event_id:i user_id:i",
       "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    rich = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return op.semi_join_universe(t.events, rich, ["user_id"])


@query("anti_join_missing", "event_id:i user_id:i",
       "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    rich = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return op.anti_join_missing(t.events, rich, ["user_id"])


@query("asof_join_backward", "event_id:i err_id:i err_value:r lag_minutes:r",
       """SELECT l.event_id, r.event_id AS err_id, r.value AS err_value,
       date_diff('microsecond', r.ts, l.ts) // 1000000 / 60.0::DOUBLE AS lag_minutes
       FROM (SELECT * FROM events WHERE event_type <> 'error') l
       ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'error') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def _(t):
    left = t.events.filter("event_type <> 'error'").select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'error'").select(
        "user_id", "ts", F.col("event_id").alias("err_id"), F.col("value").alias("err_value"))
    return op.asof_join_backward(left, right, ["user_id"], "ts", "ts", ["err_id", "err_value"], ["err_id"])


@query("asof_join_interval", "code:i day:d active_from:d coarse:i",
       """SELECT code, day, valid_from AS active_from, coarse FROM (SELECT b.code, b.day, valid_from, coarse,
       row_number() OVER (PARTITION BY b.code, b.day ORDER BY valid_from DESC NULLS LAST) AS rn
       FROM bars b LEFT JOIN membership m ON b.code = m.code AND valid_from <= b.day AND (valid_to IS NULL OR valid_to > b.day)) WHERE rn = 1""")
def _(t):
    return op.asof_join_interval(
        t.bars, t.membership, ["code"], "day", "valid_from", "valid_to", ["coarse"], ["code", "day"])


@query("interval_flag_join", "code:i day:d flag:b",
       """SELECT b.code, b.day, CASE WHEN k.code IS NULL THEN b.close > 1500 ELSE EXISTS (SELECT 1 FROM membership m
       WHERE m.code = b.code AND m.valid_to IS NOT NULL AND b.day BETWEEN m.valid_from AND m.valid_to) END AS flag
       FROM bars b LEFT JOIN (SELECT DISTINCT code FROM membership WHERE valid_to IS NOT NULL) k ON k.code = b.code""")
def _(t):
    closed = t.membership.filter("valid_to is not null")
    return op.interval_flag_join(t.bars, closed, ["code"], "day", "valid_from", "valid_to", F.col("close") > 1500)


@query("prev_period_join", "code:i day:d source_day:d prev_net:r",
       """SELECT b.code, b.day, c.prev_day AS source_day, buy_lg - sell_lg AS prev_net FROM bars b JOIN calendar c USING (day)
       LEFT JOIN flow f ON f.code = b.code AND f.day = c.prev_day""")
def _(t):
    facts = t.flow.select("code", "day", (F.col("buy_lg") - F.col("sell_lg")).alias("prev_net"))
    return op.prev_period_join(t.bars, facts, t.calendar, ["code"])


@query("next_period_join", "code:i day:d source_day:d t1_close:r",
       """SELECT b.code, b.day, c.next_day AS source_day, n.close AS t1_close FROM bars b JOIN calendar c USING (day)
       LEFT JOIN bars n ON n.code = b.code AND n.day = c.next_day""")
def _(t):
    facts = t.bars.select("code", "day", F.col("close").alias("t1_close"))
    return op.next_period_join(t.bars, facts, t.calendar, ["code"])


@query("exact_offset_join", "code:i ts:s close:r close_at:r",
       """SELECT a.code, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, a.close, b.close AS close_at FROM mbars a
       LEFT JOIN mbars b ON b.code = a.code AND b.ts = a.ts - INTERVAL 20 MINUTE""")
def _(t):
    out = op.exact_offset_join(t.mbars, ["code"], "ts", "-20 minutes", ["close"])
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("lookback_join", "code:i day:d event_day:d age:i event_id:i",
       """SELECT u.code, u.day, e.day AS event_day, c.idx - d.idx AS age, e.event_id FROM user_days u JOIN ecal c ON c.day = u.day
       JOIN tape e ON e.code = u.code AND e.tag = 'touch' JOIN ecal d ON d.day = e.day AND c.idx - d.idx BETWEEN 1 AND 5""")
def _(t):
    return op.lookback_join(t.user_days, t.tape.filter("tag = 'touch'"), t.ecal, ["code"], 5)


DAY_TYPE = """SELECT user_id AS code, CAST(ts AS DATE) AS day, sum(value) AS v FROM events WHERE event_type = '{}' GROUP BY 1, 2"""


def day_type(t, kind, out):
    return t.events.filter(F.col("event_type") == kind).groupBy(
        F.col("user_id").alias("code"), F.to_date("ts").alias("day")).agg(F.sum("value").alias(out))


@query("time_aligned_pair_join", "code:i day:d va:r vb:r",
       f"SELECT code, day, a.v AS va, b.v AS vb FROM ({DAY_TYPE.format('click')}) a JOIN ({DAY_TYPE.format('view')}) b USING (code, day)")
def _(t):
    return op.time_aligned_pair_join(day_type(t, "click", "va"), day_type(t, "view", "vb"), ["code", "day"])


# the dated contract of a nation is its supplier with the largest amount that month
LEADERS = """SELECT day, nation AS generic, arg_max(code, ROW(amount, code)) AS contract FROM
  (SELECT b.*, s_nationkey AS nation FROM bars b JOIN supplier ON s_suppkey = code) GROUP BY 1, 2"""


@query("mapped_code_join", "generic:i day:d contract:i close:r",
       f"SELECT generic, m.day, contract, close FROM ({LEADERS}) m JOIN nation ON n_nationkey = generic JOIN bars b ON b.code = contract AND b.day = m.day")
def _(t):
    home = t.supplier.select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("generic"))
    mapping = t.bars.join(home, "code").groupBy("day", "generic").agg(
        F.max_by("code", F.struct("amount", "code")).alias("contract"))
    specs = t.nation.select(F.col("n_nationkey").alias("generic"))
    return op.mapped_code_join(t.bars, mapping, specs)


GRID = [{"policy": i, "min_p": a, "max_risk": b} for i, (a, b) in enumerate((a, b) for a in (0.5, 0.7, 0.9) for b in (0.2, 0.5))]
GRID_SQL = "(VALUES " + ", ".join(f"({g['policy']}, {g['min_p']}::DOUBLE, {g['max_risk']}::DOUBLE)" for g in GRID) + ") g(policy, min_p, max_risk)"


@query("grid_cross_join", "policy:i day:d slot:s code:i net:r",
       f"SELECT policy, day, slot, code, net FROM scored, {GRID_SQL} WHERE p >= min_p AND risk <= max_risk")
def _(t):
    return op.grid_cross_join(
        t.scored, GRID, (F.col("p") >= F.col("min_p")) & (F.col("risk") <= F.col("max_risk")),
        loosest=(F.col("p") >= 0.5) & (F.col("risk") <= 0.5))


@query("pairwise_self_join", "day:d slot:s code_a:i code_b:i p:r q:r label:i weight:r",
       """WITH s AS (SELECT day, slot, code, p, q, net FROM scored QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 5),
       n AS (SELECT day, slot, count(*) AS n FROM s GROUP BY 1, 2)
       SELECT a.day, a.slot, a.code AS code_a, b.code AS code_b, a.p - b.p AS p, a.q - b.q AS q, CAST(a.net > b.net AS INT) AS label,
       1.0::DOUBLE / (n * (n - 1)) AS weight FROM s a JOIN s b ON a.day = b.day AND a.slot = b.slot AND a.code < b.code
       JOIN n ON n.day = a.day AND n.slot = a.slot WHERE NOT (abs(a.net - b.net) <= 1e-8 + 1e-5 * abs(b.net))""")
def _(t):
    short = topk_per_group(t.scored.filter("net IS NOT NULL"), ["day", "slot"], [F.col("p").desc(), F.col("code")], 5)
    return op.pairwise_self_join(short, ["day", "slot"], ["code"], ["p", "q"], "net")


@query("session_forward_bar_join", "code:i ts:s fwd_open:r fwd_amount:r",
       """SELECT a.code, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS ts, b.open AS fwd_open, b.amount AS fwd_amount FROM mbars a
       LEFT JOIN mbars b ON b.code = a.code AND b.ts = a.ts + INTERVAL 10 MINUTE""")
def _(t):
    bars = t.mbars
    out = op.session_forward_bar_join(bars.select("code", "ts"), bars, ["code"], "10 minutes", cols=("open", "amount"))
    return out.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("identity_overlap_compare", "common:i only_left:i only_right:i",
       """SELECT count(*) FILTER (WHERE p > 0.4 AND q > 0.6) AS common, count(*) FILTER (WHERE p > 0.4 AND NOT q > 0.6) AS only_left,
       count(*) FILTER (WHERE q > 0.6 AND NOT p > 0.4) AS only_right FROM scored""")
def _(t):
    return op.identity_overlap_compare(t.scored.filter("p > 0.4"), t.scored.filter("q > 0.6"), ["day", "slot", "code"])
