"""Queries for selection and set operators."""

from pyspark.sql import functions as F

from ..functions import rounded
from ..operators import selection as op
from .registry import query

CS, PK = ["day", "slot"], ["day", "slot", "code"]


def desc(*names):
    return [F.col(n).desc() for n in names]


@query("topk_per_group", "day:d slot:s code:i p:r",
       "SELECT day, slot, code, p FROM scored QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 5")
def _(t):
    return op.topk_per_group(t.scored, CS, [*desc("p"), F.col("code")], 5)


@query("first_crossing", "day:d slot:s code:i p:r net:r",
       "SELECT day, slot, code, p, net FROM scored WHERE p > 0.6 QUALIFY row_number() OVER (PARTITION BY day, code ORDER BY slot) = 1")
def _(t):
    return op.first_crossing(t.scored, F.col("p") > 0.6, ["day"], ["code"], [F.col("slot")])


@query("first_signal_daily_cap", "day:d slot:s code:i p:r",
       """SELECT day, slot, code, p FROM (SELECT * FROM scored WHERE q > 0.5 QUALIFY row_number() OVER (PARTITION BY day, code ORDER BY slot, p DESC) = 1)
       QUALIFY row_number() OVER (PARTITION BY day ORDER BY slot, p DESC, code) <= 4""")
def _(t):
    return op.first_signal_daily_cap(t.scored, F.col("q") > 0.5, ["day"], ["code"], "slot", "p", 4)


@query("score_first_daily_cap", "day:d slot:s code:i p:r",
       """SELECT day, slot, code, p FROM (SELECT * FROM scored WHERE q > 0.5 QUALIFY row_number() OVER (PARTITION BY day, code ORDER BY slot, p DESC) = 1)
       QUALIFY row_number() OVER (PARTITION BY day ORDER BY p DESC, slot, code) <= 4""")
def _(t):
    return op.score_first_daily_cap(t.scored, F.col("q") > 0.5, ["day"], ["code"], "slot", "p", 4)


@query("one_slot_license", "day:d slot:s code:i p:r",
       """WITH s AS (SELECT day, slot, avg(q) AS m FROM scored GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY day ORDER BY round(avg(q), 9) DESC, slot) = 1)
       SELECT day, slot, code, p FROM scored SEMI JOIN s USING (day, slot) QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 3""")
def _(t):
    slots = t.scored.groupBy(*CS).agg(F.round(F.avg("q"), 9).alias("m"))
    return op.one_slot_license(slots, t.scored, ["day"], "slot", "m", [*desc("p"), F.col("code")], 3)


@query("union_topk_prune", "day:d slot:s code:i p:r",
       """SELECT day, slot, code, p FROM scored QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 3
       OR row_number() OVER (PARTITION BY day, slot ORDER BY q DESC, code) <= 3 OR row_number() OVER (PARTITION BY day, slot ORDER BY risk, code) <= 3""")
def _(t):
    return op.union_topk_prune(t.scored, CS, PK, ["p", "q"], 3, ["code"], safest="risk")


H = "CAST('0x' || substr(md5(concat_ws('|', day, slot, code, {})), 1, 15) AS BIGINT)"
FRONTIER = f"""SELECT *, concat_ws('|', CASE WHEN e THEN 'exploration' END, CASE WHEN a THEN 'p' END, CASE WHEN b THEN 'q' END, CASE WHEN c THEN 'risk' END) AS source_list
  FROM (SELECT day, slot, code, net, win, severe, row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 6 AS a, row_number() OVER (PARTITION BY day, slot ORDER BY q DESC, code) <= 6 AS b,
  row_number() OVER (PARTITION BY day, slot ORDER BY risk, code) <= 6 AS c, row_number() OVER (PARTITION BY day, slot ORDER BY {H.format(7)}, code) <= 4 AS e FROM scored) WHERE a OR b OR c OR e"""


def frontier(t):
    return op.recall_frontier(t.scored, CS, PK, {"p": False, "q": False, "risk": True}, 6, 4, 7)


@query("recall_frontier", "day:d slot:s code:i source_count:i source_list:s from_p:i from_exploration:i",
       f"SELECT day, slot, code, a::INT + b::INT + c::INT + e::INT AS source_count, source_list, a::INT AS from_p, e::INT AS from_exploration FROM ({FRONTIER})")
def _(t):
    return frontier(t)


@query("recall_audit", "rows:i kept:i kept_share:r win_recall:r severe_recall:r",
       f"""SELECT count(*) AS rows, sum(k) AS kept, avg(k) AS kept_share, avg(k) FILTER (WHERE win) AS win_recall, avg(k) FILTER (WHERE severe) AS severe_recall
       FROM (SELECT s.win, s.severe, CASE WHEN f.code IS NULL THEN 0 ELSE 1 END AS k FROM scored s LEFT JOIN ({FRONTIER}) f ON f.day = s.day AND f.slot = s.slot AND f.code = s.code)""")
def _(t):
    return op.recall_audit(t.scored, frontier(t), PK, ["win", "severe"])


@query("dual_cohort_select", "day:d slot:s code:i cohort:s cohort_rank:i",
       """SELECT day, slot, code, 'QUALIFIED' AS cohort, row_number() OVER (PARTITION BY day ORDER BY q DESC, code, slot) AS cohort_rank FROM scored WHERE p > 0.8 AND risk < 0.5
       UNION ALL SELECT * FROM (SELECT day, slot, code, 'OBSERVATION', row_number() OVER (PARTITION BY day ORDER BY (p <= 0.8)::INT + (risk >= 0.5)::INT,
       greatest(0.8 - p, 0) + greatest(risk - 0.5, 0), q DESC, code, slot) AS r FROM scored WHERE entry_ok AND NOT (p > 0.8 AND risk < 0.5)) WHERE r <= 5""")
def _(t):
    a, b = F.col("p") > 0.8, F.col("risk") < 0.5
    failed = (~a).cast("int") + (~b).cast("int")
    gap = F.greatest(0.8 - F.col("p"), F.lit(0.0)) + F.greatest(F.col("risk") - 0.5, F.lit(0.0))
    tail = [F.col("q").desc(), F.col("code"), F.col("slot")]
    return op.dual_cohort_select(t.scored, ["day"], a & b, F.col("entry_ok"), tail, [failed, gap, *tail], 5)


@query("nth_threshold", "fold:i target_days:i threshold:r",
       """WITH d AS (SELECT fold, day, max(p) AS m FROM scored GROUP BY 1, 2), n AS (SELECT fold, count(DISTINCT day) AS total FROM scored GROUP BY 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, day) AS r, count(*) OVER (PARTITION BY fold) AS c FROM d)
       SELECT n.fold, greatest(1, ceil(0.7::DOUBLE * total)) AS target_days, coalesce(r.m, 'inf'::DOUBLE) AS threshold FROM n LEFT JOIN r ON r.fold = n.fold AND r.r = least(greatest(1, ceil(0.7::DOUBLE * total)), r.c)""")
def _(t):
    totals = t.scored.groupBy("fold").agg(F.countDistinct("day").alias("total_days"))
    return op.nth_threshold(t.scored, ["fold"], "day", "p", 0.7, totals)


@query("deterministic_sample", "day:d slot:s code:i",
       f"SELECT day, slot, code FROM scored QUALIFY row_number() OVER (PARTITION BY day ORDER BY {H.format(11)}, day, slot, code) <= 7")
def _(t):
    return op.deterministic_sample(t.scored, ["day"], PK, 7, 11)


# each code plays one policy: its metrics over all its rows
METRICS = "SELECT code AS policy, avg(win::INT) AS win_rate, avg(net) AS mean_net, avg(severe::INT) AS severe_rate FROM scored GROUP BY code"


def code_metrics(t):
    return t.scored.groupBy(F.col("code").alias("policy")).agg(
        F.avg(F.col("win").cast("int")).alias("win_rate"), F.avg("net").alias("mean_net"),
        F.avg(F.col("severe").cast("int")).alias("severe_rate"))


@query("near_miss_policies", "policy:i passed_gates:i proximity:r",
       f"""SELECT policy, (win_rate >= 0.5)::INT + (mean_net >= 1)::INT + (severe_rate <= 0.3)::INT AS passed_gates,
       -least(greatest(0.5 - win_rate, 0) / 0.5, 1) - least(greatest(1 - mean_net, 0), 1) - least(greatest(severe_rate - 0.3, 0) / 0.3, 1) AS proximity
       FROM ({METRICS}) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""")
def _(t):
    gates = {"win": ("win_rate", ">=", 0.5), "mean": ("mean_net", ">=", 1.0), "severe": ("severe_rate", "<=", 0.3)}
    return op.near_miss_policies(code_metrics(t), gates, 20)


@query("pareto_mask", "policy:i efficient:b",
       f"""WITH m AS (SELECT policy, round(win_rate, 9) AS a, round(mean_net, 9) AS b, -round(severe_rate, 9) AS c FROM ({METRICS}))
       SELECT policy, NOT EXISTS (SELECT 1 FROM m o WHERE o.a >= m.a AND o.b >= m.b AND o.c >= m.c AND (o.a > m.a OR o.b > m.b OR o.c > m.c)) AS efficient FROM m""")
def _(t):
    m = code_metrics(t).select("policy", rounded("win_rate", 9).alias("a"), rounded("mean_net", 9).alias("b"), (-rounded("severe_rate", 9)).alias("c"))
    return op.pareto_mask(m, ["a", "b", "c"])


@query("union_families", "code:i day:d close:r buy_lg:r",
       "SELECT code, day, close, NULL AS buy_lg FROM bars UNION ALL SELECT code, day, NULL, buy_lg FROM flow")
def _(t):
    return op.union_families([t.bars.select("code", "day", "close"), t.flow.select("code", "day", "buy_lg")])


@query("dedup_keep_last", "user_id:i day:d event_id:i value:r",
       """SELECT user_id, CAST(ts AS DATE) AS day, event_id, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return op.dedup_keep_last(t.events.withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"])


@query("exact_dedup", "l_orderkey:i l_linenumber:i",
       "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return op.exact_dedup(t.lineitem.select("l_orderkey", "l_linenumber"))


A, B = "SELECT day, code FROM scored WHERE p > 0.5", "SELECT day, code FROM scored WHERE q > 0.5"


@query("identity_intersection", "day:d code:i", f"{A} INTERSECT {B}")
def _(t):
    return op.identity_intersection(t.scored.filter("p > 0.5"), t.scored.filter("q > 0.5"), ["day", "code"])


@query("identity_difference", "day:d code:i", f"{A} EXCEPT {B}")
def _(t):
    return op.identity_difference(t.scored.filter("p > 0.5"), t.scored.filter("q > 0.5"), ["day", "code"])
