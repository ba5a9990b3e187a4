"""Queries for gates, funnels, grids and cohorts."""

from pyspark.sql import functions as F

from ..operators import policy as op
from .q_joins import GRID, GRID_SQL
from .q_statistics import PF, wilson
from .q_windows import pr
from .registry import query

CS, PK = ["day", "slot"], ["day", "slot", "code"]
GATES = {"min_p": ("p", ">=", 0.6), "min_ret": ("ret", ">=", -5.0), "max_risk": ("risk", "<=", 0.7)}
COLS = {"day": "day", "code": ["code"], "slot": "slot", "score": "p", "ret": "net"}
PASS = (lambda: (F.col("p") >= F.col("min_p")) & (F.col("risk") <= F.col("max_risk")))
LOOSE = (lambda: (F.col("p") >= 0.5) & (F.col("risk") <= 0.5))
EM = f"""count(*) AS events, count(DISTINCT day) AS days, sum(win::INT) AS wins, avg(net) AS mean_net, {PF} AS profit_factor, avg(win::INT) AS win_rate, {wilson('sum(win::INT)', 'count(*)', 'lower')} AS wilson_lower"""
EOUT = "events:i days:i wins:i mean_net:r profit_factor:r win_rate:r wilson_lower:r"


@query("apply_thresholds", "day:d slot:s code:i passes:b",
       "SELECT day, slot, code, coalesce(p >= 0.6 AND ret >= -5 AND risk <= 0.7, false) AS passes FROM scored")
def _(t):
    return op.apply_thresholds(t.scored, GATES)


@query("gate_diagnostics", "day:d slot:s code:i min_p:b min_ret:b max_risk:b passes:b failed_gates:s",
       """SELECT *, min_p AND min_ret AND max_risk AS passes, concat_ws('|', CASE WHEN NOT min_p THEN 'min_p' END, CASE WHEN NOT min_ret THEN 'min_ret' END, CASE WHEN NOT max_risk THEN 'max_risk' END) AS failed_gates
       FROM (SELECT day, slot, code, coalesce(p >= 0.6, false) AS min_p, coalesce(ret >= -5, false) AS min_ret, coalesce(risk <= 0.7, false) AS max_risk FROM scored)""")
def _(t):
    return op.gate_diagnostics(t.scored, GATES)


@query("gate_distance", "day:d slot:s code:i failed_gate_count:i failed_gate_distance:r",
       """SELECT day, slot, code, (NOT coalesce(p >= 0.6, false))::INT + (NOT coalesce(ret >= -5, false))::INT + (NOT coalesce(risk <= 0.7, false))::INT AS failed_gate_count,
       CASE WHEN ret IS NOT NULL THEN greatest(0.6 - p, 0) + greatest(-5 - ret, 0) + greatest(risk - 0.7, 0) END AS failed_gate_distance FROM scored""")
def _(t):
    return op.gate_distance(t.scored, GATES)


STOP = "CASE WHEN NOT coalesce(entry_ok, false) THEN 1 WHEN NOT coalesce(p >= 0.5, false) THEN 2 WHEN NOT coalesce(risk <= 0.6, false) THEN 3 ELSE 4 END"


@query("sequential_funnel", "stage_order:i stage:s rows_remaining:i days_remaining:i codes_remaining:i rejected:i row_retention:r day_retention:r",
       f"""WITH s AS (SELECT *, {STOP} AS stop FROM scored), k AS (SELECT day, slot, code FROM (SELECT * FROM s WHERE stop = 4 QUALIFY row_number() OVER (PARTITION BY day, code ORDER BY slot, p DESC) = 1)
       QUALIFY row_number() OVER (PARTITION BY day ORDER BY slot, p DESC, code) <= 5), z AS (SELECT s.day, s.code, CASE WHEN k.code IS NOT NULL THEN 5 ELSE stop END AS stop FROM s LEFT JOIN k ON k.day = s.day AND k.slot = s.slot AND k.code = s.code),
       a AS (SELECT i AS stage_order, stage, count(*) FILTER (WHERE stop > i) AS rows_remaining, count(DISTINCT day) FILTER (WHERE stop > i) AS days_remaining, count(DISTINCT code) FILTER (WHERE stop > i) AS codes_remaining,
       count(*) FILTER (WHERE stop = i) AS rejected FROM z, (VALUES (0, 'source'), (1, 'entry'), (2, 'score'), (3, 'risk'), (4, 'daily_cap')) v(i, stage) GROUP BY ALL)
       SELECT *, rows_remaining::DOUBLE / max(rows_remaining) OVER () AS row_retention, days_remaining::DOUBLE / max(days_remaining) OVER () AS day_retention FROM a""")
def _(t):
    stages = {"entry": F.col("entry_ok"), "score": F.col("p") >= 0.5, "risk": F.col("risk") <= 0.6}
    return op.sequential_funnel(t.scored, stages, "day", "code", "slot", "p", cap=5, on=PK)


def grid_first(src, keys=""):
    return f"""SELECT * FROM {src}, {GRID_SQL} WHERE p >= min_p AND risk <= max_risk QUALIFY row_number() OVER (PARTITION BY {keys} policy, day, code ORDER BY slot, p DESC) = 1"""


@query("policy_grid_metrics", f"policy:i {EOUT}", f"SELECT policy, {EM} FROM ({grid_first('scored')}) GROUP BY policy")
def _(t):
    return op.policy_grid_metrics(t.scored, GRID, PASS(), LOOSE(), **COLS)


@query("policy_grid_capped", f"policy:i {EOUT}",
       f"SELECT policy, {EM} FROM (SELECT * FROM ({grid_first('scored')}) QUALIFY row_number() OVER (PARTITION BY policy, day ORDER BY slot, p DESC, code) <= 3) GROUP BY policy")
def _(t):
    return op.policy_grid_metrics(t.scored, GRID, PASS(), LOOSE(), cap=3, **COLS)


SELECT_GATES = {"events": ("events", ">=", 30.0), "win": ("win_rate", ">=", 0.2)}
BEST = "ORDER BY wilson_lower DESC, win_rate DESC, mean_net DESC, profit_factor DESC, policy"


@query("nested_policy_select", "policy:i events:i win_rate:r mean_net:r confirmed:b confirm_events:i confirm_win_rate:r",
       f"""WITH d AS (SELECT policy, {EM} FROM ({grid_first("(SELECT * FROM scored WHERE year(day) < 1999) d")}) GROUP BY policy), c AS (SELECT policy, {EM} FROM ({grid_first("(SELECT * FROM scored WHERE year(day) >= 1999) d")}) GROUP BY policy),
       b AS (SELECT * FROM d WHERE events >= 30 AND win_rate >= 0.2 {BEST} LIMIT 1)
       SELECT b.policy, b.events, b.win_rate, b.mean_net, coalesce(c.events >= 30 AND c.win_rate >= 0.2, false) AS confirmed, c.events AS confirm_events, c.win_rate AS confirm_win_rate FROM b LEFT JOIN c ON c.policy = b.policy""")
def _(t):
    return op.nested_policy_select(
        t.scored.filter(F.year("day") < 1999), t.scored.filter(F.year("day") >= 1999), GRID, PASS(), LOOSE(), SELECT_GATES, **COLS)


@query("nested_oos_apply", "day:d slot:s code:i fold:i policy:i passes_policy:b",
       f"""WITH dd AS (SELECT day, min(fold) AS fold, row_number() OVER (ORDER BY day) AS i FROM scored GROUP BY day), st AS (SELECT fold AS tf, min(i) AS s FROM dd GROUP BY fold),
       w AS (SELECT tf, day, CASE WHEN i < s - 6 THEN 'design' ELSE 'confirm' END AS role FROM st JOIN dd ON dd.i BETWEEN s - 18 AND s - 1 WHERE s > 18),
       h AS (SELECT scored.*, tf, role FROM scored JOIN w USING (day)), m AS (SELECT tf, role, policy, {EM} FROM ({grid_first('h', 'tf, role,')}) GROUP BY tf, role, policy),
       ok AS (SELECT * FROM m WHERE events >= 10 AND win_rate >= 0.35), ch AS (SELECT tf, policy FROM ok WHERE role = 'design' QUALIFY row_number() OVER (PARTITION BY tf {BEST}) = 1),
       c AS (SELECT tf, policy, min_p, max_risk FROM ch SEMI JOIN (SELECT * FROM ok WHERE role = 'confirm') k USING (tf, policy) JOIN {GRID_SQL} USING (policy))
       SELECT day, slot, code, fold, policy, coalesce(p >= min_p AND risk <= max_risk, false) AS passes_policy FROM scored LEFT JOIN c ON tf = fold""")
def _(t):
    gates = {"events": ("events", ">=", 10.0), "win": ("win_rate", ">=", 0.35)}
    return op.nested_oos_apply(
        t.scored, GRID, PASS(), LOOSE(), "day", "fold", ["code"], "slot", "p", "net", 12, 6, gates)


JOINT = [{"policy": i, "min_rank": a, "min_q": b} for i, (a, b) in enumerate((a, b) for a in (0.8, 0.9, 0.95) for b in (0.0, 0.3, 0.6))]
JOINT_SQL = "(VALUES " + ", ".join(f"({g['policy']}, {g['min_rank']}::DOUBLE, {g['min_q']}::DOUBLE)" for g in JOINT) + ") g(policy, min_rank, min_q)"


@query("joint_gate_cohorts", f"policy:i {EOUT}",
       f"""SELECT policy, {EM} FROM (SELECT * FROM (SELECT *, {pr('p')} AS rank_pct FROM scored), {JOINT_SQL} WHERE rank_pct >= min_rank AND q >= min_q QUALIFY row_number() OVER (PARTITION BY policy, day, code ORDER BY slot) = 1) GROUP BY policy""")
def _(t):
    cond = (F.col("rank_pct") >= F.col("min_rank")) & (F.col("q") >= F.col("min_q"))
    return op.joint_gate_cohorts(t.scored, CS, "p", JOINT, cond, F.col("rank_pct") >= 0.8, "day", ["code"], "slot", "p", "net")


@query("extreme_rank_cohorts", f"floor:r {EOUT}",
       f"""SELECT floor, {EM} FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, slot ORDER BY p, code)::DOUBLE / count(*) OVER (PARTITION BY day, slot) AS pc FROM scored),
       (VALUES (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(floor) WHERE pc >= floor QUALIFY row_number() OVER (PARTITION BY floor, day, code ORDER BY slot) = 1) GROUP BY floor""")
def _(t):
    return op.extreme_rank_cohorts(t.scored, CS, "p", [0.9, 0.95, 0.99], ["code"], "day", ["code"], "slot", "net")


@query("topn_cohorts", f"top_n:i {EOUT}",
       f"""SELECT top_n, {EM} FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) AS r FROM scored), (VALUES (1), (3), (5), (10), (20)) v(top_n)
       WHERE r <= top_n QUALIFY row_number() OVER (PARTITION BY top_n, day, code ORDER BY slot) = 1) GROUP BY top_n""")
def _(t):
    return op.topn_cohorts(t.scored, CS, "p", ["code"], [1, 3, 5, 10, 20], "day", ["code"], "slot", "net")


TAILS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{side}' AS direction, {tail}::DOUBLE AS tail, day, slot, code, net, win FROM r WHERE {c.format(f'r_{f}', tail)}"
    for f in ("p", "ret") for tail in (0.01, 0.05) for side, c in (("high", "{} >= 1 - {}::DOUBLE"), ("low", "{} <= {}::DOUBLE")))


@query("feature_tail_audit", f"feature:s direction:s tail:r {EOUT}",
       f"""WITH r AS (SELECT *, {pr('p')} AS r_p, {pr('ret')} AS r_ret FROM scored), f AS (SELECT * FROM ({TAILS}) QUALIFY row_number() OVER (PARTITION BY feature, direction, tail, day, code ORDER BY slot) = 1)
       SELECT feature, direction, tail, {EM} FROM f GROUP BY feature, direction, tail""")
def _(t):
    return op.feature_tail_audit(t.scored, CS, ["p", "ret"], [0.01, 0.05], "day", ["code"], "slot", "net")


@query("lockbox_split", "day:d slot:s code:i split:s",
       "SELECT day, slot, code, CASE WHEN dense_rank() OVER (ORDER BY day DESC) <= 20 THEN 'lockbox' ELSE 'design' END AS split FROM scored")
def _(t):
    return op.lockbox_split(t.scored, "day", 20)


CAL = """SELECT fold, greatest(1, ceil(0.5::DOUBLE * count(*))) AS target_days, max(m) FILTER (WHERE r = least(greatest(1, ceil(0.5::DOUBLE * c)), c)) AS threshold FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY m DESC, day) AS r, count(*) OVER (PARTITION BY fold) AS c FROM (SELECT fold, day, max(p) AS m FROM scored GROUP BY fold, day)) GROUP BY fold"""


def calibrated(t):
    return op.threshold_calibrate(t.scored, "fold", "day", "p", 0.5)


@query("threshold_calibrate", "fold:i target_days:i threshold:r", CAL)
def _(t):
    return calibrated(t)


@query("threshold_drift", "scored_folds:i zero_folds:i threshold_min:r threshold_max:r threshold_std:r event_spearman:r",
       f"""WITH e AS (SELECT c.fold, threshold, (SELECT count(*) FROM scored s WHERE s.fold = c.fold AND s.p >= c.threshold) AS events FROM ({CAL}) c),
       r AS (SELECT *, rank() OVER (ORDER BY threshold) + (count(*) OVER (PARTITION BY threshold) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY events) + (count(*) OVER (PARTITION BY events) - 1) / 2.0::DOUBLE AS b FROM e)
       SELECT count(*) AS scored_folds, count(*) FILTER (WHERE events = 0) AS zero_folds, min(threshold) AS threshold_min, max(threshold) AS threshold_max, stddev_pop(threshold) AS threshold_std,
       covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS event_spearman FROM r""")
def _(t):
    cal = calibrated(t)
    events = t.scored.join(cal, "fold").groupBy("fold", "threshold").agg(
        F.sum((F.col("p") >= F.col("threshold")).cast("int")).alias("events"))
    return op.threshold_drift(events)


@query("promotion_gate", "slot:s promoted:b failed_checks:s check_name:s passed:b",
       """WITH m AS (SELECT slot, avg(win::INT) >= 0.45 AS a, avg(net) >= 0 AS b, count(*) >= 5000 AS c FROM scored GROUP BY slot), v AS (SELECT *, a AND b AND c AS promoted,
       concat_ws('|', CASE WHEN NOT a THEN 'win_rate' END, CASE WHEN NOT b THEN 'mean_net' END, CASE WHEN NOT c THEN 'events' END) AS failed_checks FROM m)
       SELECT slot, promoted, failed_checks, 'win_rate' AS check_name, a AS passed FROM v UNION ALL SELECT slot, promoted, failed_checks, 'mean_net', b FROM v UNION ALL SELECT slot, promoted, failed_checks, 'events', c FROM v""")
def _(t):
    m = op.event_metrics(t.scored, ["slot"], "net", "day")
    return op.promotion_gate(m, {"win_rate": ("win_rate", ">=", 0.45), "mean_net": ("mean_net", ">=", 0.0), "events": ("events", ">=", 5000.0)})


SELECTED = "SELECT * FROM scored"


@query("selected_contract_check", "rule:s violations:i",
       f"""SELECT 'repeated_stock_day' AS rule, count(*) AS violations FROM (SELECT day, code FROM ({SELECTED}) GROUP BY 1, 2 HAVING count(*) > 1)
       UNION ALL SELECT 'over_daily_max', count(*) FROM (SELECT day FROM ({SELECTED}) GROUP BY 1 HAVING count(*) > 30) UNION ALL SELECT 'illegal_slot', count(*) FROM ({SELECTED}) WHERE slot = '14:00'
       UNION ALL SELECT 'incomplete', count(*) FROM ({SELECTED}) WHERE NOT coalesce(exit_ok, false)""")
def _(t):
    return op.selected_contract_check(
        t.scored, "day", "code", "slot", ["14:20", "14:35", "14:50"], 30, F.col("exit_ok"))


@query("day_status_fill", "day:d candidates:i status:s",
       """SELECT c.day, coalesce(n, 0) AS candidates, CASE WHEN n > 0 THEN 'QUALIFIED' ELSE 'NO_SIGNAL' END AS status FROM calendar c LEFT JOIN
       (SELECT day, count(*) AS n FROM scored GROUP BY day) USING (day)""")
def _(t):
    return op.day_status_fill(t.scored, t.calendar, "day")


