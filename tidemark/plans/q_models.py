"""Queries for folds, weights, ensembles and model jobs."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import hash_unit
from ..operators import fits
from ..operators import folds as fd
from ..operators import models as md
from ..operators.selection import topk_per_group
from ..operators.spread import stored
from .registry import query
from .tables import _unit

CS = ["day", "slot"]
PLAN = fd.FoldPlan(min_train=24, calibration=6, purge=1, test=12, max_window=30)
FOLDS = """SELECT f + 1 AS fold, greatest(s - 1 - 37, 0) AS train_lo, s - 2 AS train_hi, s - 1 - 6 AS cal_lo, s AS test_lo, least(s + 12, n) - 1 AS test_hi FROM (SELECT f, 32 + f * 12 AS s, n FROM (SELECT count(*) AS n FROM calendar), range(20) r(f)) WHERE s < n"""


@query("walk_forward_folds", "fold:i train_start:d train_end:d test_start:d test_end:d",
       f"SELECT fold, a.day AS train_start, b.day AS train_end, c.day AS test_start, d.day AS test_end FROM ({FOLDS}) JOIN calendar a ON a.idx = train_lo JOIN calendar b ON b.idx = train_hi JOIN calendar c ON c.idx = test_lo JOIN calendar d ON d.idx = test_hi")
def _(t):
    return fd.walk_forward_folds(t.calendar, PLAN)


@query("assign_fold_rows", "fold:i role:s day:d code:i close:r",
       f"""SELECT fold, role, day, code, close FROM (SELECT fold, k.day, CASE WHEN k.idx BETWEEN test_lo AND test_hi THEN 'test' WHEN k.idx BETWEEN cal_lo AND train_hi THEN 'calibration' WHEN k.idx BETWEEN train_lo AND cal_lo - 2 THEN 'train' END AS role
       FROM ({FOLDS}) JOIN calendar k ON k.idx BETWEEN train_lo AND test_hi) JOIN bars USING (day) WHERE role IS NOT NULL""")
def _(t):
    return fd.assign_fold_rows(t.bars, t.calendar, fd.walk_forward_folds(t.calendar, PLAN), PLAN)


@query("rolling_segments", "role:s start:d end_day:d days:i",
       """WITH n AS (SELECT count(*) AS n FROM calendar) SELECT role, min(day) AS start, max(day) AS end_day, count(*) AS days FROM (SELECT day, CASE WHEN idx < n - 14 THEN 'design' WHEN idx < n - 12 THEN 'purge' ELSE 'confirmation' END AS role FROM calendar, n WHERE idx >= n - 38) GROUP BY role""")
def _(t):
    return fd.rolling_segments(t.calendar, 24, 2, 12).withColumnRenamed("end", "end_day")


@query("temporal_weights", "day:d slot:s code:i weight:r",
       """WITH a AS (SELECT *, pow(0.5, (dense_rank() OVER (ORDER BY day DESC) - 1) / 24.0::DOUBLE) / count(*) OVER (PARTITION BY day, slot) AS w FROM scored) SELECT day, slot, code, w / avg(w) OVER () AS weight FROM a""")
def _(t):
    return fd.temporal_weights(t.scored, "day", CS, 24)


@query("balanced_class_weights", "day:d slot:s code:i balanced_weight:r",
       "SELECT day, slot, code, (1 + p) * CASE WHEN win THEN 0.5 / avg(win::INT) OVER () ELSE 0.5 / (1 - avg(win::INT) OVER ()) END AS balanced_weight FROM scored")
def _(t):
    return fd.balanced_class_weights(t.scored.withColumn("w", 1 + F.col("p")), "win", "w")


SCREENED = ["ret", "t1_close", "rare", "flat"]


@query("active_feature_screen", "feature:s train_rate:r cal_rate:r active:b",
       """WITH x AS (SELECT *, CASE WHEN ret > 25 THEN ret END AS rare, 1.0::DOUBLE AS flat, year(day) < 2000 AS tr FROM panel) """ + " UNION ALL ".join(
           f"""SELECT '{f}' AS feature, avg(({f} IS NOT NULL)::INT) FILTER (WHERE tr) AS train_rate, avg(({f} IS NOT NULL)::INT) FILTER (WHERE NOT tr) AS cal_rate,
           avg(({f} IS NOT NULL)::INT) FILTER (WHERE tr) >= 0.5 AND avg(({f} IS NOT NULL)::INT) FILTER (WHERE NOT tr) >= 0.5 AND coalesce(min({f}) FILTER (WHERE tr) < max({f}) FILTER (WHERE tr), false) AS active FROM x""" for f in SCREENED))
def _(t):
    df = t.panel.withColumns({"rare": F.when(F.col("ret") > 25, F.col("ret")), "flat": F.lit(1.0)})
    return fd.active_feature_screen(df.filter(F.year("day") < 2000), df.filter(F.year("day") >= 2000), SCREENED)


@query("median_impute_scale", "day:d slot:s code:i ret_scaled:r gap_scaled:r",
       """WITH m AS (SELECT fold, median(ret) AS mr, median(gap) AS mg FROM scored WHERE slot <> '14:50' GROUP BY fold), s AS (SELECT fold, avg(coalesce(ret, mr, 0)) AS ar, stddev_pop(coalesce(ret, mr, 0)) AS sr, avg(coalesce(gap, mg, 0)) AS ag, stddev_pop(coalesce(gap, mg, 0)) AS sg FROM scored JOIN m USING (fold) WHERE slot <> '14:50' GROUP BY fold)
       SELECT day, slot, code, (coalesce(ret, mr, 0) - ar) / sr AS ret_scaled, (coalesce(gap, mg, 0) - ag) / sg AS gap_scaled FROM scored JOIN m USING (fold) JOIN s USING (fold)""")
def _(t):
    return fd.median_impute_scale(t.scored, "fold", ["ret", "gap"], F.col("slot") != "14:50")


MEMBERS, PARTS = ["a", "b", "c"], ["entry", "exit", "pos", "sev", "csev", "ret", "rank"]
M_SQL = "SELECT day, slot, code, risk, " + ", ".join(f"{_unit(p + m)} AS {p}_{m}" for p in PARTS for m in MEMBERS) + " FROM scored"


def members(t):
    # member values follow from the keys, so keys alone are shuffled; sections stay where they are ranked
    rows = t.scored.select("day", "slot", "code", "risk").repartition("day", "slot").sortWithinPartitions("day", "slot")
    return rows.select("day", "slot", "code", "risk", *[hash_unit("code", "day", "slot", F.lit(p + m)).alias(f"{p}_{m}") for p in PARTS for m in MEMBERS])


def mean3(f):
    return "(" + " + ".join(f.format(m=m) for m in MEMBERS) + ") / 3"


def sd3(f):
    return f"sqrt(greatest(({' + '.join(f'pow({f.format(m=m)} - ({mean3(f)}), 2)' for m in MEMBERS)}) / 3, 0))"


def rank_of(expr):
    return f"((rank() OVER (PARTITION BY day, slot ORDER BY {expr})) + (count(*) OVER (PARTITION BY day, slot, {expr}) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY day, slot)"


E, X = mean3("entry_{m}"), mean3("exit_{m}")
EXP, WORST = "(entry_{m} * (exit_{m} * ret_{m} + (1 - exit_{m}) * -10))", "(1 - greatest(entry_{m} * ((1 - exit_{m}) + exit_{m} * csev_{m}), sev_{m}))"


def low10(f):
    a = "list_sort([" + ", ".join(f.format(m=m) for m in MEMBERS) + "])"
    return f"({a}[1] + ({a}[2] - {a}[1]) * 0.2::DOUBLE)"


@query("ensemble_combine", "day:d slot:s code:i p_round_trip:r p_positive:r p_severe:r expected_utility:r expected_utility_lower:r probability_spread:r fill_spread:r p_round_trip_lower:r p_positive_lower:r selection_score:r",
       f"""SELECT day, slot, code, ({E}) * ({X}) AS p_round_trip, ({E}) * ({X}) * ({mean3('pos_{m}')}) AS p_positive, greatest(({E}) * ((1 - ({X})) + ({X}) * ({mean3('csev_{m}')})), {mean3('sev_{m}')}) AS p_severe, {mean3(EXP)} AS expected_utility,
       {mean3(EXP)} + least(-risk, 0) AS expected_utility_lower, {sd3('(entry_{m} * exit_{m} * pos_{m})')} AS probability_spread, {sd3('(entry_{m} * exit_{m})')} AS fill_spread,
       least(({E}) * ({X}), {low10('entry_{m} * exit_{m}')}) AS p_round_trip_lower, least(({E}) * ({X}) * ({mean3('pos_{m}')}), {low10('entry_{m} * exit_{m} * pos_{m}')}) AS p_positive_lower,
       ({" + ".join(f"0.35 * {rank_of(EXP.format(m=m))} + 0.25 * {rank_of(f'ret_{m}')} + 0.2 * {rank_of(f'pos_{m}')} + 0.15 * {rank_of(f'rank_{m}')} + 0.05 * {rank_of(WORST.format(m=m))}" for m in MEMBERS)}) / 21 AS selection_score FROM ({M_SQL})""")
def _(t):
    out = md.ensemble_combine(members(t).withColumn("adj", -F.col("risk")), MEMBERS, CS, adjustment="adj", keep=["day", "slot", "code"])
    # ranks over few rows are short decimals; a seventh of them never lies on a rounding edge
    return out.withColumn("selection_score", F.col("selection_score") / 7)


SCORE_COLS = {"expected_net": "ret", "p_positive": "p", "p_margin": "q", "p_severe": "risk", "positive_spread": "u", "margin_spread": "p", "severe_spread": "q", "return_spread": "gap"}


@query("economic_score", "day:d slot:s code:i economic_score:r",
       "SELECT day, slot, code, CASE WHEN ret IS NOT NULL AND gap IS NOT NULL THEN 0.5 * least(greatest(ret, -4), 4) + 1.25 * (p - 0.5) + 0.75 * (q - 0.35) - risk - 0.2 * (u + 0.5 * p + 0.5 * q) - 0.05 * least(greatest(gap, 0), 6) END AS economic_score FROM scored")
def _(t):
    return md.economic_score(t.scored.select("day", "slot", "code", *[F.col(v).alias(k) for k, v in SCORE_COLS.items()]))


def SHORT():
    return [F.col("p").desc(), F.col("code")]


WEIGHTS = {"p": 1.5, "q": -0.5, "u": 2.0}


@query("pairwise_rank_score", "day:d slot:s code:i rank_score:r",
       """WITH s AS (SELECT day, slot, code, 1.5 * p - 0.5 * q + 2 * u AS s FROM scored QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 5)
       SELECT a.day, a.slot, a.code, coalesce(avg(1 / (1 + exp(b.s - a.s))), 0.5) AS rank_score FROM s a LEFT JOIN s b ON b.day = a.day AND b.slot = a.slot AND b.code <> a.code GROUP BY 1, 2, 3""")
def _(t):
    return md.pairwise_rank_score(topk_per_group(t.scored, CS, SHORT(), 5), CS, WEIGHTS)


FEATURES = ["ret", "gap", "ret_open", "dist_up", "p", "q"]


def weighted(t):
    """Rows of the model jobs, which go over them many times: the panel is built once."""
    rows = t.scored.select("day", "slot", "code", "fold", *FEATURES, "win", "net", F.lit(1.0).alias("w"))
    return stored(rows, "day")


@query("fit_logistic_blend", "day:d slot:s code:i p_win:r p_win_spread:r")
def _(t):
    df = weighted(t)
    model = md.fit_logistic_blend(df.filter("fold < 5"), FEATURES, "win", "w")
    return model.score(df.filter("fold >= 5"), "p_win")


@query("fit_return_blend", "day:d slot:s code:i e_net:r e_net_spread:r")
def _(t):
    df = weighted(t)
    model = md.fit_return_blend(df.filter("fold < 5"), FEATURES, "net", "w")
    return model.score(df.filter("fold >= 5"), "e_net")


def newton_sql(table: str, names: list[str], l2: float, steps=14) -> str:
    """SQL for the coefficients b0, b1, ... after Newton steps from zero on ``table(names..., y, w)``; two or three of them."""
    d = len(names)
    z = " + ".join(f"b{k} * {n}" for k, n in enumerate(names))
    sums = [f"sum(w * (s - y) * {n}) / sum(w) + {l2} * b{k} AS g{k}" for k, n in enumerate(names)]
    sums += [f"sum(w * s * (1 - s) * {names[i]} * {names[j]}) / sum(w) + {l2 if i == j else 0} AS h{i}{j}" for i in range(d) for j in range(i, d)]
    h = lambda i, j: f"h{min(i, j)}{max(i, j)}"
    if d == 2:
        det, adj = "(h00 * h11 - h01 * h01)", [["h11", "-h01"], ["-h01", "h00"]]
    else:
        minor = lambda i, j: "({} * {} - {} * {})".format(*(h(a, b) for a, b in (
            ((i + 1) % 3, (j + 1) % 3), ((i + 2) % 3, (j + 2) % 3), ((i + 1) % 3, (j + 2) % 3), ((i + 2) % 3, (j + 1) % 3))))
        adj = [[minor(i, j) for j in range(3)] for i in range(3)]
        det = "(" + " + ".join(f"{h(0, j)} * {adj[0][j]}" for j in range(3)) + ")"
    moved = ", ".join(f"b{i} - (" + " + ".join(f"({adj[i][j]}) * g{j}" for j in range(d)) + f") / {det}" for i in range(d))
    b = ", ".join(f"b{k}" for k in range(d))
    return f"""(WITH RECURSIVE it(k, {b}) AS (SELECT 0, {', '.join(['0.0::DOUBLE'] * d)} UNION ALL SELECT k + 1, {moved} FROM (
      SELECT k, {b}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({z}))) AS s FROM it, ({table}) WHERE k < {steps}) GROUP BY k, {b})) SELECT {b} FROM it WHERE k = {steps})"""


CLIP = "least(greatest(round(p, 2), 0.0001::DOUBLE), 1 - 0.0001::DOUBLE)"
TERMS = {"beta": ["ln({q})", "-ln(1 - {q})", "1.0::DOUBLE"], "platt": ["ln({q} / (1 - {q}))", "1.0::DOUBLE"]}


def logistic_sql(method):
    terms = [t.format(q="cq") for t in TERMS[method]]
    train = f"SELECT {', '.join(f'{t} AS x{k}' for k, t in enumerate(terms))}, win::INT AS y, 1 + u AS w FROM (SELECT *, {CLIP} AS cq FROM scored WHERE fold < 5 AND win IS NOT NULL)"
    z = " + ".join(f"b{k} * ({t})" for k, t in enumerate(terms))
    return f"SELECT day, slot, code, '{method}' AS method, 1 / (1 + exp(-({z}))) AS p_cal FROM (SELECT *, {CLIP} AS cq FROM scored WHERE fold >= 5), {newton_sql(train, [f'x{k}' for k in range(len(terms))], 0)}"


ISO = f"""SELECT day, slot, code, 'isotonic' AS method, CASE WHEN lo.x IS NULL THEN hi.v WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.v ELSE lo.v + (hi.v - lo.v) * (cq - lo.x) / (hi.x - lo.x) END AS p_cal
  FROM (SELECT *, {CLIP} AS cq FROM scored WHERE fold >= 5) t ASOF LEFT JOIN fit lo ON t.cq >= lo.x ASOF LEFT JOIN fit hi ON t.cq <= hi.x"""


@query("calibrate_probability", "day:d slot:s code:i method:s p_cal:r",
       f"""WITH knots AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(w) OVER (ORDER BY x) AS cw, sum(wy) OVER (ORDER BY x) AS cy FROM (SELECT {CLIP} AS x, sum(1 + u) AS w, sum((1 + u) * win::INT) AS wy FROM scored WHERE fold < 5 AND win IS NOT NULL GROUP BY 1)),
       means AS (SELECT a.i AS a, c.i AS c, (c.cy - coalesce(b.cy, 0)) / (c.cw - coalesce(b.cw, 0)) AS m FROM knots a LEFT JOIN knots b ON b.i = a.i - 1 JOIN knots c ON c.i >= a.i),
       fit AS (SELECT x, max(least_m) AS v FROM (SELECT k.x, a, min(m) AS least_m FROM knots k JOIN means ON a <= k.i AND c >= k.i GROUP BY 1, 2) GROUP BY x)
       {logistic_sql('beta')} UNION ALL {logistic_sql('platt')} UNION ALL {ISO}""")
def _(t):
    df = t.scored.withColumns({"w": 1 + F.col("u"), "p": F.round("p", 2)})
    out = [
        md.calibrate_probability(df.filter("fold < 5"), "p", "win", "w", m).score(df.filter("fold >= 5"), "p", "p_cal").withColumn("method", F.lit(m))
        for m in ("beta", "platt", "isotonic")
    ]
    return reduce(lambda a, b: a.unionByName(b), out)


TRIO = ["p", "q", "u"]
SHORTS = "SELECT * FROM scored WHERE net IS NOT NULL {where} QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 5"


def examples_sql(where):
    """Difference examples in both directions with the weight of their cross-section."""
    return f"""SELECT a.day, a.slot, a.code AS code_a, b.code AS code_b, a.p - b.p AS p, a.q - b.q AS q, a.u - b.u AS u, CAST(a.net > b.net AS INT) AS y, 1.0::DOUBLE / (n * (n - 1)) AS w
      FROM (SELECT *, count(*) OVER (PARTITION BY day, slot) AS n FROM ({SHORTS.format(where=where)})) a JOIN ({SHORTS.format(where=where)}) b ON a.day = b.day AND a.slot = b.slot AND a.code <> b.code
      WHERE NOT (abs(a.net - b.net) <= 1e-8 + 1e-5 * abs(CASE WHEN a.code < b.code THEN b.net ELSE a.net END))"""


def shortlist(t, where):
    return topk_per_group(t.scored.filter("net IS NOT NULL").filter(where), CS, SHORT(), 5)


@query("pairwise_examples", "day:d slot:s code_a:i code_b:i p:r q:r label:i weight:r",
       f"SELECT day, slot, code_a, code_b, p, q, y AS label, w / avg(w) OVER () AS weight FROM ({examples_sql('AND fold < 5')})")
def _(t):
    return fits.pairwise_examples(shortlist(t, "fold < 5"), CS, ["code"], ["p", "q"], "net")


SUM_B = " + ".join(f"b{k} * {f}" for k, f in enumerate(TRIO))


@query("pairwise_rank_fit", "day:d slot:s code:i rank_score:r",
       f"""WITH s AS (SELECT day, slot, code, {SUM_B} AS s FROM (SELECT * FROM scored WHERE fold >= 5 QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 5), {newton_sql(examples_sql('AND fold < 5'), TRIO, 0.01)})
       SELECT a.day, a.slot, a.code, coalesce(avg(1 / (1 + exp(b.s - a.s))), 0.5) AS rank_score FROM s a LEFT JOIN s b ON b.day = a.day AND b.slot = a.slot AND b.code <> a.code GROUP BY 1, 2, 3""")
def _(t):
    weights = md.pairwise_rank_fit(shortlist(t, "fold < 5"), CS, TRIO, "net")
    return md.pairwise_rank_score(topk_per_group(t.scored.filter("fold >= 5"), CS, SHORT(), 5), CS, weights)


CALIBRATED = f"""WITH m AS (SELECT * FROM {newton_sql(examples_sql('AND fold < 4'), TRIO, 0.01)}),
       c AS (SELECT a, c FROM {newton_sql(f"SELECT {SUM_B} AS z, 1.0::DOUBLE AS one, y, w FROM ({examples_sql('AND fold = 4')}), m", ['z', 'one'], 0).replace('SELECT b0, b1 FROM it', 'SELECT b0 AS a, b1 AS c FROM it')}),
       s AS (SELECT day, slot, code, {SUM_B} AS s FROM (SELECT * FROM scored WHERE fold >= 5 QUALIFY row_number() OVER (PARTITION BY day, slot ORDER BY p DESC, code) <= 5), m)
       SELECT x.day, x.slot, x.code, coalesce(avg((1 / (1 + exp(-(a * (x.s - y.s) + c))) + 1 - 1 / (1 + exp(-(a * (y.s - x.s) + c)))) / 2), 0.5) AS rank_score FROM c, s x LEFT JOIN s y ON y.day = x.day AND y.slot = x.slot AND y.code <> x.code GROUP BY 1, 2, 3"""


@query("pairwise_calibrated_score", "day:d slot:s code:i rank_score:r", CALIBRATED)
def _(t):
    weights = md.pairwise_rank_fit(shortlist(t, "fold < 4"), CS, TRIO, "net")
    calibration = fits.pair_calibration(shortlist(t, "fold = 4"), CS, TRIO, "net", weights)
    return fits.pairwise_calibrated_score(topk_per_group(t.scored.filter("fold >= 5"), CS, SHORT(), 5).select(*CS, "code", *TRIO), CS, weights, calibration)


WALK_ROWS = f"""SELECT d.fold, role, s.* EXCLUDE (fold) FROM (SELECT f.fold AS fold, k.day, CASE WHEN k.idx BETWEEN test_lo AND test_hi THEN 'test' WHEN k.idx BETWEEN train_lo AND cal_lo - 2 THEN 'train' END AS role
       FROM ({FOLDS}) f JOIN calendar k ON k.idx BETWEEN train_lo AND test_hi) d JOIN scored s USING (day) WHERE role IS NOT NULL"""


@query("walk_forward_score", "fold:i day:d slot:s code:i e_net:r",
       f"""WITH r AS ({WALK_ROWS}), m AS (SELECT fold, avg(ret) AS mr, avg(gap) AS mg FROM r WHERE role = 'train' AND net IS NOT NULL GROUP BY fold),
       f AS (SELECT r.* EXCLUDE (ret, gap), coalesce(ret, mr) AS a, coalesce(gap, mg) AS b FROM r JOIN m USING (fold)),
       c AS (SELECT fold, avg(a) AS ma, avg(b) AS mb, avg(net) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) AS rab, covar_pop(a, net) / stddev_pop(a) AS ca, covar_pop(b, net) / stddev_pop(b) AS cb FROM f WHERE role = 'train' AND net IS NOT NULL GROUP BY fold)
       SELECT fold, day, slot, code, my + (a - ma) / sa * (1.1::DOUBLE * ca - rab * cb) / (1.1::DOUBLE * 1.1::DOUBLE - rab * rab) + (b - mb) / sb * (1.1::DOUBLE * cb - rab * ca) / (1.1::DOUBLE * 1.1::DOUBLE - rab * rab) AS e_net FROM f JOIN c USING (fold) WHERE role = 'test'""")
def _(t):
    return fits.walk_forward_ridge(t.scored.drop("fold"), t.calendar, fd.walk_forward_folds(t.calendar, PLAN), PLAN, ["ret", "gap"], "net")


@query("walk_forward_blend", "fold:i day:d slot:s code:i e_net:r")
def _(t):
    days = fd.fold_days(t.calendar, fd.walk_forward_folds(t.calendar, PLAN), PLAN).collect()  # a handful of folds
    return md.walk_forward_days(
        weighted(t).drop("fold"), days,
        lambda train: md.fit_return_blend(train, FEATURES, "net", "w"),
        lambda model, test: model.score(test, "e_net"),
    )
