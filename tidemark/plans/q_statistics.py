"""Queries for evaluation statistics."""

from pyspark.sql import functions as F

from ..operators import statistics as op
from ..operators import windows
from .registry import query

CS = ["day", "slot"]
Z = 1.959963984540054


def wilson(w, n, side):
    p = f"({w}::DOUBLE / {n})"
    sign = "-" if side == "lower" else "+"
    return f"(({p} + {Z * Z} / (2 * {n})) {sign} {Z} * sqrt({p} * (1 - {p}) / {n} + {Z * Z} / (4 * {n}::DOUBLE * {n}))) / (1 + {Z * Z} / {n})"


PF = "CASE WHEN sum(net) FILTER (WHERE net < 0) < 0 THEN coalesce(sum(net) FILTER (WHERE net > 0), 0) / -sum(net) FILTER (WHERE net < 0) WHEN sum(net) FILTER (WHERE net > 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END"


@query("performance_summary", "slot:s events:i trade_days:i wins:i win_rate:r wilson_lower:r wilson_upper:r mean_net:r median_net:r worst_net:r best_net:r severe_rate:r profit_factor:r entry_fill_rate:r exit_fill_rate:r stress_50:r day_equal_mean:r day_win_rate:r log_compounded:r max_drawdown:r",
       f"""SELECT * FROM (SELECT slot, count(*) AS events, count(DISTINCT day) AS trade_days, sum(win::INT) AS wins, avg(win::INT) AS win_rate, {wilson('sum(win::INT)', 'count(*)', 'lower')} AS wilson_lower,
       {wilson('sum(win::INT)', 'count(*)', 'upper')} AS wilson_upper, avg(net) AS mean_net, median(net) AS median_net, min(net) AS worst_net, max(net) AS best_net, avg((net <= -2)::INT) AS severe_rate, {PF} AS profit_factor,
       avg(entry_ok::INT) AS entry_fill_rate, sum((entry_ok AND exit_ok)::INT)::DOUBLE / sum(entry_ok::INT) AS exit_fill_rate, avg(net - 0.15::DOUBLE * entry_ok::INT) AS stress_50 FROM scored GROUP BY slot)
       JOIN (SELECT slot, avg(m) AS day_equal_mean, avg((m > 0)::INT) AS day_win_rate, ln(arg_max(e, day)) AS log_compounded, min((e / greatest(pk, 1) - 1) * 100) AS max_drawdown FROM (SELECT *, max(e) OVER (PARTITION BY slot ORDER BY day) AS pk FROM (
       SELECT *, product(1 + m / 100) OVER (PARTITION BY slot ORDER BY day) AS e FROM (SELECT slot, day, avg(net) AS m FROM scored GROUP BY slot, day))) GROUP BY slot) USING (slot)""")
def _(t):
    out = op.performance_summary(t.scored, ["slot"], "day", "net")
    # the synthetic returns compound to some 1e55, so the exponent is compared
    return out.withColumn("log_compounded", F.log1p("compounded"))


@query("wilson_interval", "code:i wilson_lower:r wilson_upper:r",
       f"SELECT code, {wilson('w', 'n', 'lower')} AS wilson_lower, {wilson('w', 'n', 'upper')} AS wilson_upper FROM (SELECT code, sum(win::INT) AS w, count(*) AS n FROM scored GROUP BY code)")
def _(t):
    n = t.scored.groupBy("code").agg(F.sum(F.col("win").cast("int")).alias("w"), F.count(F.lit(1)).alias("n"))
    return op.wilson_interval(n, "w", "n")


@query("profit_factor", "day:d code:i profit_factor:r", f"SELECT day, code, {PF} AS profit_factor FROM scored GROUP BY day, code")
def _(t):
    return op.profit_factor(t.scored, ["day", "code"], "net")


@query("cost_stress", "slot:s cost_bps:r mean_net:r win_rate:r positive_total:b",
       """SELECT slot, c AS cost_bps, avg(x) AS mean_net, avg((x > 0)::INT) AS win_rate, sum(x) > 0 AS positive_total FROM (
       SELECT slot, c, net - (c - 35) / 100.0::DOUBLE * entry_ok::INT AS x FROM scored, (VALUES (35), (50), (75), (100)) v(c)) GROUP BY slot, c""")
def _(t):
    return op.cost_stress(t.scored, ["slot"], "net", "entry_ok", [35, 50, 75, 100])


@query("cost_stress_flat", "slot:s cost_bps:r mean_net:r win_rate:r",
       "SELECT slot, 50 AS cost_bps, avg(net - 0.5) AS mean_net, avg((net - 0.5 > 0)::INT) AS win_rate FROM scored GROUP BY slot")
def _(t):
    return op.cost_stress(t.scored, ["slot"], "net", None, [50])


@query("economic_metrics", "slot:s events:i hit_rate:r tail_rate:r mean_net:r",
       "SELECT slot, count(*) AS events, avg((net > 0.5)::INT) AS hit_rate, avg((net <= -2)::INT) AS tail_rate, avg(net) AS mean_net FROM scored GROUP BY slot")
def _(t):
    return op.economic_metrics(t.scored, ["slot"], "net")


def draw(n, seed, sample="s", block="b"):
    return f"CAST('0x' || substr(md5(concat_ws('|', {seed}, {sample}, {block})), 1, 15) AS BIGINT) % {n}"


@query("block_bootstrap_days", "slot:s days:i observations:i win_rate_lower:r win_rate_upper:r mean_lower:r mean_upper:r",
       f"""WITH d AS (SELECT slot, day, sum(win::INT) AS w, count(*) AS o, sum(net) AS r, row_number() OVER (PARTITION BY slot ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY slot) AS n FROM scored GROUP BY slot, day),
       g AS (SELECT slot, n, sum(o) AS obs FROM d GROUP BY slot, n),
       x AS (SELECT slot, n, s, b, k, ({draw('n', 20260727)} + k) % n AS i FROM g, range(4000) a(s), range(CAST(ceil(n / 5.0) AS BIGINT)) c(b), range(5) e(k) WHERE b * 5 + k < n),
       m AS (SELECT x.slot, s, sum(w)::DOUBLE / sum(o) AS wr, sum(r) / sum(o) AS mr FROM x JOIN d USING (slot, i) GROUP BY x.slot, s)
       SELECT m.slot, any_value(n) AS days, any_value(obs) AS observations, quantile_cont(wr, 0.025) AS win_rate_lower, quantile_cont(wr, 0.975) AS win_rate_upper, quantile_cont(mr, 0.025) AS mean_lower, quantile_cont(mr, 0.975) AS mean_upper
       FROM m JOIN g USING (slot) GROUP BY m.slot""")
def _(t):
    return op.block_bootstrap_days(t.scored, ["slot"], "day", "net", samples=4000)


@query("iid_day_bootstrap", "slot:s days:i q05:r q50:r q95:r",
       f"""WITH d AS (SELECT slot, day, avg(p) AS m, row_number() OVER (PARTITION BY slot ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY slot) AS n FROM scored GROUP BY slot, day),
       x AS (SELECT slot, n, s, {draw('n', 5)} AS i FROM (SELECT DISTINCT slot, n FROM d), range(2000) a(s), range(n) c(b)),
       m AS (SELECT x.slot, s, any_value(x.n) AS n, avg(m) AS v FROM x JOIN d USING (slot, i) GROUP BY x.slot, s)
       SELECT slot, any_value(n) AS days, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95 FROM m GROUP BY slot""")
def _(t):
    return op.iid_day_bootstrap(t.scored, ["slot"], "day", "p", samples=2000, seed=5)


@query("hac_mean_test", "slot:s n:i mean:r se:r t_stat:r lags:i",
       """WITH d AS (SELECT slot, day, avg(net) AS m FROM scored GROUP BY slot, day), c AS (SELECT *, m - avg(m) OVER (PARTITION BY slot) AS c FROM d),
       l AS (SELECT *, """ + ", ".join(f"c * lag(c, {k}) OVER w AS x{k}" for k in range(1, 6)) + """ FROM c WINDOW w AS (PARTITION BY slot ORDER BY day)),
       v AS (SELECT slot, count(*) AS n, avg(m) AS mean, avg(c * c) + """ + " + ".join(f"2 * (1 - {k} / 6.0::DOUBLE) * sum(x{k}) / count(*)" for k in range(1, 6)) + """ AS v FROM l GROUP BY slot)
       SELECT slot, n, mean, sqrt(greatest(v, 0) / n) AS se, mean / sqrt(greatest(v, 0) / n) AS t_stat, 5 AS lags FROM v""")
def _(t):
    return op.hac_mean_test(t.scored, ["slot"], "day", "net")


@query("z_mean_test", "code:i n:i mean:r z:r p_value:r",
       """SELECT *, CASE WHEN z IS NOT NULL THEN 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(80), lambda k: exp(k * ln(4) + lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(greatest(z, 1e-300) / sqrt(2)))))
       WHEN n >= 3 AND mean <> 0 THEN 0 ELSE 1 END AS p_value FROM (SELECT code, count(*) AS n, avg(net) AS mean, CASE WHEN count(*) >= 3 THEN abs(avg(net)) / (stddev_samp(net) / sqrt(count(*))) END AS z FROM scored GROUP BY code)""")
def _(t):
    return op.z_mean_test(t.scored, ["code"], "net")


@query("benjamini_hochberg", "fold:i day:d code:i q_value:r",
       """SELECT fold, day, code, least(min(a) OVER (PARTITION BY fold ORDER BY r DESC), 1) AS q_value FROM (SELECT *, pv * count(*) OVER (PARTITION BY fold) / r AS a FROM (
       SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pv, day, code) AS r FROM (SELECT fold, day, code, min(u) * min(u) * min(u) AS pv FROM scored GROUP BY fold, day, code)))""")
def _(t):
    m = F.min("u")
    p = t.scored.groupBy("fold", "day", "code").agg((m * m * m).alias("pv"))
    return op.benjamini_hochberg(p, "pv", ["day", "code"], ["fold"])


@query("expected_calibration_error", "fold:i rows:i ece:r",
       "SELECT fold, sum(n) AS rows, sum(n * abs(y - m)) / sum(n) AS ece FROM (SELECT fold, least(floor(p * 10), 9) AS b, count(*) AS n, avg(win::INT) AS y, avg(p) AS m FROM scored GROUP BY 1, 2) GROUP BY fold")
def _(t):
    return op.expected_calibration_error(t.scored, ["fold"], "win", "p")


@query("calibration_table", "bin:i bin_left:r rows:i days:i win_rate:r wilson_lower:r clustered_lower:r",
       f"""WITH s AS (SELECT *, CAST(least(floor(p * 10), 9) AS INT) AS bin FROM scored),
       d AS (SELECT bin, day, sum(win::INT) AS w, count(*) AS o, row_number() OVER (PARTITION BY bin ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY bin) AS n FROM s GROUP BY bin, day),
       x AS (SELECT bin, s, {draw('n', 3)} AS i FROM (SELECT DISTINCT bin, n FROM d), range(500) a(s), range(n) c(b)),
       m AS (SELECT x.bin, s, sum(w)::DOUBLE / sum(o) AS v FROM x JOIN d USING (bin, i) GROUP BY x.bin, s)
       SELECT bin, bin / 10.0::DOUBLE AS bin_left, count(*) AS rows, count(DISTINCT day) AS days, avg(win::INT) AS win_rate, {wilson('sum(win::INT)', 'count(*)', 'lower')} AS wilson_lower, any_value(c) AS clustered_lower
       FROM s JOIN (SELECT bin, quantile_cont(v, 0.025) AS c FROM m GROUP BY bin) USING (bin) GROUP BY bin""")
def _(t):
    return op.calibration_table(t.scored, "win", "p", "day", samples=500, seed=3)


def sections(score, extra="", min_n=2):
    return f"""SELECT {extra} day, slot, CASE WHEN stddev_pop(a) * stddev_pop(b) > 0 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) ELSE 0 END AS ic,
    arg_max(net, ROW({score}, -code)) - arg_min(net, ROW({score}, -code)) AS spread FROM (SELECT *, rank() OVER (PARTITION BY {extra} day, slot ORDER BY {score}) + (count(*) OVER (PARTITION BY {extra} day, slot, {score}) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (PARTITION BY {extra} day, slot ORDER BY net) + (count(*) OVER (PARTITION BY {extra} day, slot, net) - 1) / 2.0::DOUBLE AS b FROM {{src}}) GROUP BY {extra} day, slot HAVING count(*) >= {min_n}"""


@query("rank_ic", "fold:i sections:i days:i mean_ic:r mean_spread:r positive_days:r",
       f"""SELECT fold, sum(n) AS sections, count(*) AS days, avg(ic) AS mean_ic, avg(spread) AS mean_spread, avg((ic > 0)::INT) AS positive_days FROM (
       SELECT fold, day, count(*) AS n, avg(ic) AS ic, avg(spread) AS spread FROM ({sections('p', 'fold,').format(src='scored')}) GROUP BY fold, day) GROUP BY fold""")
def _(t):
    return op.rank_ic(t.scored, CS, "day", "p", "net", "code", by=["fold"])


FEATURES = ["p", "q", "ret", "gap", "dist_up", "ret_open"]
LONG = "(" + " UNION ALL ".join(f"SELECT '{f}' AS feature, day, slot, code, net, {f} AS value FROM scored WHERE {f} IS NOT NULL" for f in FEATURES) + ")"
SCREEN = f"""WITH c AS ({sections('value', 'feature,', 4).format(src=LONG)}), d AS (SELECT feature, day, avg(ic) AS ic, avg(spread) AS spread, count(*) AS n FROM c GROUP BY feature, day),
  y AS (SELECT feature, sum((m > 0)::INT) AS positive_years, min(m) AS min_year_ic FROM (SELECT feature, year(day) AS y, avg(ic) AS m FROM d GROUP BY 1, 2) GROUP BY feature)
  SELECT feature, sum(n) AS sections, count(*) AS days, avg(ic) AS mean_ic, abs(avg(ic)) / (stddev_samp(ic) / sqrt(count(*))) AS z, avg(spread) AS mean_spread, avg((ic > 0)::INT) AS positive_days, any_value(positive_years) AS positive_years, any_value(min_year_ic) AS min_year_ic
  FROM d JOIN y USING (feature) GROUP BY feature"""


def screen(t):
    return op.feature_ic_screen(t.scored, CS, "day", FEATURES, "net", "code")


@query("feature_ic_screen", "feature:s sections:i days:i mean_ic:r z:r mean_spread:r positive_days:r positive_years:i min_year_ic:r", SCREEN)
def _(t):
    return screen(t)


@query("feature_family_summary", "family:s features:i best_feature:s best_strength:r",
       f"""SELECT CASE WHEN feature IN ('p', 'q') THEN 'score' ELSE 'price' END AS family, count(*) AS features, arg_max(feature, ROW(round(abs(mean_ic), 9), feature)) AS best_feature, max(abs(mean_ic)) AS best_strength FROM ({SCREEN}) GROUP BY 1""")
def _(t):
    family = F.when(F.col("feature").isin("p", "q"), "score").otherwise("price")
    return op.feature_family_summary(screen(t).withColumns({"family": family, "strength": F.round(F.abs("mean_ic"), 9)}), "family", "strength")


@query("composite_rank", "day:d slot:s code:i composite:r",
       """SELECT day, slot, code, 0.6 * (rank() OVER (PARTITION BY day, slot ORDER BY p) + (count(*) OVER (PARTITION BY day, slot, p) - 1) / 2.0::DOUBLE) / count(*) OVER w
       + 0.4 * (rank() OVER (PARTITION BY day, slot ORDER BY risk DESC) + (count(*) OVER (PARTITION BY day, slot, risk) - 1) / 2.0::DOUBLE) / count(*) OVER w AS composite FROM scored WINDOW w AS (PARTITION BY day, slot)""")
def _(t):
    return op.composite_rank(t.scored, CS, {"p": 0.6, "risk": -0.4})


@query("group_attribution", "dimension:s bucket:s events:i days:i win_rate:r mean_net:r profit_factor:r",
       f"""SELECT dimension, bucket, count(*) AS events, count(DISTINCT day) AS days, avg(win::INT) AS win_rate, avg(net) AS mean_net, {PF} AS profit_factor FROM (
       SELECT 'region' AS dimension, CAST(region AS VARCHAR) AS bucket, day, net, win FROM scored UNION ALL SELECT 'slot', slot, day, net, win FROM scored
       UNION ALL SELECT 'p', 'Q' || CAST(CAST(least(greatest(ceil(round((row_number() OVER (ORDER BY p, day, slot, code) - 1) * 5 / (count(*) OVER () - 1)::DOUBLE, 9)), 1), 5) AS INT) AS VARCHAR), day, net, win FROM scored) GROUP BY 1, 2""")
def _(t):
    return op.group_attribution(t.scored, ["region", "slot"], {"p": 5}, "net", "day", ["day", "slot", "code"])


RANKED = "SELECT day, net, row_number() OVER (PARTITION BY day ORDER BY p DESC, slot, code) AS r FROM scored"


@query("rank_monotonicity", "ordered_pairs:i mean_1:r mean_2:r mean_3:r mean_4:r mean_5:r complete_days:i slope_mean:r spread_mean:r slope_lower:r slope_upper:r p_slope_negative:r",
       f"""WITH k AS (SELECT * FROM ({RANKED}) WHERE r <= 5), a AS (SELECT r, avg(net) AS m FROM k GROUP BY r),
       w AS (SELECT day, sum(net * (r - 3) / 10.0::DOUBLE) AS slope, max(net) FILTER (WHERE r = 1) - max(net) FILTER (WHERE r = 5) AS spread FROM k GROUP BY day HAVING count(*) = 5),
       d AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM w),
       x AS (SELECT s, ({draw('n', 9)} + k) % n AS i FROM (SELECT DISTINCT n FROM d), range(2000) a(s), range(CAST(ceil(n / 5.0) AS BIGINT)) c(b), range(5) e(k) WHERE b * 5 + k < n),
       v AS (SELECT s, avg(slope) AS v FROM x JOIN d USING (i) GROUP BY s)
       SELECT (SELECT sum((m >= nx)::INT) FROM (SELECT m, lead(m) OVER (ORDER BY r) AS nx FROM a)) AS ordered_pairs, (SELECT m FROM a WHERE r = 1) AS mean_1, (SELECT m FROM a WHERE r = 2) AS mean_2, (SELECT m FROM a WHERE r = 3) AS mean_3, (SELECT m FROM a WHERE r = 4) AS mean_4, (SELECT m FROM a WHERE r = 5) AS mean_5,
       (SELECT count(*) FROM w) AS complete_days, (SELECT avg(slope) FROM w) AS slope_mean, (SELECT avg(spread) FROM w) AS spread_mean, quantile_cont(v, 0.025) AS slope_lower, quantile_cont(v, 0.975) AS slope_upper, avg((v < 0)::INT) AS p_slope_negative FROM v""")
def _(t):
    ranked = windows.cs_first_rank(t.scored, ["day"], "p", ["slot", "code"], "r")
    return op.rank_monotonicity(ranked, "day", "r", "net", 5, samples=2000, seed=9)


@query("policy_overfit_probability", "splits:i overfit_probability:r",
       """WITH h AS (SELECT fold, g, net FROM scored, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE)) v(g) WHERE p >= g QUALIFY row_number() OVER (PARTITION BY g, day, code ORDER BY slot) = 1),
       f AS (SELECT fold, row_number() OVER (ORDER BY fold) AS f, count(*) OVER () AS k FROM (SELECT DISTINCT fold FROM scored)),
       t AS (SELECT split, g, f <= split AS inside, count(*) AS n, avg(net) AS m, abs(avg(net) FILTER (WHERE net < 0)) AS l FROM h JOIN f USING (fold), range(2, 7) s(split) WHERE split < k GROUP BY 1, 2, 3),
       v AS (SELECT split, g, inside, CASE WHEN n >= 5 THEN m / greatest(coalesce(l, 0.01), 0.01) ELSE -999 END AS v FROM t),
       w AS (SELECT split, g, coalesce(max(v) FILTER (WHERE inside), -999) AS a, coalesce(max(v) FILTER (WHERE NOT inside), -999) AS b FROM v GROUP BY 1, 2),
       j AS (SELECT split, arg_max(b, ROW(a, -g)) AS best, median(b) AS med FROM w GROUP BY split) SELECT count(*) AS splits, avg((best < med)::INT) AS overfit_probability FROM j""")
def _(t):
    return op.policy_overfit_probability(t.scored, "fold", "day", ["code"], "slot", [0.3, 0.5, 0.7, 0.9], "p", "net")


@query("benchmark_cohorts", "cohort:s events:i win_rate:r mean_net:r",
       " UNION ALL ".join(f"SELECT '{n}' AS cohort, count(*) AS events, avg(win::INT) AS win_rate, avg(net) AS mean_net FROM scored WHERE {c}" for n, c in
                         (("all_eligible", "entry_ok AND slot = '14:50'"), ("band", "entry_ok AND slot = '14:50' AND ret BETWEEN 8 AND 12"))))
def _(t):
    e = F.col("entry_ok") & (F.col("slot") == "14:50")
    return op.benchmark_cohorts(t.scored, {"all_eligible": e, "band": e & F.col("ret").between(8, 12)}, "net")


@query("one_sided_residual_quantile", "nation:i n:i adjustment:r",
       """SELECT nation, n, least(CASE WHEN n >= 1000 THEN own ELSE (SELECT quantile_cont(net - ret, 0.1) FROM scored WHERE ret IS NOT NULL) END, 0) AS adjustment FROM (
       SELECT nation, count(*) AS n, quantile_cont(net - ret, 0.1) AS own FROM scored WHERE ret IS NOT NULL GROUP BY nation)""")
def _(t):
    return op.one_sided_residual_quantile(t.scored.withColumn("resid", F.col("net") - F.col("ret")), "nation", "resid", 0.1, 1000)


@query("weighted_quantile", "fold:i weighted_quantile:r",
       """SELECT fold, min(net) FILTER (WHERE c >= 0.8::DOUBLE * tot) AS weighted_quantile FROM (SELECT fold, net, sum(w) OVER (PARTITION BY fold ORDER BY net) AS c, sum(w) OVER (PARTITION BY fold) AS tot FROM (
       SELECT fold, net, sum(CAST(vol AS BIGINT)) AS w FROM scored GROUP BY fold, net)) GROUP BY fold""")
def _(t):
    return op.weighted_quantile(t.scored.withColumn("w", F.col("vol").cast("bigint")), ["fold"], "net", "w", 0.8)


@query("compounded_return", "fold:i complete_days:i compounded:r",
       "SELECT fold, count(*) AS complete_days, (product(1 + m / 100) - 1) * 100 AS compounded FROM (SELECT fold, day, avg(net) / 10 AS m FROM scored GROUP BY fold, day HAVING min((risk > 0.0005)::INT) = 1) GROUP BY fold")
def _(t):
    df = t.scored.withColumns({"ok": F.col("risk") > 0.0005, "r": F.col("net") / 10})
    return op.compounded_return(df, ["fold"], "day", "r", "ok")


@query("cohort_validation_view", "year:i slot:s day:d candidates:i verified_count:i wins:i portfolio_return:r state:s",
       """SELECT year(day) AS year, slot, day, count(*) AS candidates, sum(ok) AS verified_count, sum(ok * win::INT) AS wins, CASE WHEN sum(ok) = count(*) THEN avg(net) END AS portfolio_return,
       CASE WHEN sum(ok) = count(*) THEN 'verified' WHEN sum(ok) > 0 THEN 'partial' ELSE 'pending' END AS state FROM (SELECT *, (risk > 0.02)::INT AS ok FROM scored) GROUP BY 1, 2, 3""")
def _(t):
    df = t.scored.withColumns({"year": F.year("day"), "ok": F.col("risk") > 0.02})
    return op.cohort_validation_view(df, "year", "slot", "day", "net", "ok")
