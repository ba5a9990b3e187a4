"""Threshold gates, funnels, policy grids, cohorts and promotion checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import all_of, holds, ratio, share
from .joins import grid_cross_join, grid_rows
from .selection import first_signal_daily_cap
from .spread import CALENDAR, average_ranks, best_rows, calendar_rows, group_values, percentile_rank, percentile_ranks, position
from .statistics import profit_factor_of, wilson_bounds

# a gate is (column, ">=", ">" or "<=", limit)
Gates = dict[str, tuple[str, str, float]]


def _count():
    return F.count(F.lit(1))


def gate_column(gate) -> Column:
    column, sign, limit = gate
    tests = {">=": F.col(column) >= limit, ">": F.col(column) > limit, "<=": F.col(column) <= limit}
    return holds(tests[sign])


def apply_thresholds(df, gates: Gates, out="passes") -> DataFrame:
    """All gates as one boolean; NULL fails."""
    return df.withColumn(out, all_of([gate_column(g) for g in gates.values()]))


def gate_diagnostics(df, gates: Gates) -> DataFrame:
    """One boolean per gate, the conjunction and the pipe-joined names of failed gates."""
    df = df.withColumns({n: gate_column(g) for n, g in gates.items()})
    failed = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in gates]))
    return df.withColumns(
        {"passes": all_of([F.col(n) for n in gates]), "failed_gates": F.array_join(failed, "|")}
    )


def gate_distance(df, gates: Gates) -> DataFrame:
    """Number of failed gates and the summed shortfall; a NULL makes the distance NULL."""
    failed, gap = F.lit(0), F.lit(0.0)
    for column, sign, limit in gates.values():
        failed = failed + (~gate_column((column, sign, limit))).cast("int")
        short = F.lit(limit) - F.col(column) if sign in (">=", ">") else F.col(column) - F.lit(limit)
        gap = gap + F.when(short > 0, short).when(short <= 0, 0.0)
    return df.withColumns({"failed_gate_count": failed, "failed_gate_distance": gap})


def sequential_funnel(df, stages: dict[str, Column], day, code, slot, score, cap=None, on=()) -> DataFrame:
    """Rows, days and codes that remain after each stage, and rows lost at it.

    The first failed stage of a row is computed once; days and codes remain as far as
    their farthest row. ``cap`` adds a last stage: first occurrence per day, at most ``cap`` a day.
    """
    names = list(stages)
    first = F.coalesce(*[F.when(~holds(c), F.lit(i)) for i, c in enumerate(stages.values(), 1)], F.lit(len(names) + 1))
    df = df.withColumn("_stop", first)
    if cap is not None:
        passed = df.filter(F.col("_stop") == len(names) + 1)
        kept = first_signal_daily_cap(passed, F.lit(True), [day], [code], slot, score, cap)
        kept = kept.select(*on, F.lit(1).alias("_kept"))
        df = df.join(kept, list(on), "left").withColumn(
            "_stop", F.when((F.col("_stop") == len(names) + 1) & F.col("_kept").isNotNull(), len(names) + 2).otherwise(F.col("_stop"))
        )
        names.append("daily_cap")
    labels = ["source", *names]
    # one row per day and code first; rows, days and codes are then counted on that
    cells = df.groupBy(F.col(day).alias("_day"), F.col(code).alias("_code")).agg(
        F.max("_stop").alias("_far"), *[F.count(F.when(F.col("_stop") == j, 1)).alias(f"_h{j}") for j in range(len(labels) + 1)]
    )
    rows = cells.agg(*[F.coalesce(F.sum(f"_h{j}"), F.lit(0)).alias(f"_h{j}") for j in range(len(labels) + 1)])
    for key, tag in (("_day", "_d"), ("_code", "_c")):
        far = cells.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("_far").alias("_far"))
        rows = rows.crossJoin(far.agg(*[F.count(F.when(F.col("_far") > i, 1)).alias(f"{tag}{i}") for i in range(len(labels))]))
    stats = [
        F.struct(
            F.lit(i).alias("stage_order"), F.lit(n).alias("stage"),
            reduce(lambda x, y: x + y, [F.col(f"_h{j}") for j in range(i + 1, len(labels) + 1)]).alias("rows_remaining"),
            F.col(f"_d{i}").alias("days_remaining"), F.col(f"_c{i}").alias("codes_remaining"), F.col(f"_h{i}").alias("rejected"),
        )
        for i, n in enumerate(labels)
    ]
    t = rows.select(F.array(*stats).alias("_a"))
    source = F.col("_a")[0]
    t = t.select(source["rows_remaining"].alias("_r"), source["days_remaining"].alias("_d"), F.inline("_a"))
    return t.withColumns(
        {"row_retention": ratio("rows_remaining", F.greatest("_r", F.lit(1))), "day_retention": ratio("days_remaining", F.greatest("_d", F.lit(1)))}
    ).drop("_r", "_d")


def event_metrics(df, by, ret, day) -> DataFrame:
    clean = df.filter(F.col(ret).isNotNull())
    t = clean.groupBy(*by).agg(
        _count().alias("events"), F.countDistinct(day).alias("days"), F.sum(share(F.col(ret) > 0)).cast("bigint").alias("wins"),
        F.avg(ret).alias("mean_net"), profit_factor_of(ret).alias("profit_factor"),
    )
    lo, _ = wilson_bounds("wins", "events")
    return t.withColumns({"win_rate": ratio("wins", "events"), "wilson_lower": lo})


def grid_selection(df, grid, pass_expr, loosest, day, code, slot, score, by=(), cap=None) -> DataFrame:
    """Rows each grid policy selects: first crossing per stock-day, optional daily cap."""
    hits = grid_cross_join(df, grid, pass_expr, loosest)
    keys = [*by, "policy", *day]
    if cap is None:
        return best_rows(hits, [*keys, *code], [F.col(slot), F.col(score).desc_nulls_last()], 1)
    return first_signal_daily_cap(hits, F.lit(True), keys, code, slot, score, cap)


def policy_grid_metrics(df, grid, pass_expr, loosest, day, code, slot, score, ret, by=(), cap=None) -> DataFrame:
    """Metrics of every grid policy in one job."""
    chosen = grid_selection(df, grid, pass_expr, loosest, [day], code, slot, score, by, cap)
    return event_metrics(chosen, [*by, "policy"], ret, day)


def _champion_order():
    return [F.col(c).desc() for c in ("wilson_lower", "win_rate", "mean_net", "profit_factor")] + [F.col("policy")]


def nested_policy_select(design, confirmation, grid, pass_expr, loosest, gates: Gates, **cols) -> DataFrame:
    """Best design policy that passes the gates, then its one confirmation reading."""
    d = policy_grid_metrics(design, grid, pass_expr, loosest, **cols)
    best = apply_thresholds(d, gates, "_ok").filter("_ok").orderBy(*_champion_order()).limit(1).drop("_ok")
    c = policy_grid_metrics(confirmation, grid, pass_expr, loosest, **cols)
    c = apply_thresholds(c, gates, "confirmed").select(
        "policy", "confirmed", *[F.col(n).alias(f"confirm_{n}") for n in ("events", "win_rate", "mean_net")]
    )
    return best.join(c, "policy", "left").withColumn("confirmed", holds(F.col("confirmed")))


def policy_windows(df, day, fold, design_days, confirm_days) -> DataFrame:
    """(target fold, day, role): the last design + confirmation days before each fold.

    Built from one row per day; a fold with too little history has no rows.
    """
    days = df.groupBy(day).agg(F.min(fold).alias(fold))
    days = position(calendar_rows(days, []), [], [F.col(day)], "_i", bound=CALENDAR)
    starts = days.groupBy(fold).agg(F.min("_i").alias("_s")).withColumnRenamed(fold, "target_fold")
    total = design_days + confirm_days
    spans = starts.filter(F.col("_s") > total).withColumn(
        "_i", F.explode(F.sequence(F.col("_s") - total, F.col("_s") - 1))
    )
    role = F.when(F.col("_i") < F.col("_s") - confirm_days, "design").otherwise("confirm")
    return spans.withColumn("role", role).join(days.select("_i", day), "_i").select("target_fold", day, "role")


def nested_oos_apply(df, grid, pass_expr, loosest, day, fold, code, slot, score, ret, design_days, confirm_days, gates: Gates) -> DataFrame:
    """Each fold gets the policy chosen on the days before it, applied to its own rows.

    Every fold's design and confirmation metrics come from one grid job keyed by
    (target_fold, role, policy). Returns the fold's rows with policy and ``passes_policy``.
    """
    windows = policy_windows(df, day, fold, design_days, confirm_days)
    history = df.join(windows, day)
    metrics = policy_grid_metrics(
        history, grid, pass_expr, loosest, day, code, slot, score, ret, by=["target_fold", "role"]
    )
    ok = apply_thresholds(metrics, gates, "_ok").filter("_ok")
    champion = best_rows(ok.filter("role = 'design'"), ["target_fold"], _champion_order(), 1)
    sure = ok.filter("role = 'confirm'").select("target_fold", "policy")
    chosen = champion.join(sure, ["target_fold", "policy"], "left_semi").select(
        F.col("target_fold").alias(fold), "policy"
    )
    rules = df.sparkSession.range(1).select(F.inline(grid_rows(grid)))
    chosen = chosen.join(rules, "policy")
    out = df.join(chosen, fold, "left")
    return out.withColumn("passes_policy", holds(pass_expr))


# ---- cohorts ---------------------------------------------------------------


def joint_gate_cohorts(df, cs, rank_of, grid, pass_expr, loosest, day, code, slot, score, ret) -> DataFrame:
    """Return summary for each combination of a rank floor and other thresholds."""
    ranked = percentile_rank(df, cs, rank_of, "rank_pct")
    return policy_grid_metrics(ranked, grid, pass_expr, loosest, day, code, slot, score, ret)


def extreme_rank_cohorts(df, cs, name, floors, tie, day, code, slot, ret) -> DataFrame:
    """First crossings above each ordinal-rank percentile floor."""
    df = position(df.filter(F.col(name).isNotNull()), cs, [F.col(name), *[F.col(c) for c in tie]], "_r")
    df = group_values(df, cs, {"_n": _count()}).withColumn("_pct", F.col("_r") / F.col("_n"))
    grid = [{"policy": i, "floor": float(f)} for i, f in enumerate(floors)]
    t = policy_grid_metrics(df, grid, F.col("_pct") >= F.col("floor"), F.col("_pct") >= min(floors), day, code, slot, "_pct", ret)
    spec = reduce(lambda a, g: F.when(F.col("policy") == g["policy"], g["floor"]).otherwise(a), grid, F.lit(None))
    return t.withColumn("floor", spec)


def topn_cohorts(df, cs, score, tie, ns, day, code, slot, ret) -> DataFrame:
    """First crossings of the best n per cross-section, one row per n."""
    order = [F.col(score).desc_nulls_last(), *[F.col(c) for c in tie]]
    short = best_rows(df.filter(F.col(score).isNotNull()), cs, order, max(ns))
    short = position(short, cs, order, "_r", bound=max(ns))
    grid = [{"policy": n} for n in ns]
    t = policy_grid_metrics(short, grid, F.col("_r") <= F.col("policy"), None, day, code, slot, score, ret)
    return t.withColumnRenamed("policy", "top_n")


def feature_tail_audit(df, cs, features, tails, day, code, slot, ret) -> DataFrame:
    """Cohort metrics of the highest and lowest share of every feature."""
    df = percentile_ranks(df, cs, {f"_t{i}": f for i, f in enumerate(features)})
    hits = []
    for i, f in enumerate(features):
        for tail in tails:
            for side, cond in (("high", F.col(f"_t{i}") >= 1 - tail), ("low", F.col(f"_t{i}") <= tail)):
                item = F.struct(F.lit(f).alias("feature"), F.lit(side).alias("direction"), F.lit(float(tail)).alias("tail"))
                hits.append(F.when(cond, item))
    long = df.select(day, *code, slot, ret, F.inline(F.array_compact(F.array(*hits))))
    keys = ["feature", "direction", "tail"]
    first = best_rows(long, [*keys, day, *code], [F.col(slot)], 1)
    return event_metrics(first, keys, ret, day)


# ---- splits, thresholds, checks -------------------------------------------


def lockbox_split(df, day, n) -> DataFrame:
    """The last n days are the lockbox; ranks are taken on distinct days only."""
    last = df.select(day).distinct().orderBy(F.desc(day)).limit(n).agg(F.min(day).alias("_from"))
    # one row by construction
    return df.join(F.broadcast(last)).withColumn(
        "split", F.when(F.col(day) >= F.col("_from"), "lockbox").otherwise("design")
    ).drop("_from")


def threshold_calibrate(df, fold, day, score, rate, windows=None) -> DataFrame:
    """Threshold per fold from its calibration rows; see ``nth_threshold``."""
    from .selection import nth_threshold

    rows = df if windows is None else df.join(windows, day)
    totals = rows.groupBy(fold).agg(F.countDistinct(day).alias("total_days"))
    return nth_threshold(rows.filter(F.col(score).isNotNull()), [fold], day, score, rate, totals)


def threshold_drift(thresholds, value="threshold", events="events") -> DataFrame:
    """Spread of fold thresholds (a row a fold) and their rank correlation with event counts."""
    t = average_ranks(calendar_rows(thresholds, []), [], {"_a": value, "_b": events}, bound=CALENDAR)
    s = t.agg(
        _count().alias("scored_folds"), F.count(F.when(F.col(events) == 0, 1)).alias("zero_folds"),
        F.min(value).alias("threshold_min"), F.max(value).alias("threshold_max"), F.stddev_pop(value).alias("threshold_std"),
        F.covar_pop("_a", "_b").alias("_c"), F.stddev_pop("_a").alias("_x"), F.stddev_pop("_b").alias("_y"),
    )
    return s.withColumn("event_spearman", ratio("_c", F.col("_x") * F.col("_y"))).drop("_c", "_x", "_y")


def promotion_gate(metrics, checks: Gates) -> DataFrame:
    """Named checks as rows plus the overall verdict; a missing metric fails."""
    items = [F.struct(F.lit(n).alias("check_name"), gate_column(g).alias("passed")) for n, g in checks.items()]
    wide = metrics.withColumn("_c", F.array(*items))
    bad = F.filter("_c", lambda x: ~x["passed"])
    keep = [c for c in metrics.columns]
    return wide.select(
        *keep, (F.size(bad) == 0).alias("promoted"), F.array_join(F.transform(bad, lambda x: x["check_name"]), "|").alias("failed_checks"), F.inline("_c")
    )


def selected_contract_check(df, day, code, slot, legal_slots, daily_max, complete: Column) -> DataFrame:
    """Violation counts of the selection contract, one row per rule."""
    stock_days = df.groupBy(day, code).agg(_count().alias("_n"))
    days = stock_days.groupBy(day).agg(F.sum("_n").alias("_d"), F.sum((F.col("_n") > 1).cast("int")).alias("_rep"))
    a = days.agg(
        F.coalesce(F.sum("_rep"), F.lit(0)).alias("repeated_stock_day"), F.count(F.when(F.col("_d") > daily_max, 1)).alias("over_daily_max")
    ).select(F.expr("stack(2, 'repeated_stock_day', repeated_stock_day, 'over_daily_max', over_daily_max) as (rule, violations)"))
    b = df.agg(
        F.count(F.when(~holds(F.col(slot).isin(*legal_slots)), 1)).alias("illegal_slot"), F.count(F.when(~holds(complete), 1)).alias("incomplete")
    ).select(F.expr("stack(2, 'illegal_slot', illegal_slot, 'incomplete', incomplete) as (rule, violations)"))
    return a.unionByName(b)


def day_status_fill(cands, calendar, day) -> DataFrame:
    """Every calendar day with its candidate count and status."""
    n = cands.groupBy(day).agg(_count().alias("candidates"))
    out = calendar.select(day).distinct().join(n, day, "left").na.fill(0, ["candidates"])
    return out.withColumn("status", F.when(F.col("candidates") > 0, "QUALIFIED").otherwise("NO_SIGNAL"))


