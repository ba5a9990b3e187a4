"""Walk-forward folds, segments, sample weights and feature screens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from .spread import group_table


@dataclass(frozen=True)
class FoldPlan:
    """Day counts of a walk-forward schedule."""

    min_train: int = 252
    calibration: int = 42
    purge: int = 2
    test: int = 42
    max_window: int = 504


def walk_forward_folds(calendar, plan: FoldPlan, day="day") -> DataFrame:
    """One row per fold with the bounds of its training and test days.

    ``calendar`` has one row per open day with a dense ``idx``.
    """
    first = plan.min_train + plan.calibration + 2 * plan.purge
    kept = plan.max_window + plan.calibration + plan.purge
    n = calendar.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= first + plan.test)
    starts = n.select("_n", F.posexplode(F.sequence(F.lit(first), F.col("_n") - 1, F.lit(plan.test))).alias("_f", "_s"))
    end = F.col("_s") - plan.purge
    bounds = starts.select(
        (F.col("_f") + 1).alias("fold"),
        F.greatest(end - kept, F.lit(0)).alias("train_lo"), (end - 1).alias("train_hi"),
        (end - plan.calibration).alias("cal_lo"),
        F.col("_s").alias("test_lo"), (F.least(F.col("_s") + plan.test, F.col("_n")) - 1).alias("test_hi"),
    )
    for name in ("train_lo", "train_hi", "test_lo", "test_hi"):
        at = calendar.select(F.col("idx").alias(name), F.col(day).alias(f"{name}_day"))
        bounds = bounds.join(at, name)
    return bounds.select(
        "fold", "train_lo", "train_hi", "cal_lo", "test_lo", "test_hi",
        F.col("train_lo_day").alias("train_start"), F.col("train_hi_day").alias("train_end"),
        F.col("test_lo_day").alias("test_start"), F.col("test_hi_day").alias("test_end"),
    )


def fold_days(calendar, folds, plan: FoldPlan, day="day") -> DataFrame:
    """(fold, role, day): bounded by folds x calendar days, so rows join it on the day."""
    spans = F.array(
        F.struct(F.lit("train").alias("role"), F.sequence("train_lo", F.col("cal_lo") - plan.purge - 1).alias("_i")),
        F.struct(F.lit("calibration").alias("role"), F.sequence("cal_lo", "train_hi").alias("_i")),
        F.struct(F.lit("test").alias("role"), F.sequence("test_lo", "test_hi").alias("_i")),
    )
    flat = folds.select("fold", F.inline(spans)).select("fold", "role", F.explode("_i").alias("idx"))
    return flat.join(calendar.select("idx", day), "idx").select("fold", "role", day)


def assign_fold_rows(df, calendar, folds, plan: FoldPlan, day="day") -> DataFrame:
    return df.join(fold_days(calendar, folds, plan, day), day)


def rolling_segments(calendar, design, purge, confirmation, final_purge=0, day="day") -> DataFrame:
    """Last days split into design, purge and confirmation; empty when too short."""
    need = design + purge + confirmation + final_purge
    n = calendar.agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= need)
    base = F.col("_n") - need
    parts = [("design", 0, design), ("purge", design, purge), ("confirmation", design + purge, confirmation), ("final_purge", design + purge + confirmation, final_purge)]
    spans = F.array(*[
        F.struct(F.lit(r).alias("role"), (base + lo).alias("_lo"), (base + lo + size - 1).alias("_hi"), F.lit(size).alias("days"))
        for r, lo, size in parts if size
    ])
    t = n.select(F.inline(spans))
    for side in ("_lo", "_hi"):
        t = t.join(calendar.select(F.col("idx").alias(side), F.col(day).alias(f"{side}_day")), side)
    return t.select("role", F.col("_lo_day").alias("start"), F.col("_hi_day").alias("end"), "days")


def temporal_weights(df, day, by, half_life, out="weight") -> DataFrame:
    """Half-life decay by day age, shared equally inside each group, mean one over rows.

    All sums come from one row per group, and the weights are joined back on the group.
    """
    keys = list(dict.fromkeys([day, *by]))
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    from pyspark.sql import Window

    # one row per day: bounded by the calendar
    days = groups.select(day).distinct().withColumn("_age", F.row_number().over(Window.orderBy(F.desc(day))) - 1)
    groups = groups.join(days, day)
    raw = F.pow(F.lit(0.5), F.col("_age") / F.lit(float(half_life))) / F.col("_size")
    groups = groups.withColumn("_w", raw)
    mean = groups.agg((F.sum(F.col("_w") * F.col("_size")) / F.sum("_size")).alias("_mean"))
    scaled = groups.join(F.broadcast(mean)).select(*keys, (F.col("_w") / F.greatest("_mean", F.lit(1e-12))).alias(out))
    return df.join(scaled, keys)


def balanced_class_weights(df, label, weight, out="balanced_weight") -> DataFrame:
    """Scale weights so both classes count half; a single class keeps its weights."""
    rate = df.agg(F.avg(F.col(label).cast("double")).alias("_rate"))
    r = F.col("_rate")
    factor = F.when((r > 0) & (r < 1), F.when(F.col(label).cast("int") == 1, 0.5 / r).otherwise(0.5 / (1 - r))).otherwise(1.0)
    return df.join(F.broadcast(rate)).withColumn(out, F.col(weight) * factor).drop("_rate")


def active_feature_screen(train, cal, features, min_rate=0.5) -> DataFrame:
    """Coverage of each feature in both windows and whether it varies; one scan each."""

    def rates(df, tag):
        stats = [
            F.struct(F.lit(f).alias("feature"), F.avg(F.col(f).isNotNull().cast("int")).alias(f"{tag}_rate"), (F.min(f) < F.max(f)).alias(f"{tag}_varies"))
            for f in features
        ]
        return df.agg(F.array(*stats).alias("_a")).select(F.inline("_a"))

    both = rates(train, "train").join(rates(cal, "cal"), "feature")
    ok = (F.col("train_rate") >= min_rate) & (F.col("cal_rate") >= min_rate) & F.coalesce(F.col("train_varies"), F.lit(False))
    return both.select("feature", "train_rate", "cal_rate", ok.alias("active"))


def median_impute_scale(df, fold, features, train=None) -> DataFrame:
    """Fill with the fold's median, then centre and scale by its population deviation.

    Statistics come from the rows where ``train`` holds; a constant feature scales by 1.
    """
    fit = df if train is None else df.filter(train)
    med = group_table(fit, [fold], {f"_m_{f}": ("quantile", f, 0.5) for f in features})
    filled = fit.join(med, fold).withColumns({f: F.coalesce(F.col(f), F.col(f"_m_{f}"), F.lit(0.0)) for f in features})
    stats = filled.groupBy(fold).agg(
        *[F.avg(f).alias(f"_a_{f}") for f in features], *[F.stddev_pop(f).alias(f"_s_{f}") for f in features]
    )
    out = df.join(med, fold).join(stats, fold)
    scaled = {
        f"{f}_scaled": ratio(
            F.coalesce(F.col(f), F.col(f"_m_{f}"), F.lit(0.0)) - F.col(f"_a_{f}"),
            F.when(F.col(f"_s_{f}") > 0, F.col(f"_s_{f}")).otherwise(1.0),
        )
        for f in features
    }
    return out.withColumns(scaled).drop(*[c for c in out.columns if c[:3] in ("_m_", "_a_", "_s_")])
