"""Model jobs on Spark ML: blended fits, calibration, pairwise ranks, walk-forward."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clip
from . import fits
from .joins import bounded_array
from .selection import union_families
from .spread import rank_sum

TREE_SHARE = 0.70  # fixed value: weight of the tree in every blend


def _vectors(features, out="_x"):
    """Median-impute, assemble and scale."""
    filled = [f"_f_{f}" for f in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol=out, withMean=True),
    ]


@dataclass
class Blend:
    """Fitted preparation, tree and linear model with their mixing share."""

    prepare: object
    tree: object
    linear: object
    probability: bool
    share: float = TREE_SHARE
    extra: list = field(default_factory=list)

    def score(self, df: DataFrame, out: str) -> DataFrame:
        ready = self.prepare.transform(df)
        cols = df.columns
        both = self.tree.setPredictionCol("_tp").transform(ready)
        if self.probability:
            both = both.withColumn("_a", vector_to_array("_tprob")[1]).drop("_tp")
            both = self.linear.transform(both).withColumn("_b", vector_to_array("_lprob")[1])
        else:
            both = self.linear.setPredictionCol("_lp").transform(both.withColumn("_a", F.col("_tp"))).withColumn("_b", F.col("_lp"))
        mixed = self.share * F.col("_a") + (1 - self.share) * F.col("_b")
        return both.select(*cols, mixed.alias(out), F.abs(F.col("_a") - F.col("_b")).alias(f"{out}_spread"))


def fit_logistic_blend(train, features, label, weight, iterations=10, depth=3, seed=7) -> Blend:
    """Boosted trees and logistic regression for a 0/1 target."""
    rows = train.filter(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    prepare = Pipeline(stages=_vectors(features)).fit(rows)
    ready = prepare.transform(rows).select("_x", "_y", weight).persist()
    tree = (
        GBTClassifier(featuresCol="_x", labelCol="_y", weightCol=weight, maxIter=iterations, maxDepth=depth, seed=seed)
        .setProbabilityCol("_tprob").setRawPredictionCol("_traw").fit(ready)
    )
    linear = LogisticRegression(
        featuresCol="_x", labelCol="_y", weightCol=weight, regParam=0.01, maxIter=25, probabilityCol="_lprob",
        rawPredictionCol="_lraw", predictionCol="_lpred",
    ).fit(ready)
    ready.unpersist()
    return Blend(prepare, tree, linear, True)


def fit_return_blend(train, features, target, weight, iterations=10, depth=3, seed=7) -> Blend:
    """Boosted trees and ridge regression for an expected return."""
    rows = train.filter(F.col(target).isNotNull()).withColumn("_y", F.col(target).cast("double"))
    prepare = Pipeline(stages=_vectors(features)).fit(rows)
    ready = prepare.transform(rows).select("_x", "_y", weight).persist()
    tree = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol=weight, maxIter=iterations, maxDepth=depth, seed=seed).fit(ready)
    linear = LinearRegression(featuresCol="_x", labelCol="_y", weightCol=weight, regParam=0.1, elasticNetParam=0.0).fit(ready)
    ready.unpersist()
    return Blend(prepare, tree, linear, False)


@dataclass
class Calibrator:
    """Maps a raw probability; a single-class fit is the constant class rate.

    Beta and Platt calibration are logistic in ``_calibration_terms``; an isotonic one has blocks.
    """

    method: str
    weights: list[float] | None = None
    blocks: DataFrame | None = None
    constant: float | None = None

    def score(self, df: DataFrame, p: str, out: str) -> DataFrame:
        if self.constant is not None:
            return df.withColumn(out, F.lit(self.constant))
        if self.method == "isotonic":
            return fits.isotonic_value(df.withColumn("_c", _clipped(p)), self.blocks, "_c", out).drop("_c")
        z = sum((t * F.lit(w) for t, w in zip(_calibration_terms(p, self.method), self.weights)), F.lit(0.0))
        return df.withColumn(out, 1 / (1 + F.exp(-z)))


def _clipped(p) -> Column:
    return F.least(F.greatest(F.col(p), F.lit(1e-4)), F.lit(1 - 1e-4))


def _calibration_terms(p, method) -> list[Column]:
    q = _clipped(p)
    return [F.ln(q), -F.ln(1 - q), F.lit(1.0)] if method == "beta" else [F.ln(q / (1 - q)), F.lit(1.0)]


def calibrate_probability(df, p, label, weight, method="beta") -> Calibrator:
    """Beta, Platt or isotonic calibration of a probability column.

    Beta and Platt are at the optimum of the weighted log loss, by Newton's method on sums;
    isotonic is exact, by pooling adjacent violators in range pieces. Rows without a label or a
    probability don't count.
    """
    rows = df.filter(F.col(label).isNotNull() & F.col(p).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    low, high, rate = rows.agg(F.min("_y"), F.max("_y"), F.sum(F.col("_y") * F.col(weight)) / F.sum(weight)).first()
    if low == high:
        return Calibrator(method, constant=rate)
    if method == "isotonic":
        return Calibrator(method, blocks=fits.isotonic_blocks(rows.withColumn("_c", _clipped(p)), "_c", "_y", weight))
    return Calibrator(method, fits.newton_logistic(rows, _calibration_terms(p, method), "_y", weight))


def pairwise_rank_fit(short, cs, features, target, l2=0.01, largest=64) -> dict[str, float]:
    """Coefficients of a no-intercept logistic model on the difference examples of a shortlist.

    Examples go both ways with weights of mean one (``fits.pairwise_examples``), but are only ever
    summed: ``fits.pairwise_newton`` works on one row a cross-section.
    """
    return fits.pairwise_newton(short, cs, features, target, l2, largest)


def pairwise_rank_score(df, cs, weights: dict[str, float], out="rank_score", largest=64) -> DataFrame:
    """Mean win probability of each row against its cross-section's others; alone: 0.5.

    Every row of ``df``, a shortlist (``topk_per_group``), gets a score. A cross-section of
    more than ``largest`` rows fails, so rivals are one small array per row and no pair table
    exists.
    """
    linear = sum((F.coalesce(F.col(f), F.lit(0.0)) * F.lit(w) for f, w in weights.items()), F.lit(0.0))
    rivals = df.withColumn("_s", linear).withColumn("_all", F.collect_list("_s").over(Window.partitionBy(*cs)))
    rivals = rivals.withColumn("_all", bounded_array(F.col("_all"), largest))
    # the row meets itself once with probability one half
    wins = F.aggregate("_all", F.lit(0.0), lambda acc, s: acc + 1 / (1 + F.exp(s - F.col("_s")))) - 0.5
    n = F.size("_all") - 1
    return rivals.withColumn(out, F.when(n > 0, wins / n).otherwise(0.5)).drop("_s", "_all")


def _row_quantile(values: list[Column], q: float) -> Column:
    """Linear quantile over a few columns of one row."""
    at = (len(values) - 1) * q
    lo = int(at)
    ordered = F.sort_array(F.array(*values))
    if lo + 1 >= len(values):
        return ordered[lo]
    return ordered[lo] + (ordered[lo + 1] - ordered[lo]) * (at - lo)


def _row_mean(values):
    return sum(values, F.lit(0.0)) / len(values)


def _row_spread(values):
    mean = _row_mean(values)
    return F.sqrt(_row_mean([(v - mean) * (v - mean) for v in values]))


COMBINED = [
    "p_entry", "p_exit", "p_round_trip", "p_positive", "p_severe", "expected_utility", "probability_spread", "fill_spread",
    "p_round_trip_lower", "p_positive_lower", "expected_utility_lower",
]


def ensemble_combine(df, members, cs, penalty=-10.0, adjustment=None, keep=None) -> DataFrame:
    """Combine member outputs into factorised probabilities, bounds, spreads and a rank score.

    Member ``m`` supplies entry_m, exit_m, pos_m, sev_m, csev_m, ret_m and rank_m. ``keep`` names
    the columns of ``df`` to return, all of them by default.
    """
    keep = list(df.columns if keep is None else keep)

    def each(name):
        return [F.col(f"{name}_{m}") for m in members]

    entry, leave, pos, sev, csev, ret, rank = (each(n) for n in ("entry", "exit", "pos", "sev", "csev", "ret", "rank"))
    trip = [a * b for a, b in zip(entry, leave)]
    prob = [t * p for t, p in zip(trip, pos)]
    stuck = [e * ((1 - x) + x * c) for e, x, c in zip(entry, leave, csev)]
    worst = [F.greatest(a, b) for a, b in zip(stuck, sev)]
    expected = [e * (x * r + (1 - x) * penalty) for e, x, r in zip(entry, leave, ret)]
    e, x, c = _row_mean(entry), _row_mean(leave), _row_mean(csev)
    df = df.withColumns(
        {
            "p_entry": e, "p_exit": x, "p_round_trip": e * x, "p_positive": e * x * _row_mean(pos),
            "p_severe": F.greatest(e * ((1 - x) + x * c), _row_mean(sev)), "expected_utility": _row_mean(expected),
            "probability_spread": _row_spread(prob), "fill_spread": _row_spread(trip),
            **{f"_e{i}": v for i, v in enumerate(expected)}, **{f"_w{i}": 1 - v for i, v in enumerate(worst)},
        }
    )
    low = F.lit(0.0) if adjustment is None else F.least(F.col(adjustment), F.lit(0.0))
    df = df.withColumns(
        {
            "p_round_trip_lower": F.least("p_round_trip", _row_quantile(trip, 0.1)),
            "p_positive_lower": F.least("p_positive", _row_quantile(prob, 0.1)),
            "expected_utility_lower": F.col("expected_utility") + low,
        }
    )
    # fixed values: weights of the five member ranks
    ranked = {}
    for i, m in enumerate(members):
        ranked |= {f"_e{i}": 0.35, f"ret_{m}": 0.25, f"pos_{m}": 0.20, f"rank_{m}": 0.15, f"_w{i}": 0.05}
    own = [*[c for c in keep if c not in COMBINED], *COMBINED]
    out = rank_sum(df, cs, ranked, "selection_score", own)
    return out.withColumn("selection_score", F.col("selection_score") / len(members))


# fixed values: weights, centres and limits of the economic score
SCORE_WEIGHTS = {
    "expected": 0.50, "p_positive": 1.25, "p_margin": 0.75, "p_severe": -1.00, "uncertainty": -0.20, "return_uncertainty": -0.05,
}


def economic_score(df, w=None, out="economic_score") -> DataFrame:
    """Linear score of expectation, probabilities, risk and model disagreement."""
    w = w or SCORE_WEIGHTS
    doubt = F.col("positive_spread") + 0.5 * F.col("margin_spread") + 0.5 * F.col("severe_spread")
    return df.withColumn(
        out,
        w["expected"] * clip("expected_net", -4.0, 4.0)
        + w["p_positive"] * (F.col("p_positive") - 0.50)
        + w["p_margin"] * (F.col("p_margin") - 0.35)
        + w["p_severe"] * F.col("p_severe")
        + w["uncertainty"] * doubt
        + w["return_uncertainty"] * clip("return_spread", 0.0, 6.0),
    )


def walk_forward_score(rows, folds: list[int], fit: Callable, score: Callable, fold="fold", role="role") -> DataFrame:
    """Fit on each fold's training rows, score its test rows, union all folds.

    The loop runs over the handful of folds; each fit is a distributed Spark ML job.
    """
    frames = []
    for f in folds:
        part = rows.filter(F.col(fold) == f)
        model = fit(part.filter(F.col(role) == "train"))
        frames.append(score(model, part.filter(F.col(role) == "test")))
    return union_families(frames)


def walk_forward_days(df, days, fit: Callable, score: Callable, day="day") -> DataFrame:
    """As ``walk_forward_score``, for rows that know their day only: no row is copied to the folds it serves.

    ``days`` are the collected rows of ``fold_days``: folds by calendar days, whatever the size of ``df``.
    """
    frames = []
    for f in sorted({r["fold"] for r in days}):
        train, test = (df.filter(F.col(day).isin([r[day] for r in days if r["fold"] == f and r["role"] == role])) for role in ("train", "test"))
        frames.append(score(fit(train), test).withColumn("fold", F.lit(f)))
    return union_families(frames)
