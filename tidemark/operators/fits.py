"""Deterministic fits from sums: logistic and pairwise models by Newton's method, isotonic blocks, fold-wise ridge.

What comes to the driver is a row of sums (the square of the number of coefficients) or one row
a fold segment or range piece, never rows of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch
from .joins import bounded_array, pairwise_self_join
from .spread import running


def _newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], dim: int, steps: int, tolerance: float) -> np.ndarray:
    """Minimise a convex loss from ``sums(beta)``: loss, gradient and Hessian at ``beta``.

    A step that raises the loss is halved until it doesn't.
    """
    beta = np.zeros(dim)
    loss, gradient, hessian = sums(beta)
    for _ in range(steps):
        if np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        for _ in range(30):
            there = sums(beta - step)
            if there[0] <= loss + 1e-15:
                break
            step = step / 2
        else:
            break
        beta = beta - step
        loss, gradient, hessian = there
    return beta


def _square(flat: list[float], dim: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle, row by row."""
    out = np.zeros((dim, dim))
    out[np.triu_indices(dim)] = flat
    return out + np.triu(out, 1).T


def newton_logistic(df, features: list[Column], label: str, weight: str | None = None, l2=0.0, steps=40, tolerance=1e-10) -> list[float]:
    """Coefficients of a logistic model for a 0/1 label, at the optimum of the weighted mean loss.

    Each step is one aggregate of loss, gradient and Hessian over built-in expressions; partial
    sums leave a task. A constant feature is the intercept. Rows with a null label don't count;
    other nulls must be filled. The penalty is ``l2 / 2`` times the squared coefficients.
    """
    names = [f"_x{k}" for k in range(len(features))]
    rows = df.filter(F.col(label).isNotNull()).select(
        *[x.cast("double").alias(n) for n, x in zip(names, features)], F.col(label).cast("double").alias("_y"),
        (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"),
    ).persist()

    def sums(beta: np.ndarray):
        z = sum((F.col(n) * F.lit(float(b)) for n, b in zip(names, beta)), F.lit(0.0))
        rest = F.exp(-F.abs(z))
        p = F.when(z >= 0, 1 / (1 + rest)).otherwise(rest / (1 + rest))
        loss = F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(rest)
        w, d = F.col("_w"), len(names)
        row = rows.withColumns({"_p": p, "_l": loss}).agg(
            F.sum(w), F.sum(w * F.col("_l")), *[F.sum(w * (F.col("_p") - F.col("_y")) * F.col(n)) for n in names],
            *[F.sum(w * F.col("_p") * (1 - F.col("_p")) * F.col(names[i]) * F.col(names[j])) for i in range(d) for j in range(i, d)],
        ).first()
        total, loss, flat = row[0] or 1.0, row[1] or 0.0, [x or 0.0 for x in row[2:]]
        return (
            loss / total + l2 / 2 * float(beta @ beta), np.array(flat[:d]) / total + l2 * beta, _square(flat[d:], d) / total + l2 * np.eye(d),
        )

    try:
        return [float(b) for b in _newton(sums, len(names), steps, tolerance)]
    finally:
        rows.unpersist()


# -- pairwise ranks --------------------------------------------------------------------------------


def pairwise_examples(df, cs, key, features, target, largest=64) -> DataFrame:
    """Difference examples of each cross-section in both directions, with weights of mean one.

    As ``pairwise_self_join``, but a pair gives two examples, the second with the first's signs and
    label turned round, and weights are divided by their mean over all examples.
    """
    one = pairwise_self_join(df, cs, key, features, target, largest)
    both = F.array(
        F.struct(*[F.col(f"{c}_a") for c in key], *[F.col(f"{c}_b") for c in key], *features, "label"),
        F.struct(*[F.col(f"{c}_b").alias(f"{c}_a") for c in key], *[F.col(f"{c}_a").alias(f"{c}_b") for c in key], *[(-F.col(f)).alias(f) for f in features], (1 - F.col("label")).alias("label")),
    )
    mean = one.agg(F.avg("weight").alias("_mean"))
    return one.select(*cs, F.explode(both).alias("_e"), "weight").crossJoin(F.broadcast(mean)).select(*cs, "_e.*", (F.col("weight") / F.col("_mean")).alias("weight"))


def _packed(df, cs, features, target, largest) -> DataFrame:
    """One row per cross-section: its labelled rows' features, flattened, and targets."""
    rows = df.filter(F.col(target).isNotNull())
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    packed = rows.groupBy(*cs).agg(F.sort_array(F.collect_list(F.struct(F.col(target).cast("double").alias("y"), x.alias("x")))).alias("m"))
    return packed.select(bounded_array(F.col("m"), largest).alias("m")).select(F.transform("m", lambda r: r["y"]).alias("y"), F.flatten(F.transform("m", lambda r: r["x"])).alias("x"))


def _pair_sums(packed: DataFrame, dim: int, beta: np.ndarray) -> np.ndarray:
    """Weight, loss, gradient and Hessian over all pairs of all cross-sections, both directions."""
    width = 2 + dim + dim * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for ys, xs in zip(batch.column("y"), batch.column("x")):
                y, x = np.array(ys.as_py()), np.array(xs.as_py(), float).reshape(-1, dim)
                i, j = np.triu_indices(len(y), 1)
                apart = ~(np.abs(y[i] - y[j]) <= 1e-8 + 1e-5 * np.abs(y[j]))
                if not apart.any():
                    continue
                w = 1.0 / (len(y) * (len(y) - 1))
                d = x[i[apart]] - x[j[apart]]
                wins, z = (y[i] > y[j])[apart], d @ beta
                rest = np.exp(-np.abs(z))
                p = np.where(z >= 0, 1 / (1 + rest), rest / (1 + rest))
                # the turned example has the same loss, gradient and Hessian
                total[0] += 2 * w * len(d)
                total[1] += 2 * w * (np.maximum(z, 0) - z * wins + np.log1p(rest)).sum()
                total[2 : 2 + dim] += 2 * w * ((p - wins) @ d)
                total[2 + dim :] += 2 * w * ((d * (p * (1 - p))[:, None]).T @ d).ravel()
        yield pa.RecordBatch.from_pydict({f"s{k}": [v] for k, v in enumerate(total)})

    names = [f"s{k}" for k in range(width)]
    row = packed.mapInArrow(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n) for n in names]).first()
    return np.array([x or 0.0 for x in row])


def pairwise_newton(df, cs, features, target, l2=0.01, largest=64, steps=40, tolerance=1e-10) -> dict[str, float]:
    """Coefficients of the no-intercept logistic model on difference examples, at its optimum.

    Pairs are never rows: a cross-section (at most ``largest`` labelled rows, or the query fails)
    is one row with arrays, and a step sums its pairs' gradient and Hessian, each pair in both
    directions with the cross-section's weight. ``l2 / 2`` times the squared coefficients is added
    to the weighted mean loss.
    """
    packed = _packed(df, cs, features, target, largest).persist()
    dim = len(features)

    def sums(beta: np.ndarray):
        s = _pair_sums(packed, dim, beta)
        total = s[0] or 1.0
        return s[1] / total + l2 / 2 * float(beta @ beta), s[2 : 2 + dim] / total + l2 * beta, s[2 + dim :].reshape(dim, dim) / total + l2 * np.eye(dim)

    try:
        return dict(zip(features, map(float, _newton(sums, dim, steps, tolerance))))
    finally:
        packed.unpersist()


def pair_calibration(df, cs, features, target, weights: dict[str, float], largest=64) -> tuple[float, float]:
    """Platt slope and intercept of the pair probabilities that ``weights`` give, on other cross-sections.

    Both directions are examples, so the intercept is zero but for rounding; it is kept for models
    that were not fitted symmetrically.
    """
    score = sum((F.coalesce(F.col(f), F.lit(0.0)) * F.lit(weights[f]) for f in features), F.lit(0.0))
    pairs = pairwise_examples(df.select(*cs, target, score.alias("_s")), cs, [], ["_s"], target, largest)
    a, b = newton_logistic(pairs, [F.col("_s"), F.lit(1.0)], "label", "weight")
    return a, b


def pairwise_calibrated_score(df, cs, weights: dict[str, float], calibration: tuple[float, float], out="rank_score", largest=64) -> DataFrame:
    """Mean calibrated two-sided win probability of each row against its cross-section's others; alone: 0.5.

    A pair's probability is the mean of what the calibration says of the row against its rival and
    of one minus what it says of the rival against the row.
    """
    linear = sum((F.coalesce(F.col(f), F.lit(0.0)) * F.lit(w) for f, w in weights.items()), F.lit(0.0))
    packed = df.withColumn("_s", linear).groupBy(*cs).agg(F.collect_list(F.struct(F.struct(*df.columns).alias("r"), "_s")).alias("_m"))
    packed = packed.select(bounded_array(F.col("_m"), largest).alias("_m"))
    a, b = calibration
    said = lambda z: 1 / (1 + F.exp(-(z * a + b)))
    rows = packed.select(F.size("_m").alias("_n"), F.transform("_m", lambda x: x["_s"]).alias("_all"), F.explode("_m").alias("_x"))
    rows = rows.select("_n", "_all", F.col("_x.r").alias("_r"), F.col("_x._s").alias("_s"))
    won = F.aggregate("_all", F.lit(0.0), lambda acc, s: acc + (said(F.col("_s") - s) + 1 - said(s - F.col("_s"))) / 2) - 0.5
    return rows.select("_r.*", F.when(F.col("_n") > 1, won / (F.col("_n") - 1)).otherwise(0.5).alias(out))


# -- calibration -----------------------------------------------------------------------------------


def pool_violators(blocks: Iterator[tuple], stack: list[list] | None = None) -> list[list]:
    """Adjacent blocks ``(low, high, weight, weighted sum)`` in order, pooled until their means ascend.

    A stack of pooled blocks takes one more at a time, so stacks of neighbouring pieces merge by
    pushing the right one's blocks onto the left one.
    """
    stack = [] if stack is None else stack
    for block in blocks:
        now = list(block)
        while stack and stack[-1][3] * now[2] >= now[3] * stack[-1][2]:
            low, _, w, s = stack.pop()
            now = [low, now[1], w + now[2], s + now[3]]
        stack.append(now)
    return stack


def isotonic_blocks(df, x: str, y: str, weight: str | None = None, piece_blocks=500_000) -> DataFrame:
    """The weighted isotonic regression of ``y`` on ``x`` as its blocks: ``low, high, weight, value``.

    Rows with equal ``x`` are summed first. Range pieces of ``x`` are pooled each in its task; what
    is left (few blocks, unless the data already ascend) is cut into new pieces and pooled again
    until no two neighbouring pieces violate the order, so no piece has more than about
    ``piece_blocks`` blocks and the result is the same however it was cut.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).where("w > 0 AND NOT isnan(x)")
    blocks = rows.groupBy("x").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("y")).alias("total")).select(F.col("x").alias("low"), F.col("x").alias("high"), "weight", "total")
    spark = df.sparkSession
    schema = "low double, high double, weight double, total double"
    pieces = None
    for turn in range(1000):
        dealt = blocks.repartitionByRange(*([pieces] if pieces else []), "low").sortWithinPartitions("low")
        path = scratch(spark)
        dealt.mapInArrow(_pool_piece, f"{schema}, piece int").write.parquet(path)
        pooled = spark.read.schema(f"{schema}, piece int").parquet(path)
        ends = pooled.groupBy("piece").agg(F.min("low").alias("low"), F.min_by(F.struct("weight", "total"), "low").alias("first"), F.max_by(F.struct("weight", "total"), "low").alias("last"), F.count("*").alias("n"))
        ends = ends.orderBy("low").collect()  # a row a piece
        broken = any(a.last.total * b.first.weight >= b.first.total * a.last.weight for a, b in zip(ends, ends[1:]))
        blocks = pooled.drop("piece")
        if not broken:
            break
        # another number of pieces moves the cuts; it shrinks with the blocks
        pieces = max(1, -(-sum(e.n for e in ends) // piece_blocks)) + (turn % 2 if sum(e.n for e in ends) > piece_blocks else 0)
    else:
        raise RuntimeError("isotonic pieces did not settle")
    return blocks.select("low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def _pool_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack: list[list] = []
    for batch in batches:
        pool_violators(zip(*[batch.column(c).to_pylist() for c in ("low", "high", "weight", "total")]), stack)
    if stack:
        columns = dict(zip(("low", "high", "weight", "total"), map(list, zip(*stack))))
        yield pa.RecordBatch.from_pydict(columns | {"piece": pa.array([TaskContext.get().partitionId()] * len(stack), pa.int32())})


def isotonic_value(df, blocks: DataFrame, x: str, out: str) -> DataFrame:
    """Values of a fit at ``x``: a block's value inside it, a straight line between blocks, the end values outside.

    Ends of blocks are stacked with the rows, and the nearest ones on either side carried along,
    over range pieces where there are many, so neither side is collected or broadcast.
    """
    ends = [F.struct(F.col(c).alias("at"), F.col("value").alias("v")) for c in ("low", "high")]
    knots = blocks.select(F.explode(F.array(*ends)).alias("_knot")).distinct().select(F.lit(0).alias("_all"), F.col("_knot.at").alias("_at"), F.lit(0).alias("_kind"), "_knot")
    rows = df.select(F.lit(0).alias("_all"), F.col(x).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.struct(*df.columns).alias("_row"))
    both = knots.unionByName(rows, allowMissingColumns=True)
    for name, order in (("_below", F.col("_at").asc()), ("_above", F.col("_at").desc())):
        both = running(both, ["_all"], [order, F.col("_kind")], {name: ("last", F.col("_knot"))})
    a, b, at = F.col("_below"), F.col("_above"), F.col("_at")
    line = a["v"] + (b["v"] - a["v"]) * F.coalesce(F.try_divide(at - a["at"], b["at"] - a["at"]), F.lit(0.0))
    value = F.when(at.isNotNull(), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line))
    return both.where("_kind = 1").select("_row.*", value.alias(out))


# -- ridge over folds ------------------------------------------------------------------------------


@dataclass
class Gram:
    """Sums of products of ``(1, features, missing flags, target)`` for each segment of days."""

    features: list[str]
    sums: dict[int, np.ndarray]

    def of(self, segments: list[int]) -> np.ndarray:
        dim = 2 + 2 * len(self.features)
        return sum((self.sums[s] for s in segments if s in self.sums), np.zeros((dim, dim)))


def gram_by_segment(df, features, target, segment: str, weight: str | None = None) -> Gram:
    """All products' weighted sums per segment, in one aggregate over one scan."""
    z = {"_one": F.lit(1.0)}
    z |= {f"_x{k}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for k, f in enumerate(features)}
    z |= {f"_m{k}": F.col(f).isNull().cast("double") for k, f in enumerate(features)}
    z["_y"] = F.col(target).cast("double")
    names, w = list(z), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.filter(F.col(target).isNotNull() & F.col(segment).isNotNull()).select(segment, *[c.alias(n) for n, c in z.items()], w.alias("_w"))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(segment).agg(*[F.sum(F.col("_w") * F.col(names[i]) * F.col(names[j])).alias(f"g{k}") for k, (i, j) in enumerate(pairs)])
    return Gram(list(features), {r[0]: _square([float(v) for v in r[1:]], len(names)) for r in sums.collect()})


def ridge_from_gram(gram: np.ndarray, features: list[str], l2: float) -> dict[str, float]:
    """Ridge on standardised features, missing ones at their mean: ``{"": intercept, feature: slope, "feature mean": mean}``.

    The mean of a feature over its present rows follows from the sums, and so does the matrix with
    it put in for missing ones. A feature without spread gets no slope.
    """
    d = len(features)
    n = gram[0, 0]
    out = {"": 0.0}
    if n <= 0:
        return out | {f: 0.0 for f in features} | {f"{f} mean": 0.0 for f in features}
    present = n - gram[0, 1 + d : 1 + 2 * d]
    mean = np.where(present > 0, gram[0, 1 : 1 + d] / np.where(present > 0, present, 1), 0.0)
    turn = np.zeros((d + 2, 2 * d + 2))
    turn[0, 0] = turn[d + 1, 2 * d + 1] = 1
    for k in range(d):
        turn[1 + k, 1 + k], turn[1 + k, 1 + d + k] = 1, mean[k]
    full = turn @ gram @ turn.T / n
    at, y = full[0, 1 : d + 1], full[0, d + 1]
    cov, cross = full[1 : d + 1, 1 : d + 1] - np.outer(at, at), full[1 : d + 1, d + 1] - at * y
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    used = spread > 1e-12 * np.maximum(1, np.abs(at))
    slope = np.zeros(d)
    if used.any():
        s = spread[used]
        slope[used] = np.linalg.solve(cov[np.ix_(used, used)] / np.outer(s, s) + l2 * np.eye(used.sum()), cross[used] / s) / s
    out[""] = float(y - slope @ at)
    return out | {f: float(b) for f, b in zip(features, slope)} | {f"{f} mean": float(m) for f, m in zip(features, mean)}


def walk_forward_ridge(df, calendar, folds, plan, features, target, l2=0.1, out="e_net", day="day", weight=None) -> DataFrame:
    """Each fold's test rows scored by a ridge model of its training days.

    Fold bounds cut the calendar into segments. One scan sums the products of each segment; a
    fold's training statistics are the sum over its segments, solved on the driver, so training
    rows are read once however many folds they train. A second scan scores the test rows.
    """
    bounds = folds.select("fold", "train_lo", "cal_lo", "test_lo", "test_hi").orderBy("fold").collect()  # a row a fold
    cuts = sorted({v for b in bounds for v in (b.train_lo, b.cal_lo - plan.purge, b.test_lo, b.test_hi + 1)})
    number = sum(((F.col("idx") >= c).cast("int") for c in cuts), F.lit(0)).alias("_segment")
    days = calendar.select(F.col(day).alias("_d"), "idx").select("_d", number)
    rows = df.join(days, df[day] == days["_d"]).drop("_d")
    gram = gram_by_segment(rows, features, target, "_segment", weight)
    place = {c: k + 1 for k, c in enumerate(cuts)}
    models = []
    for b in bounds:
        got = ridge_from_gram(gram.of(list(range(place[b.train_lo], place[b.cal_lo - plan.purge]))), features, l2)
        models += [(b.fold, s, got[""], [got[f] for f in features], [got[f"{f} mean"] for f in features]) for s in range(place[b.test_lo], place[b.test_hi + 1])]
    told = df.sparkSession.createDataFrame(models, "fold int, _segment int, _a double, _b array<double>, _m array<double>")
    scored = rows.join(F.broadcast(told), "_segment")  # a row a fold and segment
    value = sum((F.coalesce(F.col(f).cast("double"), F.col("_m")[k]) * F.col("_b")[k] for k, f in enumerate(features)), F.col("_a"))
    return scored.select("fold", *df.columns, value.alias(out))
