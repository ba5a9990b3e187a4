"""Fits from sums equal brute force, at optima that can be checked."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fits, folds, models


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, z = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(rng.random() < 1 / (1 + math.exp(-(0.7 * x - 1.2 * z + 0.3))))
        out.append((k, x, z, y, rng.uniform(0.5, 2)))
    return out


def test_newton_reaches_the_optimum(spark):
    data = rows(400)
    df = spark.createDataFrame(data, "k int, x double, z double, y int, w double").repartition(3)
    got = np.array(fits.newton_logistic(df, [F.col("x"), F.col("z"), F.lit(1.0)], "y", "w", l2=0.01))
    a = np.array([[x, z, 1.0] for _, x, z, _, _ in data])
    y, w = np.array([r[3] for r in data]), np.array([r[4] for r in data])
    gradient = a.T @ (w * (1 / (1 + np.exp(-a @ got)) - y)) / w.sum() + 0.01 * got
    assert np.abs(gradient).max() < 1e-8
    # separable data stay finite with a penalty, and no rows give zeros
    apart = spark.createDataFrame([(x, int(x > 0)) for x in (-2.0, -1.0, 1.0, 2.0)], "x double, y int")
    assert 0 < fits.newton_logistic(apart, [F.col("x")], "y", l2=0.1)[0] < 100
    assert fits.newton_logistic(df.limit(0), [F.col("x")], "y") == [0.0]


def test_pairwise_newton_has_no_gradient_left(spark):
    rng = random.Random(3)
    data = [(d, rng.gauss(0, 1), rng.gauss(0, 1), rng.choice((None, rng.gauss(0, 1), 1.0))) for d in range(30) for _ in range(rng.randint(1, 9))]
    df = spark.createDataFrame(data, "d int, a double, b double, net double").repartition(4)
    got = fits.pairwise_newton(df, ["d"], ["a", "b"], "net", l2=0.05)
    beta = np.array([got["a"], got["b"]])
    gradient, total = np.zeros(2), 0.0
    for d in range(30):
        own = [r for r in data if r[0] == d and r[3] is not None]
        for p in own:
            for q in own:
                if p is not q and not np.isclose(p[3], q[3]):
                    x, w = np.array([p[1] - q[1], p[2] - q[2]]), 1 / (len(own) * (len(own) - 1))
                    gradient += w * (1 / (1 + math.exp(-x @ beta)) - (p[3] > q[3])) * x
                    total += w
    assert np.abs(gradient / total + 0.05 * beta).max() < 1e-8
    made = fits.pairwise_examples(df, ["d"], [], ["a", "b"], "net")
    assert made.agg(F.avg("weight")).first()[0] == pytest.approx(1) and made.agg(F.sum("a"), F.avg("label")).first() == pytest.approx((0, 0.5), abs=1e-9)
    with pytest.raises(Exception, match="more rows than declared"):
        fits.pairwise_newton(df, ["d"], ["a"], "net", largest=3)


def plain_isotonic(data):
    """Largest over starts of the smallest over ends of the mean between."""
    xs = sorted({x for x, _, _ in data})
    w = [sum(v for x, _, v in data if x == at) for at in xs]
    s = [sum(y * v for x, y, v in data if x == at) for at in xs]
    return {xs[i]: max(min(sum(s[a : c + 1]) / sum(w[a : c + 1]) for c in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))}


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "dip"])
def test_isotonic_pieces_merge_to_the_whole_fit(spark, kind):
    rng = random.Random(5)
    shape = {"noise": lambda k: rng.random() + k / 200, "rising": lambda k: k, "falling": lambda k: -k, "dip": lambda k: k if k < 55 else 20}[kind]
    data = [(float(rng.randint(0, 40) if kind == "noise" else k), float(shape(k)), rng.choice((1.0, 2.0, 50.0 if kind == "dip" else 0.5))) for k in range(60)]
    df = spark.createDataFrame([*data, (None, 1.0, 1.0), (3.0, None, 1.0), (4.0, 9.0, 0.0)], "x double, y double, w double").repartition(3)
    want = plain_isotonic(data)
    blocks = fits.isotonic_blocks(df, "x", "y", "w", piece_blocks=7)
    got = {r.x: r.v for r in fits.isotonic_value(spark.createDataFrame([(x,) for x in want], "x double"), blocks, "x", "v").collect()}
    assert got == pytest.approx(want)
    values = [r.value for r in blocks.orderBy("low").collect()]
    assert all(a < b for a, b in zip(values, values[1:]))
    ends = fits.isotonic_value(spark.createDataFrame([(-9.0,), (99.0,), (None,)], "x double"), blocks, "x", "v").collect()
    assert {r.x: r.v for r in ends} == {-9.0: pytest.approx(min(want.values())), 99.0: pytest.approx(max(want.values())), None: None}


def test_calibration_of_one_class_is_its_rate(spark):
    df = spark.createDataFrame([(0.2, 1, 1.0), (0.7, 1, 2.0), (0.4, None, 1.0)], "p double, y int, w double")
    for method in ("beta", "platt", "isotonic"):
        out = models.calibrate_probability(df, "p", "y", "w", method).score(df, "p", "c")
        assert {r.c for r in out.collect()} == {1.0}


def test_ridge_of_each_fold_equals_a_refit(spark):
    rng = random.Random(8)
    plan = folds.FoldPlan(min_train=6, calibration=2, purge=1, test=3, max_window=9)
    calendar = spark.createDataFrame([(d, d) for d in range(25)], "day int, idx int")
    data = [(d, k, rng.choice((None, rng.gauss(0, 1))), rng.gauss(1, 3), 4.0, rng.choice((None, rng.gauss(0, 1)))) for d in range(25) for k in range(6)]
    df = spark.createDataFrame(data, "day int, k int, a double, b double, flat double, y double")
    told = folds.walk_forward_folds(calendar, plan)
    got = {(r.fold, r.day, r.k): r.e for r in fits.walk_forward_ridge(df, calendar, told, plan, ["a", "b", "flat"], "y", l2=0.3, out="e").collect()}
    want = {}
    for f in told.collect():
        train = [r for r in data if f.train_lo <= r[0] <= f.cal_lo - plan.purge - 1 and r[5] is not None]
        mean = [np.mean([r[c] for r in train if r[c] is not None]) for c in (2, 3, 4)]
        fill = lambda r: np.array([r[c] if r[c] is not None else m for c, m in zip((2, 3, 4), mean)])  # noqa: E731, B023
        x, y = np.array([fill(r) for r in train]), np.array([r[5] for r in train])
        at, spread = x.mean(0), x.std(0)
        z = ((x - at) / np.where(spread > 0, spread, 1))[:, :2]
        beta = np.linalg.solve(z.T @ z / len(y) + 0.3 * np.eye(2), z.T @ (y - y.mean()) / len(y))
        for r in data:
            if f.test_lo <= r[0] <= f.test_hi:
                want[f.fold, r[0], r[1]] = y.mean() + ((fill(r) - at)[:2] / spread[:2]) @ beta
    assert got == pytest.approx(want)
