"""Pareto fronts and interval look-ups against trying everything."""

import datetime as dt
import random

import pytest

from tidemark.operators import joins, selection


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("kind", ["grid", "front", "wide"])
def test_pareto(spark, dims, kind, monkeypatch):
    monkeypatch.setattr(selection, "_PRUNERS", 2)
    rng = random.Random(dims)
    make = {
        "grid": lambda: [float(rng.randint(0, 4)) for _ in range(3)],
        "front": lambda: (lambda x, y: [x, y, -x - y])(rng.uniform(-1, 1), rng.uniform(-1, 1)),
        "wide": lambda: [rng.choice((None, -0.0, 0.0, float("inf"), rng.gauss(0, 1e6), 10 ** rng.uniform(-20, 20))) for _ in range(3)],
    }[kind]
    rows = [(k, *make()) for k in range(90)]
    names = ["a", "b", "c"][:dims]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(3)
    got = {r.k: r.efficient for r in selection.pareto_mask(df, names).collect()}
    low = [(r[0], [float("-inf") if x is None else x for x in r[1 : 1 + dims]]) for r in rows]
    want = {k: not any(all(p >= q for p, q in zip(o, v)) and any(p > q for p, q in zip(o, v)) for _, o in low) for k, v in low}
    assert got == want
    assert selection.pareto_mask(df.limit(0), names).count() == 0
    with pytest.raises(ValueError):
        selection.pareto_mask(df, ["a"] * 4)


@pytest.mark.parametrize("inclusive", [False, True])
def test_interval_lookup(spark, inclusive):
    rng = random.Random(7)
    day = lambda k: dt.date(1968, 1, 1) + dt.timedelta(days=k)
    right = []
    for k in range(120):
        a = rng.randint(0, 1500)
        right.append((rng.choice("xy"), day(a), None if rng.random() < 0.1 else day(a + rng.choice((-1, 0, 1, 2, 7, 300, 4000))), k))
    left = [(rng.choice("xyz"), day(rng.randint(-5, 3000)), k) for k in range(400)]
    got = joins.asof_join_interval(
        spark.createDataFrame(left, "code string, day date, n int").repartition(3), spark.createDataFrame(right, "code string, lo date, hi date, v int"),
        ["code"], "day", "lo", "hi", ["v"], ["code", "n"], end_inclusive=inclusive,
    )
    out = {r.n: (r.active_from, r.v) for r in got.collect()}
    for c, d, n in left:
        live = [(a, v) for g, a, b, v in right if g == c and a <= d and (b is None or (b >= a and (b >= d if inclusive else b > d)))]
        first = max((a for a, _ in live), default=None)
        assert out[n][0] == first and (first is None or (first, out[n][1]) in live)
