import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, x double, part string"


def plain(rows, entries=256, parts=4):
    """Brute force over (vec_id, embedding, label): every distance, Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = len(kept[0][1]) // parts
    cut = [[v[k * q : (k + 1) * q] for _, v, _ in kept] for k in range(parts)]
    books = [[list(p) for p in c[:entries]] for c in cut]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda k: [min(range(len(books[k])), key=lambda j: (gap(p, books[k][j]), j)) for p in cut[k]]
    for _ in range(4):
        for k in range(parts):
            found = nearest(k)
            for j in set(found):
                own = [p for p, f in zip(cut[k], found) if f == j]
                books[k][j] = [sum(c) // len(own) for c in zip(*own)]
    codes = list(zip(*[nearest(k) for k in range(parts)]))
    errors = [sum(gap(cut[k][r], books[k][j]) for k, j in enumerate(c)) for r, c in enumerate(codes)]
    by = {}
    for (_, _, g), e in zip(kept, errors):
        by[g] = by.get(g, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, "".join(f"{j:02x}" for j in c), e, by[g], sha) for (i, _, g), c, e in zip(kept, codes, errors)], key=str)


def vectors(n, dim=8, seed=3, centres=6):
    rng = random.Random(seed)
    mids = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    out = []
    for k in range(n):
        v = [np.float32(m + rng.gauss(0, 0.05)).item() for m in rng.choice(mids)]
        out.append((k, v, rng.choice((None, 1, 1, 1, 2))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", 0.5, "c") for r in rows], SCHEMA)


def result(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_odd_vectors(spark):
    rows = vectors(90)
    rows += [(200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 2), (203, [float("inf")] * 8, 2), (204, [0.0] * 8, None), (205, rows[3][1], 1)]
    rows += [rows[5], rows[5], (5, rows[9][1], 2), (None, rows[7][1], None)]
    got = codebooks.compress(frame(spark, rows).repartition(3))
    assert result(got) == plain(rows)
    # other lengths and huge components can't be coded
    odd = rows + [(300, [1.0] * 4, 1), (301, [1.0] * 7, 1), (302, [], 1), (303, [1e30] * 8, 1)]
    assert result(codebooks.compress(frame(spark, odd))) == plain(rows)
    assert codebooks.compress(frame(spark, rows).limit(0)).count() == 0
    assert codebooks.compress(frame(spark, [(1, None, 1)])).count() == 0


def test_more_vectors_than_entries(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 200)
    rows = vectors(700, dim=4, centres=40)
    assert result(codebooks.compress(frame(spark, rows).repartition(2), entries=20)) == plain(rows, entries=20)
    same = [(k, [0.25, -0.5, 0.125, 1.0], 1) for k in range(300)]
    got = result(codebooks.compress(frame(spark, same)))
    assert got == plain(same) and {r[1:3] for r in got} == {("00000000", 0)}


def test_walk_of_both_trees_finds_the_nearest():
    rng = np.random.default_rng(5)
    for n, m, dim, spread in ((1, 1, 3, 5), (500, 40, 2, 300), (1000, 256, 4, 20), (300, 7, 16, 2000), (64, 64, 1, 3)):
        points, entries = rng.integers(-spread, spread, (n, dim)), rng.integers(-spread, spread, (m, dim))
        tree, own = codebooks.PartTree.build(points, 8), codebooks.entry_tree(entries)
        tree.left.flags.writeable = False
        whole, leaves = codebooks.assign(tree, own)
        found = np.full(n, -1)
        for node, entry in [*whole, *leaves]:
            assert (found[tree.first[node] : tree.end[node]] == -1).all()
            found[tree.first[node] : tree.end[node]] = entry
        want = ((tree.points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
        assert (found == want).all()
        assert (tree.sums[0] == points.sum(0)).all()
    far = np.r_[rng.integers(0, 9, (400, 3)), rng.integers(5000, 5009, (400, 3))]
    whole, leaves = codebooks.assign(codebooks.PartTree.build(far, 8), codebooks.entry_tree(np.array([[5, 5, 5], [5005, 5005, 5005]])))
    assert len(whole) == 2 and not leaves  # whole subtrees by their cached sums
