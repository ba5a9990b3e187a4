import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash, rotation
from tidemark.llm.common import Scratch, components
from tidemark.llm.forest import forest_edges

from .conftest import DOCS, prose


def _groups(n, pairs):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    rows = [*pairs, (7, 7), (None, 3), *pairs[:5]]
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long"), Scratch(spark)).collect()}
    want = _groups(600, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_forest_connects_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        links = np.triu(rng.random((n, n)) < rng.choice([0.02, 0.1, 0.5]), 1)
        links |= links.T
        edges = forest_edges(n, lambda i, others: others[links[i, others]])
        assert len(edges) < n or n == 1
        assert _groups(n, edges) == _groups(n, zip(*np.nonzero(links)))


def _plain_documents(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(minhash._UPPER).split()
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    pairs = [
        (a, b) for a in range(len(rows)) for b in range(a)
        if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    up = _groups(len(rows), pairs)
    least = {}
    for i, g in enumerate(up):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return [(r[0], len(sets[i]), least[up[i]] if r[0] is not None else None, r[0] is None or least[up[i]] == r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("tile", [None, 9])
def test_documents(spark, odd_docs, no_docs, tile, monkeypatch):
    if tile:
        monkeypatch.setattr(minhash, "TILE_ROWS", tile)
        monkeypatch.setattr(minhash, "TILE_SHINGLES", 700)
    rng = random.Random(9)
    base = prose(21, 150).split(" ")
    rows = [tuple(r) for r in odd_docs.collect()]
    for k in range(40):  # near copies at all distances
        own = list(base)
        for _ in range(rng.randint(1, 12)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((100 + k, " ".join(own), "en", "a", 1))
    rows += [(200 + k, " ".join(base), "en", "hot", 1) for k in range(20)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("old"))
    got = minhash.near_duplicates(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(_plain_documents(rows), key=key)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_match_threshold_misses_hardly_any():
    from math import comb

    miss = sum(comb(minhash.COORDINATES, k) * 0.75**k * 0.25 ** (minhash.COORDINATES - k) for k in range(minhash.MATCHES))
    assert miss < 1e-5


def _plain_vectors(rows, limit):
    at = [i for i, (k, v) in enumerate(rows) if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in at}
    pairs = [(a, b) for a in at for b in at if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= limit]
    n = [0] * len(rows)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    up = _groups(len(rows), pairs)
    least = {}
    for i, g in enumerate(up):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return sorted([(r[0] if r[0] is not None else -1, n[i], least[up[i]] if r[0] is not None else -1) for i, r in enumerate(rows)])


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(None, (centre + rng.normal(size=16) * s).tolist()) for s in (0.05, 0.1, 0.15, 0.2, 0.3)]
    rows = [(k, np.array(v, np.float32).tolist()) for k, (_, v) in enumerate(rows)]
    hot = rows[3][1]
    rows += [(100 + k, hot) for k in range(30)] + [(100, hot)]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [1.0, None] + [0.0] * 14), (204, [float("nan")] + [1.0] * 15), (205, [float("inf")] + [1.0] * 15)]
    rows += [(206, [1.0, 2.0]), (207, [2.0, 4.0]), (208, [1e-30] * 16), (209, [1.0] * 16), (None, hot)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("n_links", F.lit("x"))
    for tile in (2048, 7):
        monkeypatch.setattr(rotation, "TILE_ROWS", tile)
        got = rotation.near_vectors(df, 0.9).collect()
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1) for r in got) == _plain_vectors(rows, 0.9)
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert rotation.near_vectors(df.limit(0), 0.9).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = rng.normal(size=(50, 48)) + 0.7 * x[:50] * 7
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    wrong = []
    for seed in range(30):
        turn = rotation.rotation(48, seed)
        bits, factor = rotation.encode(x, turn)
        guess, error = rotation.estimate(bits, factor, q @ turn)
        wrong.append((guess - q @ x.T) / error)
    wrong = np.array(wrong)
    assert abs(wrong.mean()) < 0.01 and 0.8 < wrong.std() < 1.2 and np.abs(wrong).max() < rotation.WIDTH


def test_an_id_with_several_texts_keeps_all_links(spark):
    a, b = prose(51, 60), prose(52, 60)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, prose(53, 60)), (5, b), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (docs, docs.orderBy(F.desc("text"))):
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(order).collect()}
        assert got == {(1, 56, 1, True), (2, 57, 1, False), (3, 57, 1, False), (4, 56, 4, True), (5, 56, 1, False), (5, 0, 5, True)}
