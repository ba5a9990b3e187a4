"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory
from .decontamination import words
from .labels import labelled_sample

#: Labelled examples at most, neighbours asked, examples in a block, texts scored together.
EXAMPLES, NEIGHBOURS, BLOCK, TOGETHER = 6000, 15, 64, 128
#: A term weighs 1 + its likelihood ratio statistic over this: chance alone (mean 1) hardly
#: changes a weight, and every term keeps one.
RATIO_SCALE = 10.0
#: Weight of the rate of the label against the votes.
PRIOR_WEIGHT = 0.25
#: Layout only, results don't depend on it: terms in this share of the examples at least, and at
#: most so many, are held as dense blocks, the others as inverted lists; clusters that bring
#: similar examples into the same blocks; blocks looked at first.
DENSE_SHARE, DENSE_TERMS, CLUSTERS, FIRST = 0.05, 2048, 64, 8
#: More than the rounding error of a cosine summed in single precision.
ROUNDING = 1e-4
class KnownTerms:
    """Counts of the index's words in a whole text."""

    def __init__(self, terms: dict[bytes, int]):
        self.terms = terms

    def counts(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms (ascending, distinct) and their counts."""
        found, terms = Counter(words(text)), self.terms
        own = found.keys() & terms.keys() if len(found) > len(terms) else [w for w in found if w in terms]
        idx = np.array([terms[w] for w in own], np.int64)
        order = np.argsort(idx)
        return idx[order], np.array([found[w] for w in own], float)[order]


class BlockMaxIndex:
    """Unit TF-IDF vectors in blocks, with the largest weight of each common term in each block."""

    def __init__(self, terms: list[bytes], idf: np.ndarray, examples, prior: float):
        #: examples: (id, label, counts as in ``vector``), only such with terms; order decides ties.
        self.terms, self.idf, self.prior = {t: k for k, t in enumerate(terms)}, np.asarray(idf, float), prior
        self.slope, self.offset, self.layout = 1.0, 0.0, None
        self.ids, y, cols, vals = [], [], [], []
        for name, label, counts in examples:
            idx, w = self.vector(counts)
            self.ids.append(name)
            y.append(label)
            cols.append(idx.astype(np.int32))
            vals.append(w)
        self.y = np.array(y, float)
        self.start = np.concatenate(([0], np.cumsum([len(c) for c in cols]))).astype(np.int64)
        self.col = np.concatenate(cols) if cols else np.empty(0, np.int32)
        self.val = np.concatenate(vals) if vals else np.empty(0)
        #: The first example with the same vector; copies are compared once.
        first: dict[bytes, int] = {}
        self.same = np.array([first.setdefault(blake2b(c.tobytes() + v.tobytes(), digest_size=16).digest(), k) for k, (c, v) in enumerate(zip(cols, vals))], np.int64)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"layout": None}  # laid out again where it is used

    def vector(self, counts) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of ``{term: count}``, or of term numbers (ascending) and their counts."""
        if isinstance(counts, dict):
            at = sorted((self.terms[t], c) for t, c in counts.items() if t in self.terms)
            counts = np.array([t for t, _ in at], np.int64), np.array([c for _, c in at], float)
        idx, times = counts
        w = (1 + np.log(times)) * self.idf[idx]
        return idx, w / np.sqrt((w * w).sum()) if len(w) else w

    def _lay(self) -> tuple:
        """Dense blocks, their maxima, lists of the other terms, and where each example went."""
        if self.layout is not None:
            return self.layout
        n, size = len(self.ids), len(self.idf)
        rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.start))
        df = np.bincount(self.col, minlength=size)
        common = np.argsort(-df, kind="stable")[:DENSE_TERMS]
        common = common[df[common] >= max(1, DENSE_SHARE * n)]
        number = np.full(size, -1, np.int32)
        number[common] = np.arange(len(common))
        held = number[self.col]
        inside = held >= 0
        blocks = -(-n // BLOCK)
        dense = np.zeros((blocks * BLOCK, len(common)), np.float32)
        dense[rows[inside], held[inside]] = self.val[inside]
        order = np.concatenate((_similar_together(dense[:n]), np.arange(n, blocks * BLOCK)))
        slot = np.argsort(order)
        dense = dense[order].reshape(blocks, BLOCK, len(common))
        top = dense.max(axis=1)
        used = [np.flatnonzero(x) for x in top]
        dense = [np.ascontiguousarray(x[:, u]) for x, u in zip(dense, used)]
        rare = np.flatnonzero(~inside)
        rare = rare[np.argsort(self.col[rare], kind="stable")]
        begin = np.concatenate(([0], np.cumsum(np.bincount(self.col[rare], minlength=size)))).astype(np.int64)
        self.layout = number, list(zip(used, dense)), top, begin, slot[rows[rare]], self.val[rare].astype(np.float32), order, slot
        return self.layout

    def nearest(self, counts, leave: int = -1, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples, exactly, ties to the smaller position: cosines, positions."""
        return self.nearest_of([self.vector(counts)], [leave], k)[0]

    def nearest_of(self, vectors: list[tuple], leave: list[int], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for several vectors.

        Lists of the rarer terms are summed whole. A block's bound is the best of those sums in
        it plus the query times the block's largest weights; the blocks of highest bound come
        first, then all whose bound reaches the k-th best so far. What may be among the k best
        is compared again in double precision.
        """
        number, dense, top, begin, at, weight, order, slot = self._lay()
        blocks, n = len(dense), len(self.ids)
        if not blocks:
            return [(np.empty(0), np.empty(0, np.int64)) for _ in vectors]
        sums = np.zeros((len(vectors), blocks * BLOCK), np.float32)
        asked = np.zeros((len(vectors), top.shape[1]), np.float32)
        for r, (idx, q) in enumerate(vectors):
            held = number[idx]
            inside = held >= 0
            asked[r, held[inside]] = q[inside]
            rest, ends = idx[~inside], begin[idx[~inside] + 1]
            sizes = ends - begin[rest]
            total = np.cumsum(sizes)
            if len(total) and total[-1]:
                post = np.arange(total[-1]) + np.repeat(ends - total, sizes)
                sums[r] = np.bincount(at[post], weight[post] * np.repeat(q[~inside].astype(np.float32), sizes), sums.shape[1])
        cells = sums.reshape(len(vectors), blocks, BLOCK)
        bound = cells.max(axis=2) + asked @ top.T
        open_ = np.zeros(bound.shape, bool)
        first = min(FIRST, blocks)
        best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        np.put_along_axis(open_, best, True, axis=1)
        seen, turned = np.zeros_like(open_), np.ascontiguousarray(asked.T)
        for last in (False, True):
            for b in np.flatnonzero(open_.any(axis=0)):
                who = np.flatnonzero(open_[:, b])
                used, part = dense[b]
                weights = turned[used]
                if 2 * len(who) < len(vectors):
                    cells[who, b] += (part @ weights[:, who]).T
                else:
                    cells[who, b] += (part @ weights).T[who]
            seen |= open_
            if not last:
                for r, j in enumerate(leave):
                    if j >= 0:
                        sums[r, slot[j]] = -1.0  # what is added stays below zero or about it
                some = np.take_along_axis(cells, best[:, :, None], axis=1).reshape(len(vectors), -1)
                least = np.partition(some, -k, axis=1)[:, -k] if some.shape[1] > k else np.zeros(len(vectors))
                open_ = (bound > 0) & (bound >= least[:, None] - ROUNDING) & ~seen
        cells[~seen] = 0
        out, q = [], np.zeros(len(self.idf))
        for r, (idx, w) in enumerate(vectors):
            mine = np.flatnonzero(sums[r] >= max(least[r] - ROUNDING, 1e-30))
            if len(mine) > k:
                mine = mine[sums[r, mine] >= np.partition(sums[r, mine], -k)[-k] - ROUNDING]
            docs = order[mine]
            docs = np.sort(docs[(docs < n) & (docs != leave[r])])
            q[idx] = w
            own, back = np.unique(self.same[docs], return_inverse=True)
            ranges = [slice(self.start[j], self.start[j + 1]) for j in own]
            sims = np.array([q[self.col[x]] @ self.val[x] for x in ranges])[back] if len(docs) else np.empty(0)
            q[idx] = 0
            few = np.lexsort((docs, -np.round(sims, 12)))[:k]
            out.append((sims[few], docs[few]))
        return out

    def votes(self, vectors: list, leave: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Votes weighted by closeness, with the rate of the label; only that for a text without known terms."""
        out = []
        for k in range(0, len(vectors), TOGETHER):
            part = vectors[k : k + TOGETHER]
            for sims, docs in self.nearest_of(part, leave[k : k + TOGETHER] if leave else [-1] * len(part)):
                near = sims / (1.02 - np.minimum(sims, 1.0))  # closeness over distance, kept finite
                out.append(((near @ self.y[docs] + PRIOR_WEIGHT * self.prior) / (near.sum() + PRIOR_WEIGHT), sims, docs))
        return out

    def scores(self, counts: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        return [(float(1 / (1 + np.exp(-(self.slope * _logit(v) + self.offset)))), sims, docs) for v, sims, docs in self.votes([self.vector(c) for c in counts])]

    def calibrate(self, votes: np.ndarray, y: np.ndarray) -> None:
        """Logistic calibration of leave-one-out votes, slope kept positive."""
        x, a, b = _logit(votes), 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum() + 1e-2 * b])
            h = p * (1 - p)
            hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
            step = np.linalg.solve(hess, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = max(a, 1e-3), b


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _similar_together(rows: np.ndarray) -> np.ndarray:
    """An order of the rows that brings similar ones together (a few rounds of spherical means)."""
    n = len(rows)
    if n <= BLOCK or not rows.shape[1]:
        return np.arange(n)
    means = rows[np.linspace(0, n - 1, min(CLUSTERS, n)).astype(int)]
    for _ in range(4):
        near = (rows @ means.T).argmax(axis=1)
        means = np.stack([rows[near == c].sum(axis=0) if (near == c).any() else means[c] for c in range(len(means))])
        means /= np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-9)
    return np.argsort(near, kind="stable")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", examples: int = EXAMPLES) -> BlockMaxIndex | None:
    """Index of at most ``examples`` labelled documents; None without labels.

    Terms are all words (A-Z lower-cased) of the sample, with the IDF of the sample. How well a
    term's presence tells the label (likelihood ratio on the sample) raises its weight; none is
    left out. Spark counts the words; the driver gets the counts, as many as the sample's bytes
    allow. The sample has one row an id (see ``labelled_sample``); other columns aren't read.
    """
    rows = labelled_sample(docs, labels, label, examples)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [Counter(words(t.as_buffer().to_pybytes())) for t in batch.column("text")]
            found = pa.array([b" ".join(g) for g in got], pa.binary())
            times = pa.array([np.fromiter(g.values(), np.int32, len(g)).tobytes() for g in got], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), found, times], names=["doc_id", "y", "found", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    few = rows.mapInArrow(bags, f"doc_id {kind}, y int, found binary, times binary").collect()  # bounded by ``examples``
    if not few:
        return None
    few.sort(key=lambda r: (str(r.doc_id), r.y, bytes(r.found), bytes(r.times)))
    known: dict[bytes, int] = {}
    kept, bare = [], []
    for r in few:
        bag = bytes(r.found).split()
        if not bag:
            bare.append(r.y)
            continue
        idx = np.fromiter((known.setdefault(t, len(known)) for t in bag), np.int32, len(bag))
        order = np.argsort(idx)
        kept.append((r.doc_id, r.y, (idx[order], np.frombuffer(r.times, np.int32)[order])))
    n, n1 = len(few), sum(r.y for r in few)
    del few
    prior = (n1 + 1) / (n + 2)
    a, b = (np.bincount(np.concatenate([np.empty(0, np.int32), *[c[0] for _, y, c in kept if y == side]]), minlength=len(known)) for side in (1, 0))
    idf = np.log((1 + n) / (1 + a + b)) + 1
    terms = list(known)
    del known
    kept.reverse()
    index = BlockMaxIndex(terms, idf * (1 + _ratio(a, b, n1, n - n1) / RATIO_SCALE), (kept.pop() for _ in range(len(kept))), prior)
    own = [(index.col[s:e], index.val[s:e]) for s, e in zip(index.start, index.start[1:])]
    votes = [v for v, _, _ in index.votes(own, list(range(len(own))))] + [prior] * len(bare)
    index.calibrate(np.array(votes), np.array([*index.y, *bare], float))
    index.layout = None
    release_memory()
    return index


def _ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio statistic of terms that ``a`` of ``n1`` and ``b`` of ``n0`` examples have."""
    part = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.where(k > 0, e, 1)), 0.0)
    m, n = a + b, n1 + n0
    g = 2 * (part(a, m * n1 / n) + part(b, m * n0 / n) + part(n1 - a, (n - m) * n1 / n) + part(n0 - b, (n - m) * n0 / n))
    return np.maximum(g, 0.0)


def score(docs: DataFrame, index: BlockMaxIndex | None, text: str = "text", threshold: float = 0.5, evidence: int = 3) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``evidence``; no shuffle.

    ``evidence`` lists the nearest examples that voted: id (as text), label and cosine. A text
    without any word of the sample, empty and null ones too, gets the calibrated rate of the
    label and no evidence. Without an index every score is 0.5. Columns of these names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted", "evidence")])
    seen = T.StructType([T.StructField("doc", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("cosine", T.DoubleType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(seen))])
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        known = KnownTerms(index.terms if index else {})
        for batch in batches:
            scores, notes = [], []
            column = batch.column(text)
            for k in range(0, len(column), TOGETHER):
                part = column[k : k + TOGETHER]
                counts = [known.counts(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part] if index else []
                for s, sims, at in index.scores(counts) if index else [(0.5, [], [])] * len(part):
                    scores.append(s)
                    notes.append([{"doc": str(index.ids[j]), "label": int(index.y[j]), "cosine": float(c)} for c, j in zip(sims[:evidence], at[:evidence])])
            arrow = pa.list_(pa.struct([("doc", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(notes, arrow)],
                names=[*batch.schema.names, "score", "predicted", "evidence"],
            )

    return docs.mapInArrow(run, schema)
