"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import io
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch
from .labels import labelled_sample

#: Hash buckets of words, structure and metadata features after them, and interaction rank.
BUCKETS, RANK = 1 << 14, 6
#: Labelled rows that the model is fitted on at most, parts they are trained in, rounds, passes
#: over a part in a round, rows in a step, and steps in a round at least (more passes, if need be).
SAMPLE_ROWS, PARTS, ROUNDS, PASSES, BATCH, STEPS = 8000, 4, 3, 3, 64, 60
_SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_STRUCTURE = 12 + len(_SYMBOLS) + 1
WIDTH = BUCKETS + _STRUCTURE


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a whole text: indices (ascending, distinct) and values.

    Words have log counts scaled to unit length together; structure features are rates mapped
    to about 0..1; the last feature is the length that the metadata states (text's own if null).
    """
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(raw))
    found = text.split()
    seen = Counter(found)
    buckets: dict[int, float] = {}
    for w, c in seen.items():
        b = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % BUCKETS
        buckets[b] = buckets.get(b, 0) + c
    idx = np.fromiter(sorted(buckets), np.int64, len(buckets))
    val = np.log1p(np.fromiter(map(buckets.__getitem__, idx.tolist()), np.float64, len(buckets)))
    if len(val):
        val /= np.sqrt((val * val).sum())
    lines = [x for x in text.split("\n") if x.strip()]
    n_words, letters = max(1, len(found)), counts[65:91].sum() + counts[97:123].sum()
    shape = [
        1.0,
        min(1.0, np.log1p(len(text)) / 12),
        min(1.0, np.log1p(len(found)) / 10),
        counts[65:91].sum() / max(1.0, letters),
        min(1.0, 5 * counts[48:58].sum() / n),
        min(1.0, counts[128:].sum() / n * 2),
        min(1.0, len(text) / n_words / 20),
        len(seen) / n_words,
        max(seen.values(), default=0) / n_words,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, np.log1p(len(lines)) / 8),
        min(1.0, n_words / max(1, len(lines)) / 100),
    ]
    rates = np.minimum(1.0, np.sqrt(5 * counts[list(_SYMBOLS)] / n))
    stated = min(1.0, np.log1p(max(0, len(text) if n_chars is None else n_chars)) / 12)
    dense = np.concatenate((shape, rates, [stated]))
    at = np.flatnonzero(dense)
    return np.concatenate((idx, BUCKETS + at)), np.concatenate((val, dense[at]))


class FactorisationMachine:
    """y = w0 + <w, x> + 1/2 * sum over f of ((sum of v_f x)^2 - sum of (v_f x)^2), logistic."""

    def __init__(self, params: np.ndarray | None = None):
        if params is None:
            params = np.zeros((WIDTH + 1, 1 + RANK))
            params[:WIDTH, 1:] = np.random.default_rng(11).normal(0, 0.05, (WIDTH, RANK))
        self.params = params  # the last row's first cell is w0

    def margins(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of the rows that begin at ``starts``; no row may be empty. Linear in features."""
        p = self.params[idx]
        vx = p[:, 1:] * val[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.params[WIDTH, 0] + np.add.reduceat(p[:, 0] * val, starts) + 0.5 * (sums * sums - squares).sum(1)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int, seed: int, rate: float = 0.1, ridge: float = 1e-5, batch: int = BATCH) -> None:
        """AdaGrad over mini-batches, in an order that ``seed`` fixes."""
        rng, scale = np.random.default_rng(seed), np.full_like(self.params, 1e-2)
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), batch):
                part = [rows[i] for i in order[k : k + batch]]
                idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
                sizes = np.array([len(r[0]) for r in part])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                y = np.array([r[2] for r in part], float)
                wrong = (1 / (1 + np.exp(-np.clip(self.margins(idx, val, starts), -30, 30))) - y) / len(part)
                each = np.repeat(wrong, sizes)
                v = self.params[idx, 1:]
                vx = v * val[:, None]
                sums = np.repeat(np.add.reduceat(vx, starts), sizes, axis=0)
                step = np.column_stack((each * val, each[:, None] * val[:, None] * (sums - vx)))
                touched, where = np.unique(idx, return_inverse=True)
                grad = np.column_stack([np.bincount(where, step[:, c], len(touched)) for c in range(step.shape[1])])
                grad += ridge * self.params[touched]
                scale[touched] += grad * grad
                self.params[touched] -= rate * grad / np.sqrt(scale[touched])
                w0 = wrong.sum()
                scale[WIDTH, 0] += w0 * w0
                self.params[WIDTH, 0] -= rate * w0 / np.sqrt(scale[WIDTH, 0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Parameters fitted on at most ``sample_rows`` labelled documents; None without labels.

    The sample's features are written once; in each round every part goes over its own rows from
    the parameters so far, as a task of its own, and the results are averaged. What a task and
    the driver hold depends on the documented bounds only.
    """
    stated = _stated(docs)
    rows = labelled_sample(docs, labels, label, sample_rows, ("n_chars",) if stated else ())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t.as_py(), n.as_py()) for t, n in zip(batch.column("text"), batch.column("n"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("doc_id"), batch.column("y"), pa.array([g[0].tolist() for g in got], pa.list_(pa.int32())), pa.array([g[1].tolist() for g in got], pa.list_(pa.float64()))],
                names=["part", "doc_id", "y", "idx", "val"],
            )

    n = F.col("n_chars") if stated else F.lit(None)
    rows = rows.select("doc_id", "text", "y", n.cast("long").alias("n"), F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(PARTS)).cast("int").alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sample = Scratch(docs.sparkSession).cut(rows.mapInArrow(extract, f"part int, doc_id {kind}, y int, idx array<int>, val array<double>"), "quality")
    if sample.isEmpty():
        return None
    model = FactorisationMachine()
    for k in range(ROUNDS):
        now = docs.sparkSession.sparkContext.broadcast(model.params)
        parts = sample.groupBy("part").applyInPandas(_trainer(now, k), "n long, params binary").collect()  # PARTS rows
        total = sum(p.n for p in parts)
        model = FactorisationMachine(sum(np.load(io.BytesIO(p.params)) * (p.n / total) for p in parts))
    return model.params


def _trainer(now, seed: int):
    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        own = FactorisationMachine(now.value.copy())
        own.fit([(np.asarray(i, np.int64), np.asarray(v), y) for i, v, y in zip(pdf.idx, pdf.val, pdf.y)], max(PASSES, -(-STEPS // -(-len(pdf) // BATCH))), seed)
        out = io.BytesIO()
        np.save(out, own.params)
        return pd.DataFrame({"n": [len(pdf)], "params": [out.getvalue()]})

    return train


def _stated(docs: DataFrame) -> bool:
    return "n_chars" in docs.columns and docs.schema["n_chars"].dataType.simpleString() in ("int", "bigint")


def score(docs: DataFrame, params: np.ndarray | None, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted``; no shuffle.

    The inputs are the whole text and ``n_chars``, where that column exists; null texts count as
    empty and get a score too. Without a fitted model every score is 0.5. Columns of these two
    names are replaced.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    held = docs.sparkSession.sparkContext.broadcast(params)
    stated = _stated(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None if held.value is None else FactorisationMachine(held.value)
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            lengths = batch.column("n_chars") if stated else [None] * batch.num_rows
            for k in range(0, batch.num_rows if model else 0, 128):
                got = [
                    features(t.as_py() if t.is_valid else "", n.as_py() if n is not None else None)
                    for t, n in zip(batch.column(text)[k : k + 128], lengths[k : k + 128])
                ]
                starts = np.concatenate(([0], np.cumsum([len(g[0]) for g in got])[:-1])).astype(np.int64)
                margins = model.margins(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), starts)
                out[k : k + 128] = 1 / (1 + np.exp(-np.clip(margins, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out), pa.array((out >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"],
            )

    return docs.mapInArrow(run, schema)
