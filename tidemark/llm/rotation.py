"""Embedding near-dedup with randomised-rotation binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components
from .forest import deal_to_tiles

#: Bits in a bucket key at least, the chance that a pair at the limit shares no bucket at most,
#: rows of one side of a tile, and half-width of the confidence bounds in standard errors.
MIN_BITS, MISS, TILE_ROWS, WIDTH = 6, 1e-3, 2048, 6.0
#: Unlike vectors per bucket that the number of key bits aims at.
BUCKET_ROWS = 256


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same for everyone who asks with the same seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of rotated unit vectors, and each code's cosine with its vector.

    That cosine is the correction factor: the inner product of a code and another vector,
    divided by it, estimates the inner product of the vectors without bias.
    """
    turned = unit @ turn
    bits = turned > 0
    return bits, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def estimate(bits: np.ndarray, factor: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of rotated ``queries`` with coded vectors: estimates, and standard errors.

    ``<code, q> / factor``; what the code leaves out lies at random across the code's direction,
    so the error of a unit query is about ``sqrt((1 - factor^2) / (factor^2 (dim - 1)))``.
    """
    dim = bits.shape[1]
    signs = np.where(bits, 1.0, -1.0) / math.sqrt(dim)
    error = np.sqrt(np.maximum(0.0, 1 - factor**2) / (factor**2 * max(1, dim - 1)))
    return (queries @ signs.T) / factor, np.broadcast_to(error, (len(queries), len(bits)))


def plan_keys(rows: int, limit: float, miss: float = MISS) -> tuple[int, int]:
    """Bits in a key and number of keys for so many vectors.

    A bit agrees with the chance ``1 - angle / pi``. Keys grow with the logarithm of the rows,
    so buckets of unlike vectors keep their size; the number of keys is what a pair exactly at
    the limit needs to miss all of them with a chance below ``miss``. Closer pairs miss fewer.
    """
    bits = max(MIN_BITS, math.ceil(math.log2(max(2, rows / BUCKET_ROWS))))
    agree = (1 - math.acos(limit) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.array([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_TURNS: dict[tuple[int, int], np.ndarray] = {}


def _turn(dim: int, seed: int) -> np.ndarray:
    """Rotations that a worker remembers; seed 0 is the codes', the others give bucket keys."""
    if (dim, seed) not in _TURNS:
        if len(_TURNS) >= 128:
            _TURNS.clear()
        _TURNS[dim, seed] = rotation(dim, seed)
    return _TURNS[dim, seed]


def bucket_keys(unit: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """Bucket numbers, a column per key: runs of sign bits of rotated rows, and the dimension."""
    n, dim = unit.shape
    out = np.empty((n, keys), np.int64)
    runs = max(1, dim // bits)
    weights = 1 << np.arange(bits, dtype=np.int64)
    for k in range(keys):
        if k % runs == 0:
            signs = (unit @ _turn(dim, 1 + k // runs)) > 0
        part = signs[:, k % runs * bits : (k % runs + 1) * bits]
        out[:, k] = part @ weights[: part.shape[1]] + (dim << 40)
    return out


def near_vectors(vectors: DataFrame, limit: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Two vectors of the same dimension are linked when their cosine, in double precision, is at
    least ``limit``. Equal vectors are one until the end and link with each other. Vectors that
    are null, empty or zero, or hold null or non-finite components, link with nothing and are
    kept. Rows that repeat an id count as vectors of their own; null ids are kept and link with
    nothing. Other columns stay behind.
    """
    kind = "<f4" if vectors.schema[embedding].dataType.simpleString() == "array<float>" else "<f8"
    values = F.col(embedding) if kind == "<f4" else F.col(embedding).cast("array<double>")
    given = vectors.select(F.col(vec_id).cast("long").alias("id"), values.alias("_v"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw: list[bytes | None] = []
            for k, v in zip(batch.column("id"), batch.column("_v")):
                x = v.as_py() if k.is_valid else None
                y = np.asarray(x, kind) if x and None not in x else np.empty(0)
                raw.append(y.tobytes() if len(y) and np.isfinite(y).all() and y.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], names=["id", "raw"])

    scratch = Scratch(vectors.sparkSession)
    rows = scratch.cut(given.mapInArrow(clean, "id long, raw binary").withColumn("key", F.sha2("raw", 256)), "vectors")
    one = scratch.cut(rows.where("raw IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "distinct")
    bits, keys = plan_keys(one.count(), limit)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            codes: list = [None] * len(raw)
            for size in set(map(len, raw)):
                at = [i for i, r in enumerate(raw) if len(r) == size]
                for i, found in zip(at, bucket_keys(_units([raw[i] for i in at], kind), bits, keys).tolist()):
                    codes[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(pa.int64()))], names=[*batch.schema.names, "codes"])

    coded = one.select("key", "id", "copies", "raw").mapInArrow(code, "key string, id long, copies long, raw binary, codes array<bigint>")
    posted = coded.select("key", "id", "copies", "raw", F.posexplode("codes").alias("t", "code"))
    full = posted.groupBy("t", "code").agg(F.count("*").alias("n")).where("n > 1")
    tiles = deal_to_tiles(posted.join(full, ["t", "code"]), F.ceil(F.col("n") / TILE_ROWS).cast("long"))
    found = scratch.cut(
        tiles.select("t", "code", "_i", "_j", "_part", "key", "id", "copies", "raw").groupBy("t", "code", "_i", "_j")
        .applyInArrow(_linker(limit, bits, kind), "key string, id long, links long, other long"), "links",
    )
    links = found.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    out = rows.join(one.select("key", F.col("id").alias("_rep"), "copies"), "key", "left").join(links, "key", "left")
    out = out.join(groups.select(F.col("node").alias("_rep"), "component"), "_rep", "left")
    component = F.coalesce("component", "_rep", "id")
    return scratch.close(out.select(
        F.col("id").alias(vec_id), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    ))


def _linker(limit: float, bits: int, kind: str):
    """Links inside one tile of one bucket: counts per vector, and edges that connect them.

    The codes' confidence bounds decide which pairs need their cosine: only pairs whose upper
    bound reaches the limit are recomputed in double precision. A pair belongs to the first key
    that brings it together, and to one tile of that, so no link counts twice.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _, i0, j0 = (k.as_py() for k in key)
        names, ids, copies, raw, part = [], [], [], [], []
        for batch in batches:
            for out, name in ((names, "key"), (ids, "id"), (copies, "copies"), (raw, "raw"), (part, "_part")):
                out += batch.column(name).to_pylist()
        copies, part, unit = np.array(copies), np.array(part), _units(raw, kind)
        n, dim = unit.shape
        turned = unit @ _turn(dim, 0)
        code, factor = encode(unit, _turn(dim, 0))
        before = bucket_keys(unit, bits, t)
        links, label = np.zeros(n, np.int64), np.arange(n)
        edges: list[tuple[int, int]] = []
        for k in range(0, n, 256):
            guess, error = estimate(code, factor, turned[k : k + 256])
            pairs = guess + WIDTH * error >= limit
            pairs &= np.arange(n) > np.arange(k, min(n, k + 256))[:, None]
            if i0 != j0:  # two rows of one part meet in that part's own tile
                pairs &= part[None, :] != part[k : k + 256, None]
            i, j = np.nonzero(pairs)
            i += k
            for s in range(0, len(i), 65536):
                a, b = i[s : s + 65536], j[s : s + 65536]
                fresh = np.ones(len(a), bool)
                for c in range(t):
                    fresh &= before[a, c] != before[b, c]
                a, b = a[fresh], b[fresh]
                hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= limit
                a, b = a[hit], b[hit]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                apart = label[a] != label[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                    if label[x] != label[y]:
                        label[label == label[y]] = label[x]
                        edges.append((x, y))
        some = np.flatnonzero(links).tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([names[i] for i in some] + [names[i] for i, _ in edges], pa.string()),
                pa.array([ids[i] for i in some] + [ids[i] for i, _ in edges], pa.int64()),
                pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64()),
                pa.array([*[None] * len(some), *[ids[j] for _, j in edges]], pa.int64()),
            ],
            names=["key", "id", "links", "other"],
        )

    return run
