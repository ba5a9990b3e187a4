"""Vector code compression: codebooks per part of a vector by dual-tree Lloyd iteration, in integers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release_memory

#: Vectors of a block (each has its own trees), and points or entries of a leaf.
BLOCK_ROWS, POINT_LEAF, ENTRY_LEAF = 4096, 32, 1
_TREES = ("sets", "points", "lows", "highs", "sums")


def tree_nodes(size: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary tree over ``size`` ordered points: first point, end, and left child of each node.

    Nodes are numbered level by level; a node's right child follows the left one, and a leaf's
    left child is 0. It only depends on the two numbers, so trees need not store it.
    """
    first, end, left = [0], [size], []
    k = 0
    while k < len(first):
        a, b = first[k], end[k]
        if b - a <= leaf:
            left.append(0)
        else:
            left.append(len(first))
            first += [a, (a + b) // 2]
            end += [(a + b) // 2, b]
        k += 1
    return np.array(first), np.array(end), np.array(left)


class PartTree:
    """Points of one part in tree order, with the box, the sum and the count of every node."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, leaf: int):
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums
        self.first, self.end, self.left = tree_nodes(len(points), leaf)

    @classmethod
    def build(cls, points: np.ndarray, leaf: int) -> PartTree:
        """Halve at the median of the widest dimension until a node is a leaf."""
        first, end, left = tree_nodes(len(points), leaf)
        order = np.arange(len(points))
        shape = (len(first), points.shape[1])
        low, high, sums = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for k, (a, b) in enumerate(zip(first, end)):
            if a == b:
                continue
            some = points[order[a:b]]
            low[k], high[k], sums[k] = some.min(0), some.max(0), some.sum(0)
            if left[k]:
                wide = some[:, np.argmax(high[k] - low[k])]
                order[a:b] = order[a:b][np.argpartition(wide, end[left[k]] - a, kind="introselect")]
        return cls(order, points[order], low, high, sums, leaf)


def _far(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance that no two points of two boxes exceed."""
    return (np.maximum(high_a - low_b, high_b - low_a) ** 2).sum(1)


def _near(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Squared distance that all pairs of points of two boxes have at least."""
    return (np.maximum(0, np.maximum(low_b - high_a, low_a - high_b)) ** 2).sum(1)


def assign(tree: PartTree, entries: PartTree) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
    """Nearest entries of all points: whole nodes ``(node, entry)`` and leaves ``(node, entries of its points)``.

    Both trees are walked at once, a level at a time. A pair of nodes goes when some entry is
    surely nearer to the whole point node than any of the pair's entries, first by the boxes'
    distances and, for single entries, by the plane between two of them. A node with one entry
    left is assigned as a whole; leaves that stay uncertain get their exact integer distances to
    the entries that are left. Ties go to the lower entry.
    """
    whole: list[tuple[int, int]] = []
    leaves: list[tuple[int, np.ndarray]] = []
    centres = entries.points  # an entry's own point, in tree order
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        near = _near(tree.low[p], tree.high[p], entries.low[e], entries.high[e])
        far = _far(tree.low[p], tree.high[p], entries.low[e], entries.high[e])
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(p)]))
        least = np.minimum.reduceat(far, starts)
        stay = near <= least[group]
        p, e, far = p[stay], e[stay], far[stay]
        single = entries.left[e] == 0
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(p)]))
        all_single = np.logical_and.reduceat(single, starts)
        # the plane between each entry and the one whose farthest distance is least
        best = np.lexsort((far, group))[starts]
        a, b = centres[entries.first[e[best]]][group], centres[entries.first[e]]
        gap = b - a
        worst = (b * b).sum(1) - (a * a).sum(1) - 2 * np.maximum(gap * tree.low[p], gap * tree.high[p]).sum(1)
        stay = ~(all_single[group] & (worst > 0))
        p, e, group, single = p[stay], e[stay], group[stay], single[stay]
        count = np.bincount(group, minlength=len(starts))
        one = (count[group] == 1) & single
        whole += zip(p[one].tolist(), entries.order[entries.first[e[one]]].tolist())
        p, e, group = p[~one], e[~one], group[~one]
        last = (tree.left[p] == 0) & all_single[group]
        if last.any():
            lp, le = p[last], e[last]
            cuts = np.flatnonzero(np.r_[True, lp[1:] != lp[:-1], True])
            for k, j in zip(cuts[:-1], cuts[1:]):
                leaves.append((int(lp[k]), _exact(tree, int(lp[k]), np.sort(entries.order[entries.first[le[k:j]]]), entries)))
        p, e = p[~last], e[~last]
        p, e = _children(tree.left, p, e)
        e, p = _children(entries.left, e, p)
        order = np.lexsort((e, p))
        p, e = p[order], e[order]
    return whole, leaves


def _children(left: np.ndarray, nodes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with each inner node's two children in its place; leaves stay themselves."""
    inner = left[nodes] > 0
    a = left[nodes[inner]]
    return np.r_[nodes[~inner], a, a + 1], np.r_[others[~inner], others[inner], others[inner]]


def _exact(tree: PartTree, node: int, candidates: np.ndarray, entries: PartTree) -> np.ndarray:
    points, some = tree.points[tree.first[node] : tree.end[node]], entries.by_number[candidates]
    return candidates[np.argmin((some * some).sum(1) - 2 * (points @ some.T), axis=1)]


def entry_tree(entries: np.ndarray) -> PartTree:
    tree = PartTree.build(entries, ENTRY_LEAF)
    tree.by_number = entries
    return tree


def _blocks(df: DataFrame, id: str, label: str, vector: str, parts: int, dim: int, scratch: Scratch) -> DataFrame:
    """Vectors in blocks with the trees of their parts, written once for all rounds."""
    id_type, label_type = df.schema[id].dataType.simpleString(), df.schema[label].dataType.simpleString()
    schema = f"ids array<{id_type}>, labels array<{label_type}>, " + ", ".join(f"{x} array<binary>" for x in _TREES)
    step = dim // parts

    def block(ids: pa.Array, labels: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        trees = [PartTree.build(flat[:, k * step : (k + 1) * step], POINT_LEAF) for k in range(parts)]
        listed = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
        packed = [[[np.ascontiguousarray(x, np.int64).tobytes() for x in row]] for row in zip(*[(t.order, t.points, t.low, t.high, t.sums) for t in trees])]
        return pa.RecordBatch.from_arrays([listed(ids), listed(labels), *[pa.array(x, pa.list_(pa.binary())) for x in packed]], names=["ids", "labels", *_TREES])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(k, BLOCK_ROWS)
                flat = some.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.append((some.column(0), some.column(1), flat))
                rows += some.num_rows
                if rows >= BLOCK_ROWS:
                    yield block(*_joined(held))
                    held, rows = [], 0
        if rows:
            yield block(*_joined(held))

    return scratch.cut(df.select(id, label, vector).mapInArrow(build, schema), "blocks")


def _joined(held: list[tuple]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    ids, labels, flat = zip(*held)
    return pa.concat_arrays(ids), pa.concat_arrays(labels), np.concatenate(flat)


def _trees(row: dict, part: int, step: int) -> PartTree:
    order, *rest = [np.frombuffer(row[x][part], np.int64) for x in _TREES]
    return PartTree(order, *[x.reshape(-1, step) for x in rest], POINT_LEAF)


def _one_round(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """What each entry has been assigned, over all blocks: ``(part, entry, count, s0, s1, ...)``."""
    step = books[0].shape[1]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), step), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        entries = [entry_tree(b) for b in books]
        for batch in batches:
            for row in batch.to_pylist():
                for k, own in enumerate(entries):
                    tree = _trees(row, k, step)
                    whole, leaves = assign(tree, own)
                    for node, entry in whole:
                        sums[k][entry] += tree.sums[node]
                        counts[k][entry] += tree.end[node] - tree.first[node]
                    for node, found in leaves:
                        np.add.at(sums[k], found, tree.points[tree.first[node] : tree.end[node]])
                        np.add.at(counts[k], found, 1)
        for k in range(len(books)):
            used = np.flatnonzero(counts[k])
            columns = {"part": np.full(len(used), k, np.int32), "entry": used.astype(np.int32), "count": counts[k][used]}
            yield pa.RecordBatch.from_pydict(columns | {f"s{j}": sums[k][used, j] for j in range(step)})
        release_memory()

    names = [f"s{j}" for j in range(step)]
    found = blocks.select(*_TREES).mapInArrow(gather, "part int, entry int, count long, " + ", ".join(f"{x} long" for x in names))
    return found.groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(x).alias(x) for x in names])


def _moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Entries replaced by the floors of their parts' means; unused ones stay. At most one row an entry comes back."""
    out = [b.copy() for b in books]
    for part, entry, count, *total in sums.collect():
        out[part][entry] = [t // count for t in total]
    return out


def fit_codebooks(blocks: DataFrame, first: np.ndarray, parts: int, rounds: int) -> list[np.ndarray]:
    """Codebooks after ``rounds`` of Lloyd's iteration from the vectors ``first``."""
    books = [np.ascontiguousarray(x) for x in np.split(first, parts, axis=1)]
    for _ in range(rounds):
        books = _moved(books, _one_round(blocks, books))
    return books


def encode(blocks: DataFrame, books: list[np.ndarray], id: str, label: str) -> DataFrame:
    """Codes and errors of all vectors: ``(id, label, code, error)``."""
    step = books[0].shape[1]
    kinds = {f.name: f.dataType.elementType.simpleString() for f in blocks.schema if f.name in ("ids", "labels")}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [entry_tree(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {x: batch.column(x)[i].as_py() for x in _TREES}
                ids = batch.column("ids")[i].values
                codes, error = np.zeros((len(ids), len(books)), np.uint8), np.zeros(len(ids), np.int64)
                for k, own in enumerate(entries):
                    tree = _trees(row, k, step)
                    found = np.zeros(len(ids), np.int64)
                    whole, leaves = assign(tree, own)
                    for node, entry in [*whole, *leaves]:
                        found[tree.first[node] : tree.end[node]] = entry
                    codes[tree.order, k] = found
                    error[tree.order] += ((tree.points - books[k][found]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, batch.column("labels")[i].values, pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])
        release_memory()

    return blocks.mapInArrow(code, f"id {kinds['ids']}, label {kinds['labels']}, code string, error long").toDF(id, label, "code", "error")


def compress(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> DataFrame:
    """Codes of vectors: ``id, code, error, label_error, codebooks_sha256``.

    Components become ``floor(scale * x)``; a vector is cut into ``parts`` equal parts, each part
    position has a codebook of ``entries`` (at most 256) that starts as that part of the vectors
    with the smallest ids and goes through ``rounds`` of assigning and replacing by the floor of
    the mean. ``code`` has two hex digits a part, ``error`` is the squared distance to the coded
    vector and ``label_error`` its sum over the label (nulls are a label of their own).

    Vectors stay where they are read: they are put in blocks with a tree for each part, written
    once, and each round ships the codebooks out and one row an entry and task back, which is
    bounded by the codebooks' size (``entries`` times the dimension).

    Left out: null vectors, vectors with null or non-finite components, and such as can't be cut
    like the first one: of a length other than that of the smallest id's vector whose length
    ``parts`` divides, or with components so large that a squared distance may not fit 60 bits
    (2^28 for 16 components a part). Rows that repeat an id are vectors of their own, in order of their components;
    null ids come last. Fewer vectors than entries make smaller codebooks; no rows give none.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    numbers = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.expr(f"`{vector}` IS NOT NULL") & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(usable).select(F.col(id).alias("id"), F.col(label).alias("label"), numbers.alias("x")).where(F.size("x") % parts == 0).where("size(x) > 0")
    start = rows.orderBy(F.col("id").asc_nulls_last(), F.size("x")).select(F.size("x")).first()
    if start is None:
        return spark.createDataFrame([], f"`{id}` {vectors.schema[id].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    dim = start[0]
    most = math.isqrt((1 << 60) // (dim // parts)) // 2
    fits = (F.size("x") == dim) & F.forall("x", lambda x: F.abs(x * scale) < most - 1)
    rows = rows.where(fits).select("id", "label", F.transform("x", lambda x: F.floor(x * scale)).alias("x"))
    first = np.array([r.x for r in rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()], np.int64).reshape(-1, dim)
    if not len(first):
        return compress(vectors.limit(0), id, vector, label)
    blocks = _blocks(rows, "id", "label", "x", parts, dim, scratch)
    books = fit_codebooks(blocks, first, parts, rounds)
    coded = scratch.cut(encode(blocks, books, "id", "label"), "codes")
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    named = hashlib.sha256(",".join([str(x) for b in books for x in b.ravel()]).encode()).hexdigest()
    out = coded.join(total, coded["label"].eqNullSafe(total["_label"]))
    return scratch.close(out.select(F.col("id").alias(id), "code", "error", "label_error", F.lit(named).alias("codebooks_sha256")))
