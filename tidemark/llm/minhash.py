"""MinHash near-dedup by an inverted join over signature coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, release_memory
from .forest import deal_to_tiles, forest_edges

#: Signature coordinates, and how many of them a pair must share. A pair of similarity 0.75
#: shares fewer than 13 of 32 with a probability of about 5e-6.
COORDINATES, MATCHES = 32, 13
#: Words in a shingle; a link needs ``100 * common >= PERCENT * union``.
SHINGLE, PERCENT = 5, 75
#: Rows of one side of a tile, and shingles of one side of a confirming tile.
TILE_ROWS, TILE_SHINGLES = 2048, 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240501)
_A = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z lower-cased, split at ASCII space."""
    words = text.translate(_UPPER).split()
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(_mixed(out))


def signature(sh: np.ndarray) -> np.ndarray:
    """Smallest value of each coordinate's hash, shortened to 32 bits."""
    out = np.empty(COORDINATES, np.uint64)
    for k in range(COORDINATES):
        out[k] = _mixed(sh * _A[k] + _B[k]).min()
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, ``n`` (set size), ``key`` (digest of the whole set), ``sig``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for t in batch.column("_text"):
                sh = shingles(t.as_buffer().to_pybytes()) if t.is_valid else np.empty(0, np.uint64)
                n.append(len(sh))
                keys.append(xxhash.xxh3_128_digest(sh.tobytes()) if len(sh) else None)
                sigs.append(signature(sh).astype(">u4").tobytes() if len(sh) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "key", "sig"],
            )
        _HASHES.clear()
        release_memory()

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "id long, n long, key binary, sig binary")


def _signatures(stored) -> np.ndarray:
    return np.frombuffer(b"".join(stored), ">u4").reshape(-1, COORDINATES).astype(np.uint32).T.copy()


def _matches(sig: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    return (sig[:, others] == sig[:, i : i + 1]).sum(0)


def candidate_edges(sketches: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``(a, b)`` that connect all documents with ``MATCHES`` or more equal coordinates.

    ``sketches`` has one row ``(id, sig)`` per distinct set. Each coordinate and its value is a
    posting list. A document keeps only a prefix of its coordinates, the rarest first: any two
    with ``MATCHES`` in common share one of the first ``COORDINATES - MATCHES + 1``, so the
    longest lists (common passages) are skipped without losing a pair; coordinates that nobody
    shares count in the prefix but need no list. Lists longer than ``TILE_ROWS`` are cut into
    tiles; inside one, matches are counted by comparing signatures, and only a forest is given.
    """
    token = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda k: F.struct(k.alias("k"), F.substring("sig", k * 4 + 1, F.lit(4)).alias("v")))
    posted = scratch.cut(sketches.select("id", F.explode(token).alias("t")).select("id", "t.k", "t.v").select("id", F.concat(F.chr("k").cast("binary"), "v").alias("t")), "posted")
    shared = posted.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    # a document's coordinates that others share, rarest first; those that nobody shares come before them
    mine = posted.join(shared, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("ts"))
    mine = mine.where(F.size("ts") >= MATCHES)
    prefix = F.slice("ts", F.lit(1), F.size("ts") - (MATCHES - 1))
    lists = scratch.cut(mine.select("id", F.explode(prefix).alias("x")).select("id", "x.t"), "lists")
    sizes = lists.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    # signatures come in last, so that they are shuffled once and only with lists of two or more
    wide = lists.join(sizes, "t").join(sketches.select("id", "sig"), "id")
    tiles = deal_to_tiles(wide, F.ceil(F.col("n") / TILE_ROWS).cast("long"))

    lists = tiles.select("t", "_i", "_j", "id", "sig").repartition("t", "_i", "_j").sortWithinPartitions("t", "_i", "_j", "id")
    return lists.mapInArrow(_count, "a long, b long")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Match counts inside each list of a sorted stream of lists; edges of a forest for each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = _list_keys(batch)
        if held and key[0] == _list_keys(held[-1].slice(held[-1].num_rows - 1))[0]:
            same = next((k for k, x in enumerate(key) if x != key[0]), len(key))
        else:
            same = 0
        if same < len(key):  # the list that was held ends here, and the last one of this batch is held
            last = next(k for k in range(len(key) - 1, -1, -1) if k == 0 or key[k - 1] != key[-1])
            if held or last:
                yield _counted([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _counted(held)


def _list_keys(batch: pa.RecordBatch) -> list[tuple]:
    return list(zip(*[batch.column(c).to_pylist() for c in ("t", "_i", "_j")]))


def _counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    keys = [k for b in batches for k in _list_keys(b)]
    ids, sig = rows.column("id").to_numpy(), _signatures(rows.column("sig").to_pylist())
    cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
    out: list[tuple[int, int]] = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = sig[:, lo:hi]
        if hi - lo <= 64:
            near = (own[:, :, None] == own[:, None, :]).sum(0) >= MATCHES
            edges = forest_edges(hi - lo, lambda i, others, near=near: others[near[i, others]]) if near.sum() > hi - lo else []
        else:
            edges = forest_edges(hi - lo, lambda i, others, own=own: others[_matches(own, i, others) >= MATCHES])
        out += [(lo + i, lo + j) for i, j in edges]
    a, b = np.array(out, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])


def confirmed_edges(docs: DataFrame, groups: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Edges that connect all sets of a candidate group that are alike enough.

    ``groups`` has ``(id, doc, key, group, n, sig)``: a set's number, a document that has it, and
    its digest, by which the right one is found of several texts with one document id. The sets of
    these documents alone are sent, once for a group of up to ``TILE_SHINGLES`` shingles; larger
    groups are cut into tiles. Inside one, pairs with too few matches are passed over and the
    others compared on their full sets.
    """
    sizes = groups.groupBy("group").agg(F.sum("n").alias("_all"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("_text"))
    rows = rows.join(groups.join(sizes, "group").select("id", "doc", "key", "group", "sig", F.ceil(F.col("_all") / TILE_SHINGLES).cast("long").alias("_p")), "doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_buffer().to_pybytes()).tobytes() if t.is_valid else b"" for t in part.column("_text")]
                right = pa.array([xxhash.xxh3_128_digest(x) == k.as_py() for x, k in zip(sets, part.column("key"))], pa.bool_())
                sent = [part.column(c) for c in ("group", "id", "_p", "sig")] + [pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(sent, names=["group", "id", "_p", "sig", "sh"]).filter(right)
        _HASHES.clear()
        release_memory()

    sent = deal_to_tiles(rows.mapInArrow(sets, "group long, id long, _p long, sig binary, sh binary"), F.col("_p"))

    def confirm(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, sigs = [], [], []
        for batch in batches:
            ids += batch.column("id").to_pylist()
            sigs += batch.column("sig").to_pylist()
            sets += [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("sh")]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(sets[i])))
        ids, sets, sig = [ids[i] for i in order], [sets[i] for i in order], _signatures([sigs[i] for i in order])
        size = np.array([len(s) for s in sets])

        def alike(i: int, others: np.ndarray) -> np.ndarray:
            near = others[_matches(sig, i, others) >= MATCHES]
            if not len(near):
                return near
            both = np.concatenate([sets[j] for j in near])
            at = np.searchsorted(sets[i], both)
            same = sets[i][np.minimum(at, size[i] - 1)] == both
            common = np.add.reduceat(same, np.concatenate(([0], np.cumsum(size[near])[:-1])), dtype=np.int64)
            return near[100 * common >= PERCENT * (size[near] + size[i] - common)]

        edges = forest_edges(len(ids), alike)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in edges], pa.int64()), pa.array([ids[j] for _, j in edges], pa.int64())], names=["a", "b"])

    return sent.select("group", "_i", "_j", "id", "sig", "sh").groupBy("group", "_i", "_j").applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when their sets of five-word shingles (the whole sequence where there
    are fewer words) have a similarity of 0.75 or more; components are closed over links. Texts
    that are null, empty or without words have no set, link with nothing and are kept. Equal
    sets are one until the end. All sets of an id that repeats with several texts belong
    together, and its rows count as kept if it is the smallest; null ids link with nothing and
    are kept. Other columns stay behind.
    """
    scratch = Scratch(docs.sparkSession)
    sketches = scratch.cut(sketch(docs, doc_id, text), "sketches")
    linked = sketches.where("id IS NOT NULL AND key IS NOT NULL")
    sets = linked.groupBy("key").agg(F.min("id").alias("doc"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    sets = scratch.cut(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    near = components(candidate_edges(sets.select("id", "sig"), scratch), scratch)
    groups = near.join(sets, near["node"] == sets["id"]).select("id", "doc", "key", F.col("component").alias("group"), "n", "sig")
    # an id with several texts has several sets, which belong together
    several = linked.groupBy("id").agg(F.min("key").alias("_low"), F.max("key").alias("_high")).where("_low <> _high").select(F.col("id").alias("doc"))
    several = linked.select(F.col("id").alias("doc"), "key").join(several, "doc").distinct().join(sets.select("key", "id"), "key")
    one = several.groupBy("doc").agg(F.min("id").alias("a"))
    same = several.join(one, "doc").select("a", F.col("id").alias("b"))
    links = components(confirmed_edges(docs, groups, doc_id, text).unionByName(same), scratch)
    members = links.join(sets.select(F.col("id").alias("node"), "doc"), "node")
    least = members.groupBy("component").agg(F.min("doc").alias("_least"))
    rep = sets.join(members.join(least, "component").select(F.col("node").alias("id"), "_least"), "id", "left")
    rows = sketches.join(rep.select("key", F.coalesce("_least", "doc").alias("_rep")), "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_rep", "id"))
    return scratch.close(rows.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    ))
