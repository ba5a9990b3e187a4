"""Merkle manifest of a dataset as a persistent tree: versions copy paths and share the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Children of a node, and levels of a block: a task holds the leaves below one node that high.
FANOUT, BLOCK_LEVELS = 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Tree:
    """A persistent tree: nodes are only ever added, and a version is the number of its root.

    ``replace`` gives the version with one leaf replaced. It copies the leaf's ancestors; every
    other node is the older version's own.
    """

    def __init__(self, leaves: list[str], levels: int, fanout: int = FANOUT):
        self.fanout, self.levels = fanout, levels
        self.digests, self.children = list(leaves), [()] * len(leaves)
        row = range(len(leaves))
        for _ in range(levels):
            row = [self._add(tuple(row[k : k + fanout])) for k in range(0, len(row), fanout)]
        (self.root,) = row

    def _add(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def path(self, version: int, at: int) -> list[tuple[int, int]]:
        """Nodes from the root down to the parent of leaf ``at``, each with the place it goes on at."""
        out, node = [], version
        for level in reversed(range(self.levels)):
            place = at // self.fanout**level % self.fanout
            out.append((node, place))
            node = self.children[node][place]
        return out

    def siblings(self, version: int, at: int) -> list[tuple[str, str]]:
        """What stands left and right of the leaf's ancestors in their runs, from the leaf upwards."""
        out = []
        for node, place in reversed(self.path(version, at)):
            run = [self.digests[c] for c in self.children[node]]
            out.append(("".join(run[:place]), "".join(run[place + 1 :])))
        return out

    def replace(self, version: int, at: int, leaf: str) -> int:
        self.digests.append(leaf)
        self.children.append(())
        new = len(self.digests) - 1
        for node, place in reversed(self.path(version, at)):
            run = self.children[node]
            new = self._add((*run[:place], new, *run[place + 1 :]))
        return new


def climb(node: str, path: list[tuple[str, str]]) -> list[str]:
    """The copies of a node's ancestors, given what is shared beside it on each level."""
    out = []
    for left, right in path:
        node = digest(left + node + right)
        out.append(node)
    return out


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, nulls as ``-``."""
    texts = [c.cast("string") for c in columns]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*fields).cast("binary"), 256)


def tampered(doc_id: Column) -> Column:
    """Which rows the check tampers with: those whose id's CRC-32 three divides."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def numbered(rows: DataFrame, tree: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with their place ``at`` in their tree (from 0) and the tree's size ``n``.

    Range partitions on ``(tree, order)`` hold a large tree's rows in many tasks; what is summed
    is one count for each tree and partition that meet. Ties get a place each.
    """
    keys = [tree, *order, "_tie"]
    lined = (
        rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .drop("_tie").withColumn("_line", F.monotonically_increasing_id())
    )
    lined = scratch.cut(lined, "lined").withColumn("_part", F.shiftright("_line", 33))
    runs = lined.groupBy(tree, "_part").agg(F.min("_line").alias("_first"), F.count("*").alias("_count"))
    whole = Window.partitionBy(tree)
    before = F.sum("_count").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(tree, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(whole).alias("n"))
    return lined.join(runs, [tree, "_part"]).withColumn("at", F.col("_line") + F.col("_shift")).drop("_line", "_part", "_shift")


def _above(nodes: DataFrame, fanout: int, block_levels: int, scratch: Scratch) -> DataFrame:
    """For each node ``(tree, at, n, node)`` its path to the tree's root: ``(tree, at, path, root)``.

    Level by level in blocks of ``fanout ** block_levels`` aligned nodes, so that no task holds
    more; the last level's paths are then handed down again.
    """
    width = fanout**block_levels
    most = nodes.agg(F.max("n")).first()[0]
    if most is None or most == 1:
        return nodes.select("tree", "at", F.expr(f"cast(array() AS {_PATH})").alias("path"), F.col("node").alias("root"))

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        tree = Tree(table.column("node").to_pylist(), min(block_levels, height(n, fanout)), fanout)
        paths = [[{"left": a, "right": b} for a, b in tree.siblings(tree.root, k)] for k in range(len(table))]
        top = [tree.digests[tree.root]] * len(table)
        return pa.table({
            "tree": table.column("tree"), "at": table.column("at"), "n": table.column("n"), "block": table.column("block"), "top": top,
            "path": pa.array(paths, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
        })

    blocks = nodes.withColumn("block", F.floor(F.col("at") / width)).groupBy("tree", "block")
    own = scratch.cut(blocks.applyInArrow(build, f"tree string, at long, n long, block long, top string, path {_PATH}"), "paths")
    n = F.col("n")
    for _ in range(block_levels):
        n = F.ceil(n / fanout)
    tops = own.where(F.col("at") % width == 0).select("tree", F.col("block").alias("at"), n.alias("n"), F.col("top").alias("node"))
    higher = _above(tops, fanout, block_levels, scratch).select("tree", F.col("at").alias("block"), F.col("path").alias("_rest"), "root")
    return own.join(higher, ["tree", "block"]).select("tree", "at", F.concat("path", "_rest").alias("path"), "root")


def manifest(
    docs: DataFrame, id: str = "doc_id", tree: str = "lang", text: str = "text", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tamper: Column | None = None, versions: bool = False, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per document: ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves are digests of ``columns``; each value of ``tree`` (nulls are one) has a tree of its
    own over its leaves in order of ``id``, and the trees' roots, in order of ``tree``, have one
    above them. Where ``tamper`` holds (``tampered(id)`` if not given), the leaf is tried with
    the text's A-Z lower-cased: that makes a version of the tree which copies the leaf's
    ancestors and shares everything else, and ``folded_root`` is the version's root. With
    ``versions``, ``siblings`` (from the leaf upwards) and ``copied`` (the digests of the copied
    ancestors, the last one the root) come too.

    Texts are read once and hashed where they are; digests alone are shuffled. A block of
    ``fanout ** block_levels`` aligned leaves is one task's work: it makes the versions of its
    leaves up to the block's root, and its upper path, found in the same way over the blocks'
    roots, continues each of them, so upper nodes are shared by all versions of a block.

    Null ids come first and are not tampered with; null texts stay null. Rows that repeat an id
    are leaves of their own, ordered by digest; equal rows have equal leaves. Other columns
    don't count. No rows give no rows; a lone leaf is its tree's root.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tamper = tampered(F.col(id)) if tamper is None else tamper
    values = [F.col(c) for c in columns]
    changed = [F.translate(c, _UPPER, _LOWER) if name == text else c for name, c in zip(columns, values)]
    raw = docs.select(
        F.col(id).alias("id"), F.when(F.col(tree).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(tree).cast("string"))).alias("tree"),
        F.unhex(leaf_digest(*values)).alias("leaf"), F.when(tamper, F.unhex(leaf_digest(*changed))).alias("changed"),
    )
    width = fanout**block_levels
    leaves = numbered(scratch.cut(raw, "leaves"), "tree", ["id", "leaf"], scratch).withColumn("block", F.floor(F.col("at") / width))
    id_type = docs.schema[id].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        n = table.column("n")[0].as_py()
        base = Tree([x.hex() for x in table.column("leaf").to_pylist()], min(block_levels, height(n, fanout)), fanout)
        one = lambda name: pa.array([table.column(name).to_pylist()], pa.list_(table.schema.field(name).type))
        return pa.table({
            "tree": table.column("tree").slice(0, 1), "block": table.column("block").slice(0, 1), "n": [n],
            "node": [base.digests[base.root]], "ids": one("id"), "leaves": one("leaf"), "changes": one("changed"),
        })

    kinds = f"tree string, block long, n long, node string, ids array<{id_type}>, leaves array<binary>, changes array<binary>"
    packed = scratch.cut(leaves.groupBy("tree", "block").applyInArrow(pack, kinds), "blocks")
    n = F.col("n")
    for _ in range(block_levels):
        n = F.ceil(n / fanout)
    paths = scratch.cut(_above(packed.select("tree", F.col("block").alias("at"), n.alias("n"), "node"), fanout, block_levels, scratch), "upper")
    roots = numbered(paths.where("at = 0").select(F.lit("").alias("all"), "tree", F.col("root").alias("node")), "all", ["tree"], scratch)
    roots = scratch.cut(roots, "subroots")
    tops = _above(roots.select(F.col("all").alias("tree"), "at", "n", "node"), fanout, block_levels, scratch)
    tops = roots.join(tops.select("at", "path", F.col("root").alias("_root")), "at").select(
        "tree", F.col("node").alias("subroot"), F.col("path").alias("_rest"), F.col("_root").alias("root"),
    )
    upper = paths.drop("root").join(tops, "tree").select("tree", F.col("at").alias("block"), F.concat("path", "_rest").alias("path"), "subroot", "root")
    out = f"{id} {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if versions:
        out += ", siblings array<string>, copied array<string>"

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                yield _proved(row, versions, block_levels, fanout, batch.schema.field("ids").type.value_type)

    return scratch.close(packed.drop("node").join(upper, ["tree", "block"]).mapInArrow(prove, out))


def _proved(row: dict, versions: bool, block_levels: int, fanout: int, id_type: pa.DataType) -> pa.RecordBatch:
    leaves = [x.hex() for x in row["leaves"].as_py()]
    base = Tree(leaves, min(block_levels, height(row["n"].as_py(), fanout)), fanout)
    path = [(x["left"], x["right"]) for x in row["path"].as_py()]
    shared = "".join([a + b for a, b in path])
    subroot, root = row["subroot"].as_py(), row["root"].as_py()
    proofs, folded, siblings, copied = [], [], [], []
    for at, (leaf, new) in enumerate(zip(leaves, row["changes"].as_py())):
        beside = base.siblings(base.root, at)
        proofs.append(digest("".join([a + b for a, b in beside]) + shared))
        kept = len(base.digests)
        version = base.replace(base.root, at, leaf if new is None else new.hex())
        ancestors = base.digests[kept + 1 :] + climb(base.digests[version], path)
        folded.append(ancestors[-1] if ancestors else base.digests[version])
        if versions:
            siblings.append([a + b for a, b in beside + path])
            copied.append(ancestors)
        del base.digests[kept:], base.children[kept:]  # a version is let go once its root is known
    columns = {
        "id": pa.array(row["ids"].as_py(), id_type), "leaf": leaves, "subroot": [subroot] * len(leaves), "root": [root] * len(leaves),
        "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded],
    }
    if versions:
        columns |= {"siblings": pa.array(siblings, pa.list_(pa.string())), "copied": pa.array(copied, pa.list_(pa.string()))}
    return pa.RecordBatch.from_pydict(columns)
