import hashlib
import zlib

from pyspark.sql import functions as F

from tidemark.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def beside(tree, at):
    out = []
    for row in tree[:-1]:
        run = row[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def plain(rows):
    """Brute force over (doc_id, text, lang, source, n_chars)."""
    def leaf(d, s, g, n, t):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, g, n, t)))

    trees = {}
    for d, t, g, s, n in rows:
        low = t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        own = leaf(d, s, g, n, t)
        trees.setdefault(g, []).append(((d is not None, d or 0, own), d, own, leaf(d, s, g, n, low) if hit else own))
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        trees[g].sort(key=lambda x: x[0])
    lower = {g: levels([x[2] for x in trees[g]]) for g in order}
    top = levels([lower[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (_, d, own, tried) in enumerate(trees[g]):
            path = beside(lower[g], at) + beside(top, k)
            now = tried
            for left, right in path:
                now = sha(left + now + right)
            out.append((d, own, lower[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), now, now == top[-1][0]))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_odd_rows_and_clashing_columns(spark, odd_docs, no_docs):
    extra = odd_docs.withColumns({c: F.lit("x") for c in ("leaf", "tree", "block", "at", "n", "node", "changed", "id", "path", "root")})
    want = plain(rows_of(odd_docs))
    assert result(merkle.manifest(extra)) == want
    assert {r[6] for r in want} == {True, False}
    assert merkle.manifest(no_docs).count() == 0
    alone = odd_docs.where("doc_id = 1")
    got = merkle.manifest(alone).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("")


def test_many_levels_of_blocks(spark):
    docs = spark.range(0, 700, 1, 5).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"),
        F.expr("CASE WHEN id % 3 = 0 THEN concat('l', id % 12) WHEN id % 50 = 1 THEN NULL ELSE 'en' END").alias("lang"), F.lit("s").alias("source"), F.lit(3).alias("n_chars"),
    )
    # blocks of 8 leaves: three levels of blocks, and over 8 subroots
    full = merkle.manifest(docs, block_levels=1, versions=True)
    assert result(full) == plain(rows_of(docs))
    for r in full.where("doc_id % 50 = 1").collect():
        assert sha("".join(r.siblings)) == r.proof_sha256 and r.copied[-1] == r.folded_root and len(r.copied) == len(r.siblings)


def test_versions_share_untouched_nodes():
    tree = merkle.Tree([sha(str(k)) for k in range(200)], 3)
    before = list(tree.digests), list(tree.children)
    first = tree.replace(tree.root, 77, sha("new"))
    assert len(tree.digests) == len(before[0]) + 1 + 3  # the leaf and its ancestors only
    second = tree.replace(first, 3, sha("other"))
    assert (tree.digests[: len(before[0])], tree.children[: len(before[1])]) == before
    leaves = [sha(str(k)) for k in range(200)]
    leaves[77], leaves[3] = sha("new"), sha("other")
    assert tree.digests[second] == merkle.Tree(leaves, 3).digests[-1]
    assert tree.children[second][2] == tree.children[first][2] == tree.children[tree.root][2]
