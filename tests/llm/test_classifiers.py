import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, toxicity
from tidemark.llm.labels import held_out, labelled_sample
from tidemark.llm.toxicity import BlockMaxIndex

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _auc(rows, label):
    s, y = np.array([r.score for r in rows]), np.array([r[label] for r in rows])
    return (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()


def test_sample_leaves_the_held_out_fifth(spark, tables):
    import zlib

    docs, labels = tables
    rows = labelled_sample(docs, labels, "quality", 50).collect()
    assert len(rows) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    flags = labels.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in flags)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    ids = [k for k in range(1, 60) if not _out(k)]
    docs = spark.createDataFrame(
        [(ids[0], f"text {j}") for j in range(500)] + [(ids[0], None)] + [(k, "x" * 100) for k in ids[1:]] + [(None, "no id")], "doc_id long, text string",
    )
    labels = spark.createDataFrame([(k, 1) for k in ids] + [(ids[0], 0), (None, 1), (ids[1], None)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 1000).collect()
    assert sorted(r.doc_id for r in rows) == ids
    assert [(r.text, r.y) for r in rows if r.doc_id == ids[0]] == [("", 1)]
    assert len(labelled_sample(docs, labels, "quality", 2).collect()) == 2
    few = labelled_sample(docs, labels, "quality", 1000, sample_bytes=550).collect()
    assert sum(len(r.text) for r in few) <= 550 and 5 <= len(few) <= 6 and {tuple(r) for r in few} <= {tuple(r) for r in rows}
    assert labelled_sample(docs.limit(0), labels, "quality", 5).count() == 0


def test_machine_equals_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = quality.FactorisationMachine(rng.normal(size=(quality.WIDTH + 1, 1 + quality.RANK)))
    rows = [(np.sort(rng.choice(quality.WIDTH, n, replace=False)), rng.normal(size=n)) for n in (1, 5, 20)]
    got = m.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([0, 1, 6]))
    for g, (i, x) in zip(got, rows):
        w, v = m.params[i, 0], m.params[i, 1:]
        pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
        assert g == pytest.approx(m.params[quality.WIDTH, 0] + w @ x + pairs)


def test_quality(spark, tables, odd_docs, no_docs):
    docs, labels = tables
    params = quality.fit(docs, labels)
    rows = quality.score(docs, params).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert _auc(rows, "quality") > 0.9
    out = quality.score(odd_docs.withColumn("score", F.lit("old")), params)
    assert out.columns == [*odd_docs.columns, "score", "predicted"]
    got = out.collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 2}) == 1
    assert quality.score(no_docs, params).count() == 0
    assert quality.score(odd_docs.drop("n_chars"), params).count() == odd_docs.count()
    assert quality.fit(docs, labels.limit(0)) is None and {r.score for r in quality.score(odd_docs, None).collect()} == {0.5}


def test_index_is_exact():
    rng = np.random.default_rng(3)
    terms = [bytes([97 + k]) for k in range(26)]
    bag = lambda: {terms[t]: int(c) for t, c in zip(rng.choice(26, rng.integers(1, 6), replace=False), rng.integers(1, 4, 6))}
    examples = [(k, int(rng.integers(0, 2)), bag()) for k in range(700)]
    index = BlockMaxIndex(terms, rng.uniform(1, 5, 26), examples, 0.1)
    dense = np.zeros((700, 26))
    for k, (_, _, c) in enumerate(examples):
        t, w = index.vector(c)
        dense[k, t] = w
    for _ in range(200):
        q = bag()
        t, w = index.vector(q)
        cos = np.round(dense[:, t] @ w, 12)
        want = np.lexsort((np.arange(700), -cos))[:15]
        sims, docs = index.nearest(q)
        want = want[cos[want] > 0]
        assert docs.tolist() == want.tolist() and np.allclose(sims, cos[want])
    assert 5 not in index.nearest(examples[5][2], leave=5)[1]


def test_toxicity(spark, tables, odd_docs, no_docs):
    docs, labels = tables
    large = [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]
    index = toxicity.fit(*large)
    rows = toxicity.score(large[0], index).join(large[1], "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert _auc(rows, "toxic") > 0.9
    assert all(r.evidence == sorted(r.evidence, key=lambda e: -round(e.cosine, 12)) for r in rows)
    out = toxicity.score(odd_docs.withColumn("evidence", F.lit("old")), index)
    assert out.columns == [*odd_docs.columns, "score", "predicted", "evidence"] and out.count() == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.collect())
    assert toxicity.score(no_docs, index).count() == 0
    assert toxicity.fit(docs, labels.limit(0)) is None and {r.score for r in toxicity.score(odd_docs, None).collect()} == {0.5}
    nothing = toxicity.fit(docs, labels.withColumn("toxic", F.lit(0)))
    assert max(r.score for r in toxicity.score(docs, nothing).collect()) < 0.5


def test_every_word_is_indexed(spark):
    """A near copy of one toxic example, made of words that only that example has, finds it."""
    rng = np.random.default_rng(5)
    plain = lambda: " ".join(f"word{k}" for k in rng.zipf(1.3, 60) % 400)
    ids = [k for k in range(160) if not _out(k)]
    toxic = set(ids[::9])
    rare = {k: " ".join(f"slur{k}x{j}" for j in range(12)) for k in toxic}
    docs = [(k, f"{plain()} {rare[k]}" if k in toxic else plain()) for k in ids]
    one = min(toxic)
    extra = [(1000, f"new {rare[one]} text"), (1001, "unheard ofwords"), (1002, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    index = toxicity.fit(frame, spark.createDataFrame([(k, int(k in toxic)) for k in ids], "doc_id long, toxic int"))
    assert len(index.ids) == len(ids) and {w.encode() for _, t in docs for w in t.split()} <= set(index.terms)
    near, unknown, empty = toxicity.score(spark.createDataFrame(extra, "doc_id long, text string").coalesce(1), index).collect()
    assert near.evidence[0].doc == str(one) and near.evidence[0].label == 1 and near.score > unknown.score
    assert unknown.evidence == empty.evidence == [] and unknown.score == empty.score


def test_lists_and_blocks_together_are_exact():
    """Rare terms in lists, common ones in blocks, copies, and one left out, against all cosines."""
    rng = np.random.default_rng(8)
    terms = [b"%d" % k for k in range(3000)]
    bag = lambda: {terms[t]: int(c) for t, c in zip(np.unique(rng.zipf(1.2, 80) % 3000), rng.integers(1, 5, 80))}
    bags = [bag() for _ in range(900)]
    bags[500:540] = [bags[7]] * 40
    index = BlockMaxIndex(terms, rng.uniform(1, 50, 3000), [(k, k % 2, b) for k, b in enumerate(bags)], 0.1)
    dense = np.zeros((900, 3000))
    for k, b in enumerate(bags):
        t, w = index.vector(b)
        dense[k, t] = w
    asked = [*bags[:60], *[bag() for _ in range(60)], {}]
    leave = [*range(60), *[-1] * 61]
    for q, j, (sims, docs) in zip(asked, leave, index.nearest_of([index.vector(q) for q in asked], leave)):
        t, w = index.vector(q)
        cos = np.round(dense[:, t] @ w, 9)
        want = [k for k in np.lexsort((np.arange(900), -cos)) if cos[k] > 0 and k != j][:15]
        assert docs.tolist() == want and np.allclose(sims, cos[want])


def _out(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 5 == 0
