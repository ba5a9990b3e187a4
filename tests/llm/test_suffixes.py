import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffixes


def test_suffix_order_and_owners():
    rng = random.Random(3)
    for trial in range(150):
        strings = ["".join(rng.choice(rng.choice(["ab", "a", "abc"])) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        if trial % 3 == 0:
            strings = [s + rng.choice(strings) for s in strings]
        length = rng.choice([24, 30, 50])
        owners, raw = np.array([rng.randint(0, 9) for _ in strings]), [s.encode() for s in strings]
        text = np.frombuffer(b"\xff".join([*raw, b""]), np.uint8) + np.uint8(1)
        order = suffixes.suffix_order(text, 56)
        assert sorted(order.tolist()) == list(range(len(text)))
        keys = [bytes(text)[p : bytes(text).index(0, p)][:56] for p in order]
        assert keys == sorted(keys)
        best = {}
        for o, s in zip(owners, raw):
            for k in range(len(s) - length + 1):
                best[s[k : k + length]] = min(best.get(s[k : k + length], 99), o)
        got = {(int(a), int(b)): int(c) for a, b, c in zip(*suffixes.first_owners(raw, owners, length))}
        assert got == {(i, k): best[s[k : k + length]] for i, s in enumerate(raw) for k in range(len(s) - length + 1)}


def test_anchors_cover_all_starts_and_depend_on_the_match_alone():
    rng = random.Random(4)
    for n in (0, 49, 50, 51, 400):
        raw = np.frombuffer(rng.randbytes(n), np.uint8)
        runs = list(suffixes.runs_of(raw, 50))
        starts = [s for r in runs for x, y in zip(r.first, r.last) for s in range(x, y + 1)]
        assert starts == list(range(max(0, n - 49)))
        for r in runs:
            at, names = r.single(np.ones(len(r.key), bool))
            assert at.tolist() == starts
            for x, y, z in zip(r.anchor, r.first, r.last):
                for s in (y, z):
                    own = next(suffixes.runs_of(raw[s : s + 50].copy(), 50))
                    assert own.anchor.tolist() == [x] and own.key[0] == names[s]
    loop = next(suffixes.runs_of(np.frombuffer(b"ab" * 500, np.uint8), 50))
    assert (loop.last - loop.first).max() < 31 and len(set(loop.key.tolist())) <= 4


def _plain(rows, length):
    seen, out = {}, []
    for k, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1) if k is not None else ():
            s = b[i : i + length]
            seen[s] = min(seen.get(s, k), k)
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1) if k is not None else ():
            if seen[b[i : i + length]] < k:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((k, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 5000, "hot_blocks": 1}, {"block_bytes": 20000, "hot_blocks": 3}])
def test_removal(spark, odd_docs, no_docs, kw):
    rows = [tuple(r) for r in odd_docs.collect()]
    want = sorted([w[:5] for w in _plain(rows, 50)], key=str)
    docs = odd_docs.withColumn("n_removed", F.lit("old"))
    got = suffixes.remove_repeats(docs, digest=True, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == want
    out = suffixes.remove_repeats(docs, **kw)
    assert out.columns == [*odd_docs.columns, "n_bytes", "n_removed", "n_spans"]
    texts = {(w[0], w[1]): (w[5].decode("utf-8", "ignore"), w[2]) for w in _plain(rows, 50)}
    for r in out.collect():
        text, gone = texts[r.doc_id, r.n_bytes]
        assert (r.text or "") == text and r.n_removed == gone
    assert out.where("doc_id = 3").first().text is None
    assert suffixes.remove_repeats(no_docs, digest=True).count() == 0


def test_texts_together_have_the_runs_of_each():
    rng = random.Random(5)
    texts = [np.frombuffer(rng.choice([b"ab" * 90, rng.randbytes(rng.randint(50, 300)), b"x" * 50]), np.uint8) for _ in range(40)]
    (numbers, raw, ends), = suffixes.together(enumerate(texts))
    r, = suffixes.runs_of(raw, 50, ends)
    starts = np.append(0, ends[:-1])
    got = [(int(t), int(a - starts[t]), int(b - starts[t]), int(h), int(k)) for t, a, b, h, k in zip(numbers[r.text], r.first, r.last, r.anchor, r.key)]
    assert got == [(i, int(a), int(b), int(h), int(k)) for i, x in enumerate(texts) for p in suffixes.runs_of(x, 50) for a, b, h, k in zip(p.first, p.last, p.anchor, p.key)]


def test_numbers_are_packed_byte_by_byte():
    ids = np.random.default_rng(6).integers(0, 250_000, 20_000)
    data = suffixes._packed(ids)
    assert np.array_equal(suffixes._array(data, len(ids), np.int64), ids)
    assert len(data) < 2.5 * len(ids) < len(suffixes._zipped(ids))


@pytest.mark.parametrize("bits", [1, 6])
def test_shared_tags_change_nothing(spark, odd_docs, bits):
    want = sorted([w[:5] for w in _plain([tuple(r) for r in odd_docs.collect()], 50)], key=str)
    got = suffixes.remove_repeats(odd_docs, digest=True, block_bytes=20000, hot_blocks=3, tag_bits=bits)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == want


def test_copies_in_many_blocks_stay_runs():
    import pyarrow as pa

    def hot(runs):
        stages = suffixes._Stages("doc_id", "text", 50, 1, 2, 30)
        tag, one = np.array([5, 9], np.uint64), np.array([False, False])
        rows = [(0, b, 2, stages.packed_tags(tag), suffixes._zipped(one), suffixes._packed(np.array([1, runs], np.int32))) for b in range(4)]
        out = list(stages.share()((pa.scalar(0),), iter(suffixes._emitted(suffixes._MARKED, rows))))
        return [suffixes._array(x, 2, bool).tolist() for batch in out for x in batch.column("hot").to_pylist()]

    assert hot(4) == [[False, False]] * 4 and hot(5) == [[False, True]] * 4
