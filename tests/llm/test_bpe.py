import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def test_equals_library(library, encoder):
    rng = random.Random(1)
    bits = ["a", "th", "e ", "'s", "'re ", "1", "23", "é", "Σ", "ΑΣ ", "İ", "́", "\n", "\x1c", "<|endoftext|>", "<|", "!!", "  ", "日本", " ", "ing", ".", "Ᲊ", "՘", "À"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(al) for _ in range(n)) for n in (600, 9000) for al in ("a", "ab", "thein", "haaah", "日本語")]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == ids, t[:60]
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_small_windows_give_the_same_tokens(encoder):
    rng = random.Random(2)
    m = encoder.merges
    assert 0 < m.lookahead < 5000
    for n in (1500, 6000):
        for al in ("a", "thein", "abcdefghijklmnopqrstuvwxyz"):
            word = "".join(rng.choice(al) for _ in range(n))
            assert list(m.stream(iter(word), window=m.lookahead + 1)) == m.word(word)


def test_lookahead_bounds_every_influence():
    """A bound computed for a tiny merge list, against what any continuation can change."""
    letters = "abc"
    merges = [("a", "b"), ("c", "ab"), ("b", "c"), ("cab", "c"), ("a", "bc"), ("b", "a")]
    vocab = {}
    for s in [*bpe._byte_letters().values(), *[u + v for u, v in merges]]:
        for t in (s, s + "</w>"):
            vocab.setdefault(t, len(vocab))
    m = bpe.MergeList(merges, vocab, "</w>")
    rng = random.Random(3)
    spell = {i: t for t, i in vocab.items()}
    for _ in range(3000):
        head = "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))
        seen = set()
        for _ in range(6):
            out, at = [], 0
            for i in m.word(head + "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))):
                at += len(spell[i].removesuffix("</w>"))
                if at > len(head) - m.lookahead:
                    break
                out.append(i)
            seen.add(tuple(out))
        assert len(seen) == 1


def test_decoder_takes_any_portions(encoder):
    text = "naïve 日本語 — the end"
    ids = encoder.encode(text)
    machine = bpe.Decoder(encoder.spelt)
    parts = "".join(machine.feed([i]) for i in ids) + machine.finish()
    assert parts == encoder.decode(ids, plain=True)
    assert parts.replace(" ", "") == text.replace(" ", "")
    broken = bpe.Decoder({0: b"\xe6\x97", 1: b"a", 2: b"\xe6"})
    assert broken.feed([0, 1, 9, 2]) + broken.finish() == b"\xe6\x97a\xe6".decode("utf-8", "replace")


def test_ids_are_read_back_in_portions(encoder, library, monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdeéß'!1") for _ in range(rng.randint(1, 9))) for _ in range(800)) + " <|endoftext|> end"
    ids = library.encode(text, add_special_tokens=False).ids
    want = library.decode(ids, skip_special_tokens=False)
    machine = bpe.Joiner(encoder.token)
    assert "".join(machine.feed(ids[k : k + 3]) for k in range(0, len(ids), 3)) == want
    assert bpe.Joiner({1: "a", 2: "b"}).feed([9, 1, 7, 2, 9]) == "a b"
    for portion in (1, 7, 4096):
        monkeypatch.setattr(bpe, "PORTION", portion)
        assert encoder.digests(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want.encode()).hexdigest())
    assert encoder.digests("") == (0, hashlib.sha256().hexdigest(), hashlib.sha256().hexdigest())


def test_memo_keeps_what_is_used():
    memo = bpe.Memo(3)
    for k in range(40):
        memo.put(f"k{k}", (k,))
        assert memo.new.get("k0") or memo.get("k0") == (0,)
        assert len(memo.new) + len(memo.old) <= 6
    assert memo.get("k1") is None


def test_frames(spark, library, odd_docs, no_docs):
    docs = odd_docs.withColumn("token_ids", F.lit(1))
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == [*odd_docs.columns, "token_ids", "decoded"] and out.count() == odd_docs.count()
    for r in out.collect():
        assert r.token_ids == library.encode(r.text or "", add_special_tokens=False).ids
    for r in bpe.round_trip_digest(odd_docs.where("doc_id IS NOT NULL"), PATH).distinct().collect():
        ids = library.encode(odd_docs.where(F.col("doc_id") == r.doc_id).first().text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip_digest(no_docs, PATH).count() == bpe.encode(no_docs, PATH).count() == 0
