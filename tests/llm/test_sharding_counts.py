import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tidemark.llm import sharding, token_counts
from tidemark.llm.token_counts import Pieces


def test_table_is_even_and_steady():
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(names, 1009)
    shares = [table.count(k) for k in range(7)]
    assert max(shares) - min(shares) <= 1 and sum(shares) == 1009
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.15 * 1009
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)


def test_assign_shards_keeps_rows_and_replaces_names(spark, odd_docs, no_docs):
    names = ["x", "y", "z"]
    out = sharding.assign_shards(odd_docs.withColumn("shard", F.lit("old")), "doc_id", names, 101)
    assert out.columns == [*odd_docs.columns, "slot", "shard"] and out.count() == odd_docs.count()
    assert out.where("shard IS NULL OR shard = 'old'").count() == 0
    assert out.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.assign_shards(no_docs, "doc_id", names, 101).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Exchange hashpartitioning" not in plan


def _library(scores):
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *scores]
    low = min(scores.values())
    # the byte pieces must not be matched as text: they score worse than anything else
    vocab = [(n, scores.get(n, low - 100.0 if n != "<unk>" else low)) for n in names]
    return models.Unigram(vocab, 0, True)


def test_counts_equal_plain_unigram():
    rng = random.Random(4)
    scores = {"▁": -5.0, **{c: -6.0 - k for k, c in enumerate("abc")}}
    for _ in range(60):
        scores["".join(rng.choice("▁abc" if k == 0 else "abc") for k in range(rng.randint(2, 5)))] = -float(rng.randint(1, 12))
    pieces = Pieces(scores)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(400)} | {"a" * 300})

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[s][0] + scores[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in scores]
            top = None
            for o in options:
                if top is None or o[0] > top[0]:
                    top = o
            if word[end - 1] not in scores:
                o = (best[end - 1][0] + min(scores.values()) - 10, best[end - 1][1] + len(word[end - 1].encode()))
                if top is None or o[0] > top[0]:
                    top = o
            best.append(top)
        return best[-1][1]

    assert pieces.count_sorted(words) == {w: plain("▁" + w) for w in words}
    few = Pieces(scores)
    assert few.counts(set(words[::2])) | few.counts(set(words)) == {w: plain("▁" + w) for w in words}


def test_counts_agree_with_library_on_real_vocabulary():
    pieces = Pieces.from_model(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["the", "tokenization", "Straße", "naïve", "ababab", "12345", "don't", "日本"]
    names = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], *pieces.scores]
    low = min(pieces.scores.values())
    library = Tokenizer(models.Unigram([(n, pieces.scores.get(n, low)) for n in names], 0, True))
    for w in words:
        assert pieces.count_sorted([w])[w] == len(library.encode("▁" + w).ids), w


def test_count_tokens_on_odd_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = token_counts.count_tokens(odd_docs.withColumn("n_tokens", F.lit("old")), path, chars_at_once=500)
    assert out.columns == [*odd_docs.columns, "n_pretokens", "n_tokens"]
    pieces = Pieces.from_model(path)
    for r in out.collect():
        words = (r.text or "").split()
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(pieces.count_sorted([w])[w] for w in words)
    assert token_counts.count_tokens(no_docs, path).count() == 0
