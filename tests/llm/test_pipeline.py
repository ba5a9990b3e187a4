import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm import quality

from .test_decontamination import plain as plain_hits
from .test_near_duplicates import _plain_documents
from .test_suffixes import _plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after each stage."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def _rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_classifier_keeps_what_it_predicts(spark, stages):
    docs = stages[0]
    params = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, params).collect() if r.score >= 0.3}
    assert {r[0] for r in _rows(stages[1])} == want and stages[1].columns == docs.columns
    assert 0 < len(want) < docs.count()


def test_one_of_each_group_stays(stages):
    rows = _rows(stages[1])
    want = {k for k, _, _, kept in _plain_documents(rows) if kept}
    assert sorted(_rows(stages[2])) == sorted(r for r in rows if r[0] in want)


def test_repeated_passages_go(stages):
    rows = _rows(stages[2])
    want = []
    for r, (_, _, gone, _, _, kept) in zip(rows, _plain(rows, 50)):
        text = kept.decode("utf-8", "ignore")
        if not gone:
            want.append(r)
        elif text.strip():
            want.append((*r[:1], text, *r[2:4], len(text)))
    assert sorted(_rows(stages[3])) == sorted(want)


def test_test_items_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {r[0]: r for r in _rows(stages[4])}
    for r in _rows(stages[3]):
        n, hit, _ = plain_hits(r[1], items, 10)
        assert (r[0] in left) == (2 * len(hit) <= n)
        if not hit:
            assert left[r[0]][1:4] == r[1:4]
        elif r[0] in left:
            assert plain_hits(left[r[0]][1], [], 10)[0] == n - len(hit) and left[r[0]][4] == len(left[r[0]][1])


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = stages[5].collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in _rows(stages[4]))
    for r in out:
        assert r.token_ids == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        assert "".join(r.decoded.split()) == "".join(library.normalizer.normalize_str(r.text).split())


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            rows = out.count()
            assert rows <= docs.count() and (k == 4 or out.columns == docs.columns)
    kept = corpus_pipeline.near_deduplication(spark, odd_docs, SF)
    assert kept.where("doc_id IS NULL").count() == 2 and kept.where("doc_id = 3").count() == 1


def test_columns_named_like_added_ones_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    own = {"score": F.lit(-1), "predicted": F.lit("x"), "n_bytes": F.lit(-7), "n_removed": F.lit(5), "n_spans": F.lit(None).cast("string")}
    twice = docs.unionByName(docs.select(F.col("doc_id") + 1000, *docs.columns[1:]).toDF(*docs.columns)).withColumns(own)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, twice, SF)
        assert out.columns == twice.columns
        assert {tuple(r) for r in out.select(*own).distinct().collect()} == {(-1, "x", -7, 5, None)}
