"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the documents it keeps.

A stage works on all that the one before it kept, and its rows are written before the next one
starts. Null and empty texts are scored, deduplicated and encoded like any others.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, minhash, quality, suffixes
from tidemark.llm.common import shared_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    params = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _back(quality.score(_aside(docs), params).where("predicted = 1"), docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def suffix_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that a smaller document has; none left: gone."""
    cut = suffixes.remove_repeats(_aside(docs))
    cut = cut.where("n_removed = 0 OR text RLIKE '\\\\S'").withColumn("_cut", F.col("n_removed") > 0)
    return _recounted(_back(cut, docs, "_cut"), docs, F.col("_cut"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what they share with test items; mostly shared: gone."""
    clean = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _recounted(clean, docs, F.lit(True))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and the text that these decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, path, decoded="decoded").withColumn("n_tokens", F.size("token_ids").cast("long"))


#: Columns that operators add; a documents column of such a name waits under another one.
_ADDED = ("score", "predicted", "n_bytes", "n_removed", "n_spans")


def _aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in _ADDED})


def _back(out: DataFrame, docs: DataFrame, *more: str) -> DataFrame:
    out = out.drop(*_ADDED).withColumnsRenamed({f"_own_{c}": c for c in docs.columns if c in _ADDED})
    return out.select(*docs.columns, *more)


def _recounted(out: DataFrame, docs: DataFrame, changed) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` of the text as it is now where it changed."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed & F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(docs.columns)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_deduplication),
    ("suffix-array dedup", suffix_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can't express the classifier; tests hold every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
