"""Labelled samples that the classifiers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text in a sample at most, and the tasks that work on it.
SAMPLE_BYTES, PIECES = 64 << 20, 16


def held_out(doc_id: Column) -> Column:
    """Whether a document belongs to the fifth that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, extra: tuple[str, ...] = (), sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fifth: ``(doc_id, text, y, *extra)``.

    The sample is the ``rows`` smallest hashes of the document id among usable labels (0 or 1),
    one row an id: the larger label where labels disagree, the least text (then the least extra
    columns) where documents repeat an id. Null texts are empty. From the smallest hash on, it
    ends before the text that would take it over ``sample_bytes``. It doesn't depend on order or
    partitioning. Only ids and labels are sorted; being so few, they are broadcast to the texts.
    """
    y, place = F.col(label).cast("int"), F.xxhash64(F.col("doc_id").cast("string"))
    few = (
        labels.where(F.col("doc_id").isNotNull() & y.isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(y).alias("y")).orderBy(place, "doc_id").limit(rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).join(F.broadcast(few), "doc_id")
    one = found.groupBy("doc_id", "y").agg(F.min(F.struct("text", *extra)).alias("_row")).select("doc_id", "_row.*", "y")
    sofar = F.sum(F.octet_length("text")).over(Window.orderBy(place, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # ``rows`` at most
    return one.withColumn("_sofar", sofar).where(F.col("_sofar") <= sample_bytes).select("doc_id", "text", "y", *extra).repartition(PIECES, "doc_id")
