"""Labelled rows for training: never those of the held-out fold, at most as many as asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; not for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents outside the held-out fold, the first by a hash of the id.

    Rows without id or label are ignored; of several labels of an id the largest counts; of repeated rows one text.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # at most ``rows`` narrow rows
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
