"""A bounded sample of labelled documents, the same for every run over the same labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(mod: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves `rest`; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, mod: int, rest: int, limit: int) -> DataFrame:
    """doc_id, text and y of at most `limit` labelled documents that are not held out, chosen by hash of doc_id.

    Null labels don't count; of several labels of one document the largest does, of several texts the first by order.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    chosen = known.where(~held_out(mod, rest)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    # At most `limit` rows of two numbers: small enough to send to every executor.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
