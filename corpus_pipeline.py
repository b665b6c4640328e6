"""Five stages that clean and encode a corpus: quality rules, near duplicates, repeated passages, benchmark leaks, ids.

Each stage takes what its predecessor kept, is written as Parquet to the session's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, ngram_jaccard, quality_rules, sentence_pieces, store, suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    return quality_rules.accepted(docs, "v2")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id, once; documents without words stay."""
    store.ship(spark)
    return ngram_jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that a smaller doc_id has."""
    store.ship(spark)
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    store.ship(spark)
    return decontaminate.without_leaks(docs, store.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of what is left."""
    store.ship(spark)
    return sentence_pieces.encode(docs, sentence_pieces.piece_bpe_path())


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("sentence_pieces", encoded),
]

#: SQL expresses neither the latent search nor the segmentation; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = store.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = store.folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            store.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
