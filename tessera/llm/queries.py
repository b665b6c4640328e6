"""The queries of this folder, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, ngram_jaccard, quality_classifier, quality_rules, sentence_pieces, suffix_dedup, token_ids, toxicity, warc
from .store import ship

Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    name: _shipped(query)
    for name, query in {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_token_ids": token_ids.op4_token_ids,
        "op5_warc": warc.op5_warc,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_quality_classifier": quality_classifier.op8_quality_classifier,
        "op9_ngram_jaccard": ngram_jaccard.op9_ngram_jaccard,
        "op10_language_id": language_id.op10_language_id,
        "quality_ablations": quality_rules.quality_ablations,
    }.items()
}

ORACLE: dict[str, str] = {"op6_quality_rules": quality_rules.OP6_SQL, "quality_ablations": quality_rules.ABLATIONS_SQL}
