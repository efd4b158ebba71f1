"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, decontaminate, language_id, license_scan, ngram_jaccard, quality_classifier, quality_rules, repeats, secrets, token_counts
from llm.shared import shipped, small_batches

Query = Callable[[SparkSession, str], DataFrame]


def _shipping(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shipped(spark)
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_PLAIN: dict[str, Query] = {
    "op1_quality_rules": quality_rules.query,
    "op2_ngram_jaccard_join": ngram_jaccard.query,
    "op3_secret_scans": secrets.query,
    "op4_decontamination": decontaminate.query,
    "op5_token_counts": token_counts.query,
    "op6_language_id": language_id.query,
    "op6_language_id_documents": language_id.documents_query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_bpe": bpe.query,
    "op9_suffix_array_dedup": repeats.query,
    "op10_license_scans": license_scan.query,
}

QUERIES: dict[str, Query] = {name: _shipping(query) for name, query in _PLAIN.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_ngram_jaccard_join": ngram_jaccard.SQL,
    "op3_secret_scans": secrets.SQL,
    "op4_decontamination": decontaminate.SQL,
    "op9_suffix_array_dedup": repeats.SQL,
}
