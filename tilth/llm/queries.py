"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilth.llm import decontamination, embedding_dedup, fingerprints, html_extraction, jaccard_join, language_id, line_dedup, packing, quality, source_audit, substring_dedup, token_counts, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lz_fingerprints": fingerprints.query,
    "op2_language_id": language_id.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_token_counts": token_counts.query,
    "op5_quality": quality.query,
    "op6_best_fit_packing": packing.query,
    "op7_decontamination": decontamination.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_html_extraction": html_extraction.query,
    "op10_line_dedup": line_dedup.query,
    "op11_vector_codes": vector_codes.query,
    "op12_embedding_dedup": embedding_dedup.query,
    "op13_source_audit": source_audit.query,
}

ORACLE_SQL: dict[str, str] = {
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op8_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op13_source_audit": source_audit.ORACLE_SQL,
}
