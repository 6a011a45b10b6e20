"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from . import bpe, exact_dedup, language_id, license_scan, mixing, near_dup, quality, secrets_scan, token_files, topk_search


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_near_duplicates": near_dup.op1_near_duplicates,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_secret_scan": secrets_scan.op4_secret_scan,
        "op5_language_id": language_id.op5_language_id,
        "op6_quality": quality.op6_quality,
        "op7_bpe": bpe.op7_bpe,
        "op8_token_files": token_files.op8_token_files,
        "op9_topk_search": topk_search.op9_topk_search,
        "op10_mixing": mixing.op10_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Tokenizers have no SQL: their tests hold them against the libraries."""
    return {"op3_exact_dedup": exact_dedup.SQL, "op9_topk_search": topk_search.SQL, "op10_mixing": mixing.SQL}
