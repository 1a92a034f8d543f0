"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, language_id, near_vectors, ngram_join, packing, pii, quotations, token_counts, topk, toxicity


def queries() -> dict:
    found = (quotations.op1_quotation_linking, toxicity.op2_factorization_toxicity, packing.op3_best_fit_packing, topk.op4_top_inner_products, byte_bpe.op5_byte_bpe, ngram_join.op6_ngram_jaccard, near_vectors.op7_sorted_projections, language_id.op8_language_id, pii.op9_pii, token_counts.op10_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_top_inner_products": topk.ORACLE, "op6_ngram_jaccard": ngram_join.ORACLE, "op7_sorted_projections": near_vectors.ORACLE}
