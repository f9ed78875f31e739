"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenq.llm import context_tree, decontaminate, exact_dedup, html_text, importance, near_dedup, packing, pii, quality, token_counts, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_pii_pseudonyms": pii.op7_pii_pseudonyms,
    "op8_toxicity_grammar": toxicity.op8_toxicity_grammar,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_context_tree": context_tree.op11_context_tree,
    "op12_importance_resampling": importance.op12_importance_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL = {
    "op3_benchmark_decontamination": decontaminate.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_minhash_near_dedup": near_dedup.OP9_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
