"""The queries of this package, and the SQL for those that SQL can express."""

from __future__ import annotations

from casegrid.llm import best_fit_packing, embedding_dedup, exact_dedup, harmonic_packing, language_id, lexical_search, line_dedup, ngram_jaccard, prefix_trie, secret_scans, source_mix, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_secret_scans": secret_scans.op2_secret_scans,
        "op3_source_mix": source_mix.op3_source_mix,
        "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
        "op5_best_fit_packing": best_fit_packing.op5_best_fit_packing,
        "op6_language_id": language_id.op6_language_id,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_harmonic_packing": harmonic_packing.op13_harmonic_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard": ngram_jaccard.OP4_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op8_embedding_dedup": embedding_dedup.OP8_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "op10_suffix_dedup": suffix_dedup.OP10_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_lexical_search": lexical_search.OP12_SQL,
    }
