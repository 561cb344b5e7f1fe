"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from strophe.llm import byte_cnn, decontaminate, gif, jaccard_join, language_id, license_scan, lm_score, packing, prefix_trie, projection_passes, token_counts, toxicity, whitening

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_gif_media": gif.op3_gif_media,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_length_bucket_packing": packing.op9_length_bucket_packing,
    "op10_quality_classifier": byte_cnn.op10_quality_classifier,
    "op11_conversation_prefix_trie": prefix_trie.op11_conversation_prefix_trie,
    "op12_embedding_near_dedup": projection_passes.op12_embedding_near_dedup,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

SQL = {
    "op2_benchmark_decontamination": decontaminate.SQL,
    "op6_ngram_jaccard_join": jaccard_join.SQL,
    "op11_conversation_prefix_trie": prefix_trie.SQL,
    "op12_embedding_near_dedup": projection_passes.SQL,
}
