"""The queries of this subpackage, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from . import centroid_search, chat_rotation, curriculum, decontaminate, host_quality, lm_trie, ngram_join, packing, pii_boosting, secret_forest, toxicity, vector_codes, warc_fixity


def queries() -> dict:
    return {
        "op1_decontamination": decontaminate.op1_decontamination,
        "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_chat_rotation": chat_rotation.op5_chat_rotation,
        "op6_elias_fano_lm": lm_trie.op6_elias_fano_lm,
        "op7_secret_forest": secret_forest.op7_secret_forest,
        "op8_warc_fixity": warc_fixity.op8_warc_fixity,
        "op9_host_quality": host_quality.op9_host_quality,
        "op10_pii_boosting": pii_boosting.op10_pii_boosting,
        "op11_centroid_search": centroid_search.op11_centroid_search,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_curriculum_mix": curriculum.op13_curriculum_mix,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_rotation": chat_rotation.SQL,
        "op8_warc_fixity": warc_fixity.SQL,
        "op9_host_quality": host_quality.SQL,
        "op11_centroid_search": centroid_search.SQL,
        "op12_vector_codes": vector_codes.SQL,
        "op13_curriculum_mix": curriculum.SQL,
    }
