"""The queries of this subpackage and their oracle SQL, by registered name."""

from __future__ import annotations

from . import audit, chat, decontaminate, jaccard, lm, mixing, pii, quality, ranked, substring, tokens, topk, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii,
        topk.op2_exact_top_k,
        substring.op3_substring_dedup,
        mixing.op4_mix_sources,
        tokens.op5_token_counts,
        chat.op6_chat_formatting,
        lm.op7_lm_score,
        decontaminate.op8_decontaminate,
        quality.op9_quality_classifier,
        jaccard.op10_jaccard_join,
        toxicity.op11_toxicity,
        ranked.op12_ranked_search,
        audit.op13_filter_interactions,
    )
}

ORACLE_SQL = {
    "op2_exact_top_k": topk.OP2_SQL, "op3_substring_dedup": substring.OP3_SQL, "op6_chat_formatting": chat.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL, "op10_jaccard_join": jaccard.OP10_SQL,
    "op12_ranked_search": ranked.OP12_SQL, "op13_filter_interactions": audit.OP13_SQL,
}
