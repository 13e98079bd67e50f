"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from siteq.llm import chat, decontaminate, fill_middle, jaccard_join, lexical_search, line_dedup, mixing, quality, quality_rules, secrets, substring_dedup, token_counts, topk

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_topk": topk.op2_topk,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_jaccard": jaccard_join.op6_jaccard,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_chat": chat.op8_chat,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}
ORACLES = {
    "op2_topk": topk.OP2_SQL,
    "op6_jaccard": jaccard_join.OP6_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op8_chat": chat.OP8_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_quality_rules": quality_rules.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
    "op13_fill_middle": fill_middle.OP13_SQL,
}
