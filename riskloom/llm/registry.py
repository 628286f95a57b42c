"""Queries of this folder, by name, and their DuckDB counterparts."""

from riskloom.llm import conversation_trie, decontamination, jaccard, line_dedup, lm_scoring, mixing, oracles, quality, sharding, simhash, spelling, token_counts, toxicity, urls

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_simhash": simhash.op2_simhash,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_urls": urls.op7_urls,
    "op8_quality": quality.op8_quality,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": sharding.op10_sharding,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_jaccard": jaccard.op12_jaccard,
    "op13_spelling": spelling.op13_spelling,
}
ORACLE: dict[str, str] = {
    "op1_decontamination": decontamination.OP1_SQL,
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_lm_scoring": lm_scoring.OP4_SQL,
    "op11_conversation_trie": oracles.OP11_SQL,
    "op12_jaccard": oracles.OP12_SQL,
    "op13_spelling": oracles.OP13_SQL,
}
