"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from quantloom.llm import op01_topk, op02_chat, op03_substring, op04_near_dup, op05_language, op06_bpe, op07_toxicity, op08_packing, op09_exact_dedup, op10_sharding, op11_token_files, op12_alignment, op13_prefix_trie

QUERIES = {
    "op1_hamming_topk": op01_topk.query,
    "op2_chat_formatting": op02_chat.query,
    "chat_reply_trees": op02_chat.reply_trees,
    "op3_substring_dedup": op03_substring.query,
    "op4_near_dup": op04_near_dup.query,
    "op5_language_id": op05_language.query,
    "op6_bpe_automaton": op06_bpe.query,
    "op7_toxicity": op07_toxicity.query,
    "op8_packing": op08_packing.query,
    "op9_exact_dedup": op09_exact_dedup.query,
    "op10_sharding": op10_sharding.query,
    "op11_token_files": op11_token_files.query,
    "op12_alignment": op12_alignment.query,
    "op13_prefix_trie": op13_prefix_trie.query,
}
ORACLES = {
    "op1_hamming_topk": op01_topk.ORACLE_SQL,
    "op2_chat_formatting": op02_chat.ORACLE_SQL,
    "chat_reply_trees": op02_chat.TREE_SQL,
    "op3_substring_dedup": op03_substring.ORACLE_SQL,
    "op4_near_dup": op04_near_dup.ORACLE_SQL,
    "op9_exact_dedup": op09_exact_dedup.ORACLE_SQL,
    "op13_prefix_trie": op13_prefix_trie.ORACLE_SQL,
}
