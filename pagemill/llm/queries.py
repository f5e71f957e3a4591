"""The registered queries of this package and their check SQL."""

from __future__ import annotations

from pagemill.llm import (
    lines,
    minhash,
    mining,
    mixing,
    neural,
    packing,
    quality,
    sharding,
    sigtree,
    substrings,
    tokens,
    topk,
    trie,
)

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_token_counts": tokens.query,
    "op3_mixing": mixing.query,
    "op4_lm_scoring": neural.query,
    "op5_substring_dedup": substrings.query,
    "op6_quality": quality.query,
    "op7_quality_rules": lines.query,
    "op8_packing": packing.query,
    "op9_topk": topk.query,
    "op10_minhash": minhash.query,
    "op11_hard_negatives": mining.query,
    "op12_prefix_trie": trie.query,
    "op13_ngram_join": sigtree.query,
}
ORACLES = {
    "op3_mixing": mixing.SQL,
    "op5_substring_dedup": substrings.SQL,
    "op7_quality_rules": lines.SQL,
    "op9_topk": topk.SQL,
    "op10_minhash": minhash.SQL,
    "op11_hard_negatives": mining.SQL,
    "op12_prefix_trie": trie.SQL,
    "op13_ngram_join": sigtree.SQL,
}
