"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from weft.llm import bloom_lm, byte_bpe, chat, cover_tree, hard_negatives, mixing, neardup, pii, prefix_trie, quality, rff, secrets, token_files

QUERIES = {
    f.__name__: f
    for f in (
        pii.op1_pii,
        mixing.op2_mixing,
        quality.op3_quality,
        neardup.op4_neardup,
        token_files.op5_token_files,
        secrets.op6_secrets,
        secrets.secrets_incremental,
        cover_tree.op7_topk,
        bloom_lm.op8_lm,
        chat.op9_chat,
        byte_bpe.op10_byte_bpe,
        rff.op11_quality_classifier,
        hard_negatives.op12_hard_negatives,
        prefix_trie.op13_prefix_trie,
        # parts of operators 2 and 3 that SQL can state
        mixing.mix_targets,
        quality.quality_base,
    )
}
SQL = {
    "op4_neardup": neardup.SQL,
    "secrets_incremental": secrets.INCREMENTAL_SQL,
    "op7_topk": cover_tree.SQL,
    "op9_chat": chat.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
    "mix_targets": mixing.TARGETS_SQL,
    "quality_base": quality.BASE_SQL,
}
