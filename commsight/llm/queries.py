"""Queries of this subpackage, by name, and their SQL where there is one."""

from __future__ import annotations

from . import bpe, decontaminate, fim, fingerprints, jaccard, langid, neighbours, packing, pii, prefixtrie, quality, toxicity, wordpiece

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_token_counts": wordpiece.op3_token_counts,
    "op4_pii": pii.op4_pii,
    "op5_neighbours": neighbours.op5_neighbours,
    "op6_packing": packing.op6_packing,
    "op7_language_id": langid.op7_language_id,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op5_neighbours": neighbours.OP5_SQL,
    "op10_jaccard_join": jaccard.OP10_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_decontamination": decontaminate.OP12_SQL,
    "op13_prefix_trie": prefixtrie.OP13_SQL,
}
