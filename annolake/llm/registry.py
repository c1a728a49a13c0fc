"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import centroids, decontaminate, licences, lines, media, neardup, pieces, pii, sharding, simhash, tokenfiles, toxicity, trie


def queries() -> dict:
    found = (
        sharding.op1_flow_reshard,
        pii.op2_deobfuscated_pii,
        neardup.op3_tensored_minhash,
        pieces.op4_backtracking_pieces,
        toxicity.op5_counterfactual_toxicity,
        decontaminate.op6_seeded_alignment,
        media.op7_iso_media,
        lines.op8_line_spread,
        licences.op9_fuzzy_licences,
        tokenfiles.op10_token_files,
        simhash.op11_deletion_variants,
        centroids.op12_rotated_centroids,
        trie.op13_prefix_rollup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_line_spread": lines.OP8_SQL, "op12_rotated_centroids": centroids.OP12_SQL, "op13_prefix_rollup": trie.OP13_SQL}
