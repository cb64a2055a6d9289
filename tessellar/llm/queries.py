"""Queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations


from . import chat, codebooks, decontaminate, extract, jaccard, lloyd, neighbours, pfor, pieces, quality, sharding, toxicity, warc


def queries() -> dict:
    found = (
        pfor.op1_pfor_token_ids, decontaminate.op2_smith_waterman_decontamination, toxicity.op3_ftrl_toxicity, sharding.op4_hash_tree_sharding, pieces.op5_piece_lattice, warc.op6_merkle_fixity, jaccard.op7_heavy_light_jaccard, neighbours.op8_nn_descent, chat.op9_chat_template, extract.op10_min_cut_extraction,
        quality.op11_boosted_quality, lloyd.op12_plain_lloyd, codebooks.op13_kd_tree_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op12_plain_lloyd": lloyd.sql(), "op13_kd_tree_codes": codebooks.sql()}
