"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontamination, divergence, jaccard, line_dedup, mixing, neighbours, pages, periodic, quality, secrets, suffix_tree


def queries():
    return {
        "op1_ngram_jaccard_join": jaccard.op1_ngram_jaccard_join,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_suffix_tree_scoring": suffix_tree.op3_suffix_tree_scoring,
        "op4_site_style_tree": pages.op4_site_style_tree,
        "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_weighted_fair_mixing": mixing.op8_weighted_fair_mixing,
        "op9_projection_forest_neighbours": neighbours.op9_projection_forest_neighbours,
        "op10_quality_rules": quality.op10_quality_rules,
        "op11_periodic_runs": periodic.op11_periodic_runs,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_byte_bpe": bpe.op13_byte_bpe,
    }


def oracle_sql():
    return {
        "op1_ngram_jaccard_join": jaccard.OP1_SQL,
        "op2_chat_formatting": chat.OP2_SQL,
        "op5_benchmark_decontamination": decontamination.OP5_SQL,
        "op6_line_dedup": line_dedup.OP6_SQL,
        "op7_secret_scan": secrets.OP7_SQL,
        "op8_weighted_fair_mixing": mixing.OP8_SQL,
        "op11_periodic_runs": periodic.OP11_SQL,
        "op12_source_divergence": divergence.OP12_SQL,
    }
