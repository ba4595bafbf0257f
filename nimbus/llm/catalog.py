"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nimbus.llm import cover_search, cross_entropy, curve_search, hard_negatives, ngram_jaccard, packing, piece_transducer, secret_scan, sharding, substring_dedup, token_alignment, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_cover_tree_search": cover_search.op3_cover_tree_search,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_cross_entropy": cross_entropy.op5_cross_entropy,
        "op6_piece_transducer": piece_transducer.op6_piece_transducer,
        "op7_packing": packing.op7_packing,
        "op8_ngram_jaccard": ngram_jaccard.op8_ngram_jaccard,
        "op9_curve_search": curve_search.op9_curve_search,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_sharding": sharding.op11_sharding,
        "op12_token_alignment": token_alignment.op12_token_alignment,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE_SQL,
        "op8_ngram_jaccard": ngram_jaccard.ORACLE_SQL,
        "op3_cover_tree_search": cover_search.ORACLE_SQL,
        "op13_hard_negatives": hard_negatives.ORACLE_SQL,
    }
