"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, divergence, fill_in_middle, html_text, jaccard, mixing, passages, pii, quality, token_counts, topk, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk_search": topk.query,
    "op2_html_text": html_text.query,
    "op3_pii": pii.query,
    "op4_ngram_jaccard": jaccard.query,
    "op5_quality_rules": quality.query,
    "op6_token_counts": token_counts.query,
    "op7_bpe": bpe.query,
    "op8_url_filters": url_filters.query,
    "op9_mixing": mixing.query,
    "op9_mixing_pieces": mixing.pieces_query,
    "op10_chat": chat.query,
    "op10_chat_quoted": chat.quoted_query,
    "op11_substring_dedup": passages.query,
    "op12_divergence": divergence.query,
    "op13_fill_in_middle": fill_in_middle.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": topk.ORACLE, "op4_ngram_jaccard": jaccard.ORACLE, "op8_url_filters": url_filters.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat": chat.ORACLE, "op10_chat_quoted": chat.QUOTED_ORACLE,
    "op11_substring_dedup": passages.ORACLE, "op12_divergence": divergence.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE,
}
