"""Queries and oracles of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from alertloom.llm import bpe, chat, decontamination, html_text, lexical, line_dedup, mixing, neighbours, ngram_join, prefix_trie, quality, sharding, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op10_html_extraction": html_text.op10_html_extraction,
        "op11_lexical_search": lexical.op11_lexical_search,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_bpe": bpe.op13_bpe,
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_mixing": mixing.op3_mixing,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_sharding": sharding.op5_sharding,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_nearest_neighbours": neighbours.op8_nearest_neighbours,
        "op9_quality": quality.op9_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op11_lexical_search": lexical.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op1_ngram_join": ngram_join.ORACLE,
        "op2_decontamination": decontamination.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op4_chat_formatting": chat.ORACLE,
        "op6_line_dedup": line_dedup.ORACLE,
        "op8_nearest_neighbours": neighbours.ORACLE,
    }
