"""Queries of the corpus operators and their SQL, for the entry point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rheolake.llm import byte_bpe, decontaminate, hnsw, langid, line_dedup, merkle, pii, prefix_trie, quality, sentencepieces, simhash, token_files, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepieces": sentencepieces.op1_sentencepieces,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_hnsw": hnsw.op3_hnsw,
        "op4_token_files": token_files.op4_token_files,
        "op5_language_id": langid.op5_language_id,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_pii": pii.op7_pii,
        "op8_simhash": simhash.op8_simhash,
        "op9_quality": quality.op9_quality,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.SQL,
        "op6_url_filter": url_filter.SQL,
        "op10_line_dedup": line_dedup.SQL,
        "op11_prefix_trie": prefix_trie.SQL,
        "op13_merkle": merkle.SQL,
    }
