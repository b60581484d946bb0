"""Operators for building text corpora, and the queries that apply each to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, lexical, lines, mixing, packing, pages, secrets, simhash, substrings, tokens, topk, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        substrings.op1_substring_dedup,
        topk.op2_exact_topk,
        lines.op3_line_dedup,
        packing.op4_packing,
        mixing.op5_mixing,
        simhash.op6_simhash,
        toxicity.op7_toxicity,
        audio.op8_media_columns,
        pages.op9_html_extraction,
        secrets.op10_secret_scan,
        whitening.op11_whitening,
        lexical.op12_lexical_search,
        tokens.op13_token_counts,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substrings.ORACLE, "op2_exact_topk": topk.ORACLE, "op3_line_dedup": lines.ORACLE, "op5_mixing": mixing.ORACLE, "op12_lexical_search": lexical.ORACLE}
