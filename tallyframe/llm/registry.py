"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import avi, bpe, dedup, jaccard, lexical, licenses, linkgraph, mixing, pii, quality, tokencount, topk, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_mixing": mixing.op2_mixing,
        "op3_quality": quality.op3_quality,
        "op4_licenses": licenses.op4_licenses,
        "op5_pii": pii.op5_pii,
        "op6_token_counts": tokencount.op6_token_counts,
        "op7_jaccard": jaccard.op7_jaccard,
        "op8_exact_dedup": dedup.op8_exact_dedup,
        "op9_avi": avi.op9_avi,
        "op10_url_filters": linkgraph.op10_url_filters,
        "op11_lexical": lexical.op11_lexical,
        "op12_topk": topk.op12_topk,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": licenses.OP4_SQL,
        "op7_jaccard": jaccard.OP7_SQL,
        "op8_exact_dedup": dedup.OP8_SQL,
        "op10_url_filters": linkgraph.OP10_SQL,
        "op11_lexical": lexical.OP11_SQL,
        "op12_topk": topk.OP12_SQL,
    }
