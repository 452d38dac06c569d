"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

from tidegraph.llm.oracles import ORACLE_SQL

__all__ = ["NAMES", "ORACLE_SQL", "queries"]

NAMES = {
    "op1_host_quality_rules": "quality_rules",
    "op2_embedding_dedup": "embedding_dedup",
    "op3_hilbert_packing": "curve_packing",
    "op4_prefix_token_counts": "token_counts",
    "op5_sstable_shards": "sstable",
    "op6_ngram_jaccard_join": "ngram_join",
    "op7_url_filter": "url_filter",
    "op8_quality_classifier": "quality_classifier",
    "op9_line_dedup": "line_dedup",
    "op10_sentencepiece_codec": "sentencepiece_codec",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tidegraph.llm.{module}"), name) for name, module in NAMES.items()}
