"""Queries of the numbered operators and of the pipeline, with their SQL."""

from __future__ import annotations

import importlib

from textspark.llm import common

MODULES = ["pseudonyms", "url_filter", "warc", "decontaminate", "packing", "toxicity", "simhash", "quality_classifier", "token_counts", "quality_rules", "lexical_search", "source_audit", "byte_bpe"]


def load() -> tuple[dict, dict]:
    """(queries, SQL)."""
    for name in MODULES:
        importlib.import_module(f"textspark.llm.{name}")
    pipeline = importlib.import_module("corpus_pipeline")
    queries = dict(common.QUERIES) | {"pipeline": pipeline.run}
    sql = dict(common.SQL) | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
    return queries, sql
