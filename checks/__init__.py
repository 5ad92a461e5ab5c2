"""Queries over the driver tables with their SQL counterparts."""

import importlib

MODULES = ["text_checks", "pii_checks", "deid_checks", "corpus_checks", "sentiment_checks", "model_checks", "series_checks", "io_checks", "invariant_checks", "streaming_checks"]


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"checks.{name}")
