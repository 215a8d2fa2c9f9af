"""Loads every operator module and returns its queries and SQL."""

from __future__ import annotations

import importlib

from . import base

MODULES = ["line_dedup", "decontaminate", "jaccard_join", "bpe", "language_model", "toxicity", "quality", "url_filters", "html_text", "licenses", "lsh_forest", "prefix_trie", "phrases"]


def load_all() -> tuple[dict, dict]:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")
    return dict(base.QUERIES), dict(base.ORACLE)
