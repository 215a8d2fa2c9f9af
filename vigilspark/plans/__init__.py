"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ["index_queries", "alarm_queries", "control_queries", "waveform_queries", "fold_queries", "evaluation_queries", "sensitivity_queries", "source_queries", "streaming_queries"]


def load_all():
    """Import every query module and return (queries, oracle SQL)."""
    from . import registry

    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return registry.QUERIES, registry.ORACLE
