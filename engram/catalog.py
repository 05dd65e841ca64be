"""Imports all operator modules, which fills the registry."""

import importlib

from engram.registry import QUERIES

MODULES = ("text", "lexical", "vectors", "fusion", "linking", "reports", "lifecycle", "graph", "mining", "streams", "sources", "more", "consolidation", "entities", "tagging", "codegraph", "insights", "recall", "precision", "codec", "intervals", "paths", "clusters")
for _module in MODULES:
    importlib.import_module(f"engram.operators.{_module}")

__all__ = ["MODULES", "QUERIES"]
