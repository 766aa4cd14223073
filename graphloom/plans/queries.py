"""All named queries of the graph library."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

for _name in ("relational_queries", "text_queries", "graph_queries", "boundary_queries", "extract_queries"):
    importlib.import_module(f".{_name}", __package__)

__all__ = ["ORACLES", "QUERIES"]
