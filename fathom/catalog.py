"""Registered queries of the market-data engine, each with its DuckDB twin."""

from __future__ import annotations

from fathom.plans import extra_queries, factor_queries, model_queries, search_queries, stream_queries, tick_queries  # noqa: F401  (they register)
from fathom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
